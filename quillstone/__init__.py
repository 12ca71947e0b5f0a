"""Quillstone: product-knowledge retrieval and document analytics on Spark DataFrames."""
