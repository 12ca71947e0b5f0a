"""Training-data pipeline operators.

Thirteen corpus operators (deduplication, URL filtering, sharding, media columns,
tokenisation, language identification, packing, periodic runs, importance
resampling, toxicity).  Nothing else in the library
imports this subpackage; ``queries`` exposes them under the driver contract.
"""
