"""Corpus pipeline: language ID, exact, near and passage deduplication, then packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  Decisions are joined back by doc_id together
with a hash of the text, so repeated or null ids don't mix rows up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.exact_dedup import distinct_texts
from quillstone.llm.langid import UNKNOWN, identify, train
from quillstone.llm.near_copies import near_copies
from quillstone.llm.packing import pack_documents
from quillstone.llm.scratch import Scratch
from quillstone.llm.simhash import simhash_groups, text_hash
from quillstone.llm.skew import without
from quillstone.llm.suffix_dedup import without_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null text too) go; the others stay as they are, also where no language could be learnt.

    The decoder's choice among the learnt languages rejects nothing.
    """
    names = tuple(docs.columns)
    model = train(docs)
    if not model.langs:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    judged = identify(docs, model, keep=names)
    return judged.where(F.col("lang_pred") != UNKNOWN).select(*(F.col(f"kept_{i}").alias(c) for i, c in enumerate(names)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays; repeats of that row go too."""
    return distinct_texts(docs)


def first_of(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs without those rows whose group's component_id is another one; groups is a written table."""
    gone = groups.where("component_id IS NOT NULL AND NOT doc_id <=> component_id").select("doc_id", "text_hash")
    return without(docs, gone, {"doc_id": F.col("doc_id"), "text_hash": text_hash()})


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """op1's own rule (three-word shingles, two bits) as a stage; not one of STAGES, which need `similar`."""
    return first_of(docs, simhash_groups(docs))


def similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest doc_id stays; a group without ids stays whole."""
    return first_of(docs, near_copies(docs))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 50 bytes or more go; documents of which no word is left go with them."""
    return without_repeats(docs, length_col="n_chars").where(F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 1024 tokens, filled with lexical neighbours."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language),
    ("exact dedup", exact),
    ("near dedup", similar),
    ("passage dedup", passages),
    ("packing", packing),
]

#: Fingerprints and tokenisation have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what each leaves is written once, for the next one to read, and removed when that one's is written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        kept = scratch.keep(stage(spark, docs, sf_dir))
        scratch.only(kept)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
