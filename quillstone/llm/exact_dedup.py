"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

A frequent-items sketch of the Misra-Gries family (``approx_top_k``, mergeable, of
fixed size) proposes digests that may fill a task on their own.  Their exact counts
and winners are computed with map-side partial aggregation, so at most one row per
proposed digest and task is shuffled.  Those that hold over 1 / `share` of the rows,
fewer than `share`, are broadcast; all other digests are rarer and take the
ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .skew import without

#: Runs of these bytes count as one space when texts are compared.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def normalised(text: str = "text") -> F.Column:
    """The compared form: null as empty, each run of white space as one space."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE_RUN, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 1000) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, text_hash (XXH64 of the text as it is).

    The row with the smallest id of each group of equal texts stays.  A null id
    sorts after all others; if a whole group has null ids, keep_id is null.  Of
    repeated rows with the same smallest id exactly one is kept.  Null and empty
    texts form one group.  Other columns of the input are not read.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    digests = scratch.keep(docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(normalised(text_col), 256).alias("text_sha256"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
        F.monotonically_increasing_id().alias("row_id"),
    ))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_id")
    # The sketch's counts are off by at most 3.5 / tracked of the rows, so nothing over 1 / share of them is missing.
    proposed = (digests.agg(F.expr(f"approx_top_k(text_sha256, {4 * share}, {16 * share})").alias("top"))
                .select(F.explode("top.item").alias("text_sha256")))
    rows = digests.agg(F.count("*").alias("rows"))
    winners = scratch.keep(digests.join(F.broadcast(proposed), "text_sha256", "left_semi")
                           .groupBy("text_sha256").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
                           .join(F.broadcast(rows), F.col("group_size") * share > F.col("rows")).drop("rows"))
    frequent = digests.join(F.broadcast(winners), "text_sha256")
    group = Window.partitionBy("text_sha256")
    rest = (digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
            .select("*", F.min(order).over(group).alias("best"), F.count("*").over(group).alias("group_size")))
    return frequent.unionByName(rest).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("best.row_id")).alias("kept"),
        "text_sha256",
        "text_hash",
    )


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows without later copies: the row with the smallest id of each group of equal texts stays, with all its columns.

    Only the keys of rows to drop, id and text hash, are written and joined back.
    Repeated rows of the id that stays (or null ids, if a group has no other) are
    kept once.
    """
    scratch = Scratch(docs.sparkSession, "distinct")
    judged = exact_dedup(docs, id_col, text_col).where("NOT kept")
    gone = scratch.keep(judged.select("doc_id", "text_hash", "text_sha256", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("repeated")))
    later = gone.where("NOT repeated").select("doc_id", "text_hash")
    rest = without(docs, later, {"doc_id": F.col(id_col), "text_hash": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    repeated = gone.where("repeated").select("doc_id", "text_sha256").distinct()
    if not repeated.limit(1).count():
        return rest
    sha = "sha"
    while sha in docs.columns:
        sha += "_"
    keyed = rest.withColumn(sha, F.sha2(normalised(text_col), 256))
    same = keyed[id_col].eqNullSafe(repeated["doc_id"]) & (keyed[sha] == repeated["text_sha256"])
    once = keyed.join(repeated, same, "left_semi").dropDuplicates([id_col, sha])
    return keyed.join(repeated, same, "left_anti").unionByName(once).drop(sha)
