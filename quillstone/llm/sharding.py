"""Contiguous shards of near-equal byte size (DataFrame functions only).

Rows are range-partitioned by id and written once with their partition number.
Totals per partition (one row each) give exclusive prefix sums of bytes and rows;
within a partition a running window adds the rest.  A row goes to the shard in
which the middle of its byte interval falls, so each cut misses its equal target
by at most half a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, parts


def byte_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1 (null text: 1), the law is ``bytes`` and
    grown_shard is null.  Shards follow ascending ids (null ids first, ties by a
    row number fixed when the rows are first written); slot counts from 0 in that
    order within the shard.  Equal ids may be dealt to two neighbouring shards.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("row_id"))
    ranged = scratch.keep(rows.repartitionByRange(parts(spark), "doc_id", "row_id").withColumn("part", F.spark_partition_id()))

    #: One row per partition: its size is the session's number of shuffle partitions.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    within = Window.partitionBy("part").orderBy("doc_id", "row_id")
    start = F.col("bytes_before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = scratch.keep(
        ranged.join(F.broadcast(offsets), "part")
        .select("doc_id", "size", "text_crc32", "all_bytes", start.alias("start"),
                (F.col("rows_before") + F.row_number().over(within) - 1).alias("row_no"))
        .selectExpr("doc_id", "size", "text_crc32", "row_no",
                    f"CAST(least({shards} - 1, ((2 * start + size) * {shards}) DIV (2 * all_bytes)) AS INT) AS shard"))
    firsts = placed.groupBy("shard").agg(F.min("row_no").alias("first_row"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row_no") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
