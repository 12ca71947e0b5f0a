"""Target-distribution importance resampling over hashed word n-grams.

One scan of a text keeps the running zlib CRC-32 of the features that begin at the
last n words; each further word extends every one of them by a space and itself, so
no feature's bytes are put together.  Bucket counts of all documents and of the
target set give each bucket a gain, a document's weight is the sum of its
features' gains, and Gumbel noise from a hash of its id makes the largest scores a
draw without replacement in proportion to e^weight.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesops import arrow_map
from .scratch import Scratch, parts

#: Words are runs of ASCII digits and lower-case letters and of all characters beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def feature_buckets(text: bytes, n: int, buckets: int) -> tuple[int, np.ndarray]:
    """Words of a text, and the bucket of each feature: each run of 1 to n words joined by one space, repeats included."""
    ring: list[int] = []
    out: list[int] = []
    words = WORD.findall(text.lower())  # bytes.lower changes A-Z only
    for word in words:
        ring = [zlib.crc32(word), *map(zlib.crc32, repeat(b" " + word), ring[:n - 1])]
        out += ring
    return len(words), np.array(out, np.int64) % buckets


def bucketed(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """texts (doc_id, text as binary) as doc_id, n_words and found: the features' buckets as little-endian numbers of two bytes, or four if there are over 65,536 buckets."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    width = number_type(buckets)

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [feature_buckets(text.as_py() or b"", n, buckets) for text in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([w for w, _ in found], pa.int64()), pa.array([b.astype(width).tobytes() for _, b in found], pa.binary())],
                                                 names=["doc_id", "n_words", "found"])

    return arrow_map(texts.select("doc_id", "text"), scan, f"doc_id {kind}, n_words bigint, found binary")


def number_type(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows of a table of `bucketed`; each task sums its own first."""
    width = number_type(buckets)

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in rows:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), width), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    # At most one row a bucket comes to the driver.
    for r in arrow_map(found.select("found"), count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the target's share of a bucket over the source's), both smoothed by one feature a bucket."""
    size = len(source)
    share = (target + 1.0) * (float(source.sum()) + size) / ((source + 1.0) * (float(target.sum()) + size))
    return np.floor(1000 * np.log(share)).astype(np.int64)


def ranked(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (a written table) with rank: 1, 2, 3 ... by score, largest first, then by doc_id, smallest first, nulls last."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    placed = scratch.keep(rows.repartitionByRange(parts(rows.sparkSession), *order).withColumn("part", F.spark_partition_id()))
    # One row per partition: their number is the session's number of shuffle partitions.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy(*order)
    return placed.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.row_number().over(within)).drop("part", "before")


def importance_resample(docs: DataFrame, target: DataFrame, n: int = 3, buckets: int = 10_000, share: tuple[int, int] = (5, 100), min_words: int = 20,
                        seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_features, weight, score, rank (1, 2, 3 ... of the drawn documents, else null).

    Of the N documents with `min_words` words or more the floor(N * share[0] / share[1])
    of highest score are drawn; ties go to the smaller doc_id, null ids last.  A null text
    has no words: weight 0, never drawn.  A null id draws its noise as an empty one;
    rows of equal id and text have equal scores and take consecutive ranks.  Without a
    target text every bucket's target count is 0.  Other columns aren't read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "importance")
    kind = docs.schema[id_col].dataType.simpleString()
    # Every text is scanned once; what follows reads the buckets.
    found = scratch.keep(bucketed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")), n, buckets))
    wanted = bucketed(target.select(F.lit(0).alias("doc_id"), F.col(target_col).cast("binary").alias("text")), n, buckets)
    gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets))
    width = number_type(buckets)

    def weigh(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            held = [np.frombuffer(x.as_buffer(), width) for x in batch.column(2)]
            sums = [pa.array([len(x) for x in held], pa.int64()), pa.array([int(gain[x].sum()) for x in held], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sums], names=["doc_id", "n_words", "n_features", "weight"])

    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    weighed = scratch.keep(arrow_map(found, weigh, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint").withColumn("score", F.col("weight") + noise))
    scratch.free(found)
    able = weighed.where(F.col("n_words") >= min_words)
    drawn = able.count() * share[0] // share[1]
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = weighed.where(F.col("n_words") < min_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked(able.select(*columns), scratch).select(*columns, rank).union(rest)
