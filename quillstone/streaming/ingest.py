"""Streaming forms of the ingest log: incremental embedding, windows with late data, latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillstone.operators.manifest import embedding_plan


def read_log(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def once_per_content(docs: DataFrame, time: str = "ts", late: str = "1 day") -> DataFrame:
    """Each content once; state older than the watermark is dropped."""
    return docs.withColumn("content_sha1", F.sha1(F.coalesce("text", F.lit("")))).withWatermark(time, late).dropDuplicatesWithinWatermark(["content_sha1"])


def embed_new(docs: DataFrame, store: str, model: str, checkpoint: str) -> StreamingQuery:
    """Append to the store, batch by batch, the documents it lacks; a batch that is run again adds nothing twice."""
    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows = rows.dropDuplicates(["doc_id", "content_sha1"])
        done = spark.table(store) if spark.catalog.tableExists(store) else rows.limit(0).withColumn("embedding_model", F.lit(model))
        new = embedding_plan(rows, done.select("doc_id", "content_sha1", "embedding_model"), model)
        new.select("doc_id", "content_sha1", F.lit(model).alias("embedding_model"), "embedding_plan_status").write.mode("append").saveAsTable(store)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 hour", time: str = "ts", key: str = "event_type") -> DataFrame:
    """Counts and sums per key and window; windows close when the watermark passes them."""
    w = F.window(F.col(time), width, slide) if slide else F.window(F.col(time), width)
    return events.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour", time: str = "ts", key: str = "user_id") -> DataFrame:
    """Sessions of each key that end after a quiet gap."""
    return events.withWatermark(time, late).groupBy(F.session_window(F.col(time), gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there into an in-memory table, for tests and previews."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
