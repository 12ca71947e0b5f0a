"""Tables written in the shared folder that cuts lineage between steps.

The folder is the one the cluster names in ``spark.checkpoint.dir``; every
executor and the driver can read it, so losing an executor loses no table.
Only a local-mode session without that setting gets a folder of its own.
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, or a local one for local-mode tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file:{tempfile.gettempdir()}/quillstone-shared"


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """While a table is written, Arrow batches of long texts stay small in both the JVM and Python."""
    before = spark.conf.get(ARROW_BYTES)
    spark.conf.set(ARROW_BYTES, size)
    try:
        yield
    finally:
        spark.conf.set(ARROW_BYTES, before)


class Scratch:
    """Written tables of one operator call; ``free`` removes those no longer read."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.base = f"{shared_root(spark)}/quillstone-{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: set[str] = set()

    def keep(self, df: DataFrame, batch: str = "8m") -> DataFrame:
        """Write df as Parquet in the shared folder, in Arrow batches of `batch`, and return the table read back."""
        path = f"{self.base}/{self.count}"
        self.count += 1
        with small_batches(self.spark, batch):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.add(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def free(self, *tables: DataFrame) -> None:
        """Delete tables whose readers have all been written."""
        self.delete({t._scratch_path for t in tables})

    def only(self, *tables: DataFrame) -> None:
        """Delete all tables written here but these, which nothing unwritten reads."""
        self.delete(self.paths - {t._scratch_path for t in tables})

    def delete(self, paths: set[str]) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
        self.paths -= paths

    def settle(self) -> None:
        """Shuffle files of finished steps go when the driver's references to them are collected."""
        for _ in range(2):  # the second pass finds what the first one has made unreachable
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.2)


def parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
