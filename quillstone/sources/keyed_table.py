"""A table of rows with an id, in hash buckets that are rewritten only where they change, behind one pointer.

A version is a small file that names each bucket's folder.  An upsert or delete writes
new folders for the buckets it touches, then puts the next version's file in place by
a rename that fails if another writer was first.  Until that rename readers see the
old version whole; a write that dies before it leaves folders that nothing names,
which `vacuum` removes.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has put the next version in place; nothing was changed and the call can be repeated."""


class KeyedTable(NamedTuple):
    """Where the table lies (a folder that all executors share), its id column and its number of buckets."""

    path: str
    id_col: str
    buckets: int


class Version(NamedTuple):
    """A version's number, its rows' schema and each bucket's folder; buckets without rows may lack one."""

    number: int
    schema: StructType
    folders: dict[int, str]


def bucket_of(table: KeyedTable) -> Column:
    return F.pmod(F.xxhash64(F.col(table.id_col)), F.lit(table.buckets)).cast("int")


def file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's path and the file system it lies in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    at, fs = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def current(spark: SparkSession, table: KeyedTable) -> Version:
    """The latest version."""
    numbers = [int(n.removesuffix(".json")) for n in names_in(spark, f"{table.path}/versions") if n.endswith(".json")]
    if not numbers:
        raise FileNotFoundError(f"no table in {table.path}")
    told = json.loads(spark.read.text(f"{table.path}/versions/{max(numbers):012d}.json", wholetext=True).first()[0])
    return Version(max(numbers), StructType.fromJson(told["schema"]), {int(b): f for b, f in told["folders"].items()})


def put_version(spark: SparkSession, table: KeyedTable, version: Version) -> None:
    """Put a version's file in place, or raise Conflict if its number is taken."""
    text = json.dumps({"schema": version.schema.jsonValue(), "folders": version.folders})
    at, fs = file_system(spark, f"{table.path}/versions/.{uuid.uuid4().hex}")
    out = fs.create(at, False)
    out.write(text.encode())
    out.close()
    jvm = spark._jvm
    end = jvm.org.apache.hadoop.fs.Path(f"{table.path}/versions/{version.number:012d}.json")
    how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    how[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(at, end, how)
    except Py4JJavaError as e:
        fs.delete(at, False)
        if "FileAlreadyExists" in str(e.java_exception):
            raise Conflict(f"version {version.number} exists") from e
        raise


def create(spark: SparkSession, path: str, schema: StructType, id_col: str = "id", buckets: int = 64) -> KeyedTable:
    """A new, empty table."""
    table = KeyedTable(path.rstrip("/"), id_col, buckets)
    put_version(spark, table, Version(0, schema, {}))
    return table


def rows_of(spark: SparkSession, version: Version, buckets: list[int] | None = None) -> DataFrame:
    """A version's rows, or those of some buckets only."""
    folders = [f for b, f in version.folders.items() if buckets is None or b in buckets]
    return spark.read.schema(version.schema).parquet(*folders) if folders else spark.createDataFrame([], version.schema)


def read(spark: SparkSession, table: KeyedTable) -> DataFrame:
    """The latest version's rows; later writes don't change what this reads until `vacuum` removes it."""
    return rows_of(spark, current(spark, table))


def rewrite(spark: SparkSession, table: KeyedTable, version: Version, rows: DataFrame, touched: list[int], folder: str) -> None:
    """Write rows (all rows of the touched buckets) and make them the next version."""
    rows.withColumn("bucket", bucket_of(table)).repartition("bucket").write.partitionBy("bucket").parquet(folder)
    written = {int(n.partition("=")[2]) for n in names_in(spark, folder) if n.startswith("bucket=")}
    kept = {b: f for b, f in version.folders.items() if b not in touched}
    put_version(spark, table, version._replace(number=version.number + 1, folders=kept | {b: f"{folder}/bucket={b}" for b in written}))


def stage(table: KeyedTable, rows: DataFrame) -> tuple[DataFrame, list[int], str]:
    """rows written once beside the table, the buckets they touch, and a folder for the new rows."""
    folder = f"{table.path}/data/{uuid.uuid4().hex}"
    rows.withColumn("bucket", bucket_of(table)).write.parquet(f"{folder}-staged")
    staged = rows.sparkSession.read.parquet(f"{folder}-staged")
    # At most one row a bucket comes to the driver.
    return staged.drop("bucket"), sorted(r[0] for r in staged.select("bucket").distinct().collect()), folder


def upsert(table: KeyedTable, rows: DataFrame) -> int:
    """Put rows in place of those of the same id; returns the new version's number.  Of several rows of one id the largest one stays; null ids are refused."""
    spark = rows.sparkSession
    version = current(spark, table)
    if rows.where(F.col(table.id_col).isNull()).limit(1).count():
        raise ValueError("rows without an id")
    whole = rows.select(*version.schema.fieldNames())
    single = whole.groupBy(table.id_col).agg(F.max(F.struct(*whole.columns)).alias("r")).select("r.*")
    staged, touched, folder = stage(table, single)
    if not touched:
        return version.number
    old = rows_of(spark, version, touched).join(staged.select(table.id_col), table.id_col, "left_anti")
    rewrite(spark, table, version, old.select(*whole.columns).unionByName(staged), touched, folder)
    return version.number + 1


def delete(table: KeyedTable, ids: DataFrame) -> DataFrame:
    """Take ids out; (id, status) of each distinct id, verified on the new version: deleted, already_missing or failed."""
    spark = ids.sparkSession
    version = current(spark, table)
    key = table.id_col
    asked, touched, folder = stage(table, ids.where(F.col(key).isNotNull()).select(key).distinct())
    before = rows_of(spark, version, touched)
    if touched:
        rewrite(spark, table, version, before.join(asked, key, "left_anti").select(*version.schema.fieldNames()), touched, folder)
    after = rows_of(spark, current(spark, table), touched)
    was, still = (df.select(key, F.lit(True).alias(c)) for df, c in ((before, "was"), (after, "still")))
    told = asked.join(was, key, "left").join(still, key, "left")
    return told.select(key, F.when(F.col("still"), "failed").when(F.col("was"), "deleted").otherwise("already_missing").alias("status"))


def vacuum(spark: SparkSession, table: KeyedTable, keep: int = 2) -> int:
    """Remove the folders that none of the `keep` latest versions names, and older versions; returns how many folders went.  No write may be under way."""
    numbers = sorted(int(n.removesuffix(".json")) for n in names_in(spark, f"{table.path}/versions") if n.endswith(".json"))
    live = set()
    for n in numbers[-keep:]:
        told = json.loads(spark.read.text(f"{table.path}/versions/{n:012d}.json", wholetext=True).first()[0])
        live |= {f.rsplit("/", 2)[1] for f in told["folders"].values()}
    for n in numbers[:-keep]:
        at, fs = file_system(spark, f"{table.path}/versions/{n:012d}.json")
        fs.delete(at, False)
    gone = [n for n in names_in(spark, f"{table.path}/data") if n not in live]
    for n in gone:
        at, fs = file_system(spark, f"{table.path}/data/{n}")
        fs.delete(at, True)
    return len(gone)
