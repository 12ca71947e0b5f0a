"""Registered queries: each takes (spark, sf_dir); SQL is what DuckDB answers with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a file that are worth a task of their own.
TASK_BYTES = 2 << 20


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose texts are costly to read: dealt out over the cores if its files give fewer tasks than they are worth.

    Tables of many splits are read as they are, without a shuffle.
    """
    df = table(spark, sf_dir, name)
    plan = df._jdf.queryExecution()
    worth = min(spark.sparkContext.defaultParallelism, int(str(plan.optimizedPlan().stats().sizeInBytes())) // TASK_BYTES)
    return df.repartition(worth) if worth > plan.toRdd().getNumPartitions() else df
