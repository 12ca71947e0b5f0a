"""Joins with a table that has one row a key, safe where a few keys hold much of the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds over 1 / SHARE of the rows, so fewer than SHARE keys are.
SHARE = 2000
#: Rows of a few numbers each that are broadcast as counted; beyond it rows are shuffled.
SMALL = 100_000


def small(table: DataFrame, most: int = SMALL) -> bool:
    """Whether a written table has at most `most` rows."""
    return table.limit(most + 1).count() <= most


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with table (one row a key, written already) on key, inner or left.

    A small table is broadcast.  Else rows of hot keys stay where they are and get those keys' rows of the table, fewer
    than SHARE, by broadcast; only the other rows are shuffled.  Null keys aren't hot.
    """
    if small(table):
        return rows.join(F.broadcast(table), key, how)
    count = rows.groupBy(key).agg(F.count("*").alias("n"))
    hot = count.join(F.broadcast(rows.agg(F.count("*").alias("rows"))), F.col("n") * SHARE > F.col("rows")).select(key).collect()
    if not hot:
        return rows.join(table, key, how)
    keys = F.broadcast(rows.sparkSession.createDataFrame(hot, rows.select(key).schema))
    known = F.broadcast(table.join(keys, key, "left_semi"))
    return rows.join(keys, key, "left_semi").join(known, key, how).unionByName(rows.join(keys, key, "left_anti").join(table, key, how))


def without(rows: DataFrame, gone: DataFrame, keys: dict[str, F.Column], most: int = SMALL) -> DataFrame:
    """rows whose keys (columns of gone by name; values of rows) aren't in gone, a written table; nulls are equal.

    Up to `most` rows of gone are broadcast, so the rows aren't shuffled; beyond it Spark chooses the join.
    """
    right = gone.select(*(F.col(k).alias(f"gone_{k}") for k in keys)).distinct()
    if small(gone, most):
        right = F.broadcast(right)
    match = [value.eqNullSafe(right[f"gone_{k}"]) for k, value in keys.items()]
    on = match[0]
    for m in match[1:]:
        on = on & m
    return rows.join(right, on, "left_anti")
