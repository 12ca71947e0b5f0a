"""Variant metadata: malformed and nested JSON, overlay, member kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import metadata

ROWS = [(1, '{"a": 1, "b": {"c": [10, "x"]}, "it\'s": "q"}', ""), (2, '{"a": "t"', "own"), (3, None, None), (4, "[1, 2]", ""), (5, '"text"', ""), (6, '{"name": "told", "a": null}', None), (7, "{}", "own")]


def test_fields_of_any_shape(spark):
    df = spark.createDataFrame(ROWS, "id int, m string, name string").select("id", metadata.metadata(F.col("m")).alias("v"))
    got = {r["id"]: r for r in df.select("id", metadata.field(F.col("v"), "$.a", "int").alias("a"), metadata.field(F.col("v"), "$.b.c[1]").alias("c"), metadata.field(F.col("v"), "$.b").alias("b"),
                                         metadata.member(F.col("v"), "it's").alias("q")).collect()}
    assert (got[1]["a"], got[1]["c"], got[1]["b"], got[1]["q"]) == (1, "x", '{"c":[10,"x"]}', "q")
    assert all(got[i]["a"] is None and got[i]["c"] is None for i in range(2, 8))


def test_overlay(spark):
    rows = spark.createDataFrame(ROWS, "id int, m string, name string")
    got = {r["id"]: (r["name"], r["a"]) for r in metadata.overlaid(rows, "m", ["name", "a"]).collect()}
    assert got == {1: (None, "1"), 2: ("own", None), 3: (None, None), 4: (None, None), 5: (None, None), 6: ("told", None), 7: ("own", None)}


def test_members(spark):
    got = {(r["name"], r["kind"], r["n"]) for r in metadata.members(spark.createDataFrame(ROWS, "id int, m string, name string"), "m").collect()}
    assert ("a", "BIGINT", 1) in got and ("name", "STRING", 1) in got and ("a", "VOID", 1) in got
    assert any(n == "b" and k.startswith("OBJECT") for n, k, _ in got)
