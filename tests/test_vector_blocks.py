"""Vector search for more queries than one block holds."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.operators import search

from .test_profiles import most_rows


def test_more_queries_than_a_block(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id % 2 = 0").selectExpr("vec_id AS query_id", "embedding AS query_vector")

    def found():
        return sorted(map(tuple, search.vector_topk_join(vectors, queries, 3).collect()))

    whole = found()
    assert len(whole) == 90
    monkeypatch.setattr(search, "QUERY_ROWS", 8)
    assert found() == whole


def test_products_of_odd_vectors_and_ties(spark):
    """Scores that round alike, halves, repeated vectors, null and broken ones: the rows of a row-by-row account."""
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 0.0078125, -0.0078125, 0.5, 1.0, rng.random()]) for _ in range(4)]) for i in range(300)]
    rows += [(1000 + i, list(rows[i % 7][1])) for i in range(60)] + [(2000, None), (2001, [1.0]), (2002, [float("nan"), 1.0, 0.0, 0.0]), (2003, [1.0, None, 0.0, 0.0]), (2004, [float("inf"), 0.0, 0.0, 0.0]), (None, [9.0, 9.0, 9.0, 9.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", v) for i, v in rows[:40]] + [("odd", [1.0, 2.0]), ("none", None), ("q0", rows[0][1])], "query_id string, query_vector array<float>")
    for k in (1, 7, 400):
        scores = vectors.crossJoin(queries).withColumn("score", F.round(search.inner_product(F.col("embedding"), F.col("query_vector")), 6))
        ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        got = search.vector_topk_join(vectors, queries, k)
        assert got.columns == ["query_id", "vec_id", "score", "rank"]
        columns = ["query_id", F.col("score").cast("string"), "rank"] if k < 400 else ["query_id", "vec_id", F.col("score").cast("string")]
        assert sorted(map(str, got.where("query_id <> 'q0'").select(*columns, "vec_id").collect())) == sorted(map(str, ranked.where("query_id <> 'q0'").select(*columns, "vec_id").collect()))


def test_a_task_hands_on_its_best_only(spark):
    """Scores aren't rows: no step of the plan gives more than k rows a query and task."""
    vectors = spark.range(4000).selectExpr("id AS vec_id", "array(float(id % 97), float(id % 89)) AS embedding").repartition(2)
    found = search.vector_topk_join(vectors, vectors.where("vec_id % 8 = 0").selectExpr("vec_id AS query_id", "embedding AS query_vector"), 3)
    assert found.count() == 1500
    rows = found.collect()
    assert len(rows) == 1500 and most_rows(found) <= 4000
