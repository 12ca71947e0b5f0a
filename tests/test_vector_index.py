"""The inverted-file index against exact search: recall, exactness, pruning, appended rows, awkward rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import search, vector_index
from quillstone.operators.durable import new_folder
from quillstone.plans import retrieval

SCHEMA = "vec_id long, embedding array<float>"


def rows(n: int, dim: int, clusters: int, seed: int = 1) -> list[tuple[int, list[float]]]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    x = centres[rng.integers(0, clusters, n)] + 0.15 * rng.normal(size=(n, dim))
    return [(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]


def asked(vectors, step: int = 50):
    return vectors.where(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def found(df) -> dict[tuple, float]:
    return {(r["query_id"], r["vec_id"]): (r["rank"], round(r["score"], 5)) for r in df.collect()}


@pytest.fixture(scope="module")
def clustered(spark):
    vectors = spark.createDataFrame(rows(4000, 24, 60), SCHEMA).repartition(3)
    return vectors, vector_index.build_index(vectors, new_folder(spark, "vectors"), lists=100, subspaces=8)


def test_exact_search_loses_nothing(clustered):
    vectors, index = clustered
    want = found(search.vector_topk_join(vectors, asked(vectors), 30))
    assert found(vector_index.index_topk(index, asked(vectors), 30, exact=True)) == want
    # Whatever the first pass finds only sets the threshold.
    assert found(vector_index.index_topk(index, asked(vectors), 30, probes=1, exact=True, refine=1)) == want


def test_recall_of_tuned_probes(clustered):
    vectors, index = clustered
    probes = vector_index.tuned_probes(index, asked(vectors), 30)
    assert probes <= len(index.centroids) // 2
    want = found(search.vector_topk_join(vectors, asked(vectors), 30)).keys()
    got = found(vector_index.index_topk(index, asked(vectors), 30, probes)).keys()
    assert len(got & want) >= 0.9 * len(want)


def test_recall_on_the_sample_table(spark, sf):
    want = found(retrieval.vector_topk_by_example(spark, sf)).keys()
    got = found(retrieval.vector_index_probe(spark, sf)).keys()
    assert len(got & want) >= 0.9 * len(want)


def test_bound_rules_lists_out(spark, clustered):
    vectors, index = clustered
    one = asked(vectors).where("query_id = 0")
    q = np.array(one.first()["query_vector"], float)[None]
    least = np.array([min(r["score"] for r in vector_index.index_topk(index, one, 10, exact=True).collect())])
    visits = vector_index.reaching(index, spark, q, least)
    assert 0 < len(visits) < len(index.centroids) // 3
    plan = vector_index.beyond(index, spark, q, least)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan


def test_appended_rows_and_a_reopened_index(spark, clustered):
    vectors, _ = clustered
    path = new_folder(spark, "vectors")
    vector_index.build_index(vectors.where("vec_id < 2500"), path, subspaces=8)
    index = vector_index.open_index(spark, path)
    vector_index.append_vectors(index, vectors.where("vec_id >= 2500"))
    assert found(vector_index.index_topk(index, asked(vectors), 30, exact=True)) == found(search.vector_topk_join(vectors, asked(vectors), 30))


def test_awkward_rows(spark):
    good = rows(300, 8, 5)
    same = good[0][1]
    odd = [(1000 + i, same) for i in range(200)] + [(None, same), (2000, None), (2001, [1.0, 2.0]), (2002, [None] * 8), (2003, same), (2003, same)]
    vectors = spark.createDataFrame(good + odd, SCHEMA)
    index = vector_index.build_index(vectors, new_folder(spark, "vectors"), subspaces=3)
    assert index.rows(spark).count() == 300 + 202
    got = vector_index.index_topk(index, asked(vectors).where("query_id = 0"), 10, exact=True).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, *range(1000, 1009)]
    none = asked(vectors).where("query_id = 2000")
    assert vector_index.index_topk(index, none, 10).count() == 0


def test_empty_table_and_text_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    index = vector_index.build_index(empty, new_folder(spark, "vectors"))
    assert vector_index.index_topk(index, spark.createDataFrame([(1, [1.0])], "query_id long, query_vector array<double>"), 5, exact=True).count() == 0
    named = spark.createDataFrame([(f"d{i}", v) for i, v in rows(100, 8, 3)], "vec_id string, embedding array<float>")
    index = vector_index.build_index(named, new_folder(spark, "vectors"))
    query = named.where("vec_id = 'd7'").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    assert vector_index.index_topk(index, query, 3, probes=99).where("rank = 1").first()["vec_id"] == "d7"
