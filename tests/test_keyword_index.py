"""The inverted index against a full BM25 scan: same rows, appended and removed documents, blocks passed over, awkward rows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quillstone.operators import keyword_index, search
from quillstone.operators.durable import new_folder

DOCS, ASKED = "doc_id long, text string", "query_id long, query_text string"


def texts(n: int, seed: int = 5) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    share = [1 / (i + 1) for i in range(300)]
    return [(i, " ".join(rng.choices(words, share, k=rng.randrange(1, 60)))) for i in range(n)]


QUERIES = [(1, "w0 w1 w2"), (2, "w17 W40 w200"), (3, "w5 w5 nothing"), (4, "absent"), (5, ""), (6, None), (7, "w0"), (8, " ".join(f"w{i}" for i in range(0, 300, 7)))]


def rows(df) -> list[tuple]:
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 5)) for r in df.collect())


@pytest.fixture(scope="module")
def small_segments():
    before = keyword_index.SEGMENT
    keyword_index.SEGMENT = 150
    yield
    keyword_index.SEGMENT = before


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(QUERIES, ASKED)


@pytest.mark.parametrize("all_terms", [False, True])
def test_same_rows_as_a_scan(spark, asked, small_segments, all_terms):
    docs = spark.createDataFrame([*texts(1000), (5000, None), (5001, ""), (5002, "中文检索 w3")], DOCS)
    index = keyword_index.build_keyword_index(docs, new_folder(spark, "words"))
    assert index.documents(spark).select("segment").distinct().count() == 7
    more = asked.union(spark.createDataFrame([(9, "文检")], ASKED))
    want = rows(search.keyword_bm25(docs, more, 10, all_terms=all_terms))
    assert rows(keyword_index.keyword_topk(index, more, 10, all_terms)) == want


def test_appended_and_removed_documents(spark, asked, small_segments):
    first, second = texts(600), [(i + 600, t) for i, t in texts(300, 6)]
    index = keyword_index.build_keyword_index(spark.createDataFrame(first, DOCS), new_folder(spark, "words"))
    keyword_index.append_documents(index, spark.createDataFrame(second, DOCS))
    now = dict(first + second)
    assert rows(keyword_index.keyword_topk(index, asked, 10)) == rows(search.keyword_bm25(spark.createDataFrame(list(now.items()), DOCS), asked, 10))
    # Replace some documents, among them the best of a query, and drop others.
    best = [r[2] for r in rows(keyword_index.keyword_topk(index, asked, 10)) if r[1] == 1]
    gone = {*best, *range(0, 900, 9)}
    keyword_index.remove_documents(index, spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    changed = {i: "w0 w1 w2 w0" for i in best}
    keyword_index.append_documents(index, spark.createDataFrame(list(changed.items()), DOCS))
    now = {i: t for i, t in now.items() if i not in gone} | changed
    want = rows(search.keyword_bm25(spark.createDataFrame(list(now.items()), DOCS), asked, 10))
    assert rows(keyword_index.keyword_topk(index, asked, 10)) == want
    # Taking out what is gone already changes nothing.
    keyword_index.remove_documents(index, spark.createDataFrame([(i,) for i in gone - set(best)], "doc_id long"))
    assert rows(keyword_index.keyword_topk(index, asked, 10)) == want


def test_a_search_reads_its_own_words_only(spark, small_segments):
    index = keyword_index.build_keyword_index(spark.createDataFrame(texts(300), DOCS), new_folder(spark, "words"))
    plan = keyword_index.keyword_topk(index, spark.createDataFrame([(1, "w7 w8")], ASKED), 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan and "PushedFilters: [In(term, [w7,w8])]" in plan
    assert "text" not in plan


def test_blocks_that_cannot_reach_the_kth_score_are_passed_over():
    n = 6400
    docs = np.arange(n)
    tf = np.where(docs < 200, 9, 1)
    size = np.full(n, 50)
    cuts = np.arange(0, n + 1, 100)
    heads = cuts[:-1]
    x = keyword_index.Lists(docs, tf, size, np.arange(64), cuts, np.maximum.reduceat(tf, heads), np.minimum.reduceat(size, heads))
    y = keyword_index.Lists(docs[::3], tf[::3], size[::3], np.arange(64), np.searchsorted(docs[::3], cuts), x.most, x.shortest)
    found, score, read = keyword_index.best_of_segment([(1.0, x), (2.0, y)], n, 10, 1, 50.0, 1.2, 0.75)
    full = 1.0 * keyword_index.weight(tf, size, 50.0, 1.2, 0.75)
    full[::3] += 2.0 * keyword_index.weight(tf[::3], size[::3], 50.0, 1.2, 0.75)
    assert set(np.argsort(-full, kind="stable")[:10]) <= set(found) and np.allclose(score, full[found])
    assert read < 0.3 * (len(x.docs) + len(y.docs))


def test_awkward_tables(spark, asked):
    empty = spark.createDataFrame([], DOCS)
    index = keyword_index.build_keyword_index(empty, new_folder(spark, "words"))
    assert keyword_index.keyword_topk(index, asked, 5).count() == 0
    docs = spark.createDataFrame([("a", "x y", 1), (None, "x", 2), ("b", "x x x", 3)], "doc_id string, text string, segment int")
    index = keyword_index.build_keyword_index(docs, new_folder(spark, "words"))
    got = keyword_index.keyword_topk(index, spark.createDataFrame([("q", "x")], "query_id string, query_text string"), 5).orderBy("rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in got] == [("q", "b"), ("q", "a")]
    assert keyword_index.keyword_topk(index, spark.createDataFrame([], ASKED), 5).count() == 0
