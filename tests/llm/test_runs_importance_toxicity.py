"""Periodic runs and importance resampling against brute force; the toxicity field against enumeration and held-out labels; awkward tables."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.llm import importance, periodic_runs, queries, toxicity

from . import brute
from .test_operators import ROWS, frame

CLASHING = "doc_id long, text string, runs string, collapsed int, score string, weight string, rank string, spans int, toxic string, part int"


def repeating(seed: int = 3) -> list[tuple[int, str | None]]:
    """Texts with runs of many periods: nested, touching, cut short, of one word, across white space of all kinds."""
    rng = random.Random(seed)
    rows: list[str | None] = [None, "", " \t\n", "a " * 11, "a " * 12, "a b " * 6, "a b c d e f g " * 2, "x " * 3000, ("a b " * 4 + "c ") * 5]
    for _ in range(60):
        out: list[str] = []
        for _ in range(rng.randrange(1, 5)):
            out += [f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 20))]
            unit = [f"u{rng.randrange(3)}" for _ in range(rng.randrange(1, 15))]
            out += (unit * rng.randrange(1, 6))[:rng.randrange(1, 60)]
        rows.append(rng.choice([" ", "\n", "  "]).join(out))
    return list(enumerate(rows))


@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4), st.sampled_from([2, 5, 12]))
@settings(max_examples=200, deadline=None)
def test_runs_of_codes(docs, least):
    codes = np.array([c for d in docs for c in d], np.int64)
    first = np.cumsum([0, *(len(d) for d in docs)])
    s, e, p = periodic_runs.runs_of(codes, first, least)
    got = [sorted((int(a - first[i]), int(b - a), int(q)) for a, b, q in zip(s, e, p, strict=True) if first[i] <= a < first[i + 1]) for i in range(len(docs))]
    assert got == [brute.runs([bytes([c]) for c in d], least) for d in docs]


def test_words_outside_repeated_kgrams_are_masked():
    codes = np.array([*range(100), *([200, 201, 202] * 6), *range(300, 400)], np.int64)
    start, end = periodic_runs.segments(codes, np.array([0, len(codes)]), 6, 12)
    assert list(zip(start.tolist(), end.tolist(), strict=True)) == [(100, 118)]


def test_pairs_are_compared_in_pieces(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PAIRS", 7)
    codes = np.array([1, 2, 3, 4, 5, 6, 7] * 9, np.int64)
    assert periodic_runs.runs_of(codes, np.array([0, len(codes)])).T.tolist() == [[0, 63, 7]]


def test_periodic_runs(spark):
    rows = ROWS[:60] + [(1000 + d, t) for d, t in repeating()]
    rows = [(d, t) for d, t in rows if len((t or "").split()) < 4000]
    docs = frame(spark, rows)
    found = {r["doc_id"]: r for r in periodic_runs.periodic_runs(docs).collect()}
    for d, t in rows:
        words = brute.WORD.findall((t or "").encode())
        want = brute.runs(words)
        assert sorted(map(tuple, found[d]["runs"])) == want and found[d]["collapsed"].encode() == brute.collapsed(words, want)
    planted = docs.select("doc_id", periodic_runs.planted(docs["doc_id"], docs["text"]).alias("text"))
    got = {r[0]: tuple(r)[1:] for r in periodic_runs.run_digests(periodic_runs.periodic_runs(planted)).collect()}
    assert got == {d: brute.periodic(d, t) for d, t in rows}


def test_runs_of_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(1, "a " * 12), (1, "a " * 12), (None, "a " * 12), (None, None)]
    docs = spark.createDataFrame([(d, t, "x", 1, "x", "x", "x", 1, "x", 1) for d, t in rows], CLASHING)
    got = periodic_runs.periodic_runs(docs).collect()
    assert sorted((r["doc_id"] or 0, len(r["runs"]), r["collapsed"]) for r in got) == [(0, 0, ""), (0, 1, "a"), (1, 1, "a"), (1, 1, "a")]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.run_digests(periodic_runs.periodic_runs(empty)).count() == 0


def test_importance(spark):
    rng = random.Random(4)
    rows = ROWS + [(5000 + i, " ".join(rng.choice("alpha beta gamma delta Éclair x1 2".split()) + str(rng.randrange(9)) for _ in range(rng.randrange(10, 40)))) for i in range(300)]
    target = ["alpha1 beta2 gamma3", None, "", "delta4 ALPHA1 beta2"]
    got = importance.importance_resample(frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == brute.importance(rows, target)


def test_bucket_states_equal_whole_features():
    words, found = importance.feature_buckets("The cat,the CAT é9".encode(), 3, 10_000)
    import zlib

    want = [f for n in (1, 2, 3) for f in (b" ".join([b"the", b"cat", b"the", b"cat", "é9".encode()][i:i + n]) for i in range(6 - n))]
    assert words == 5 and sorted(found.tolist()) == sorted(zlib.crc32(f) % 10_000 for f in want)


def test_importance_of_awkward_tables(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(7, text), (7, text), (None, text), (8, None), (9, ""), *((i, text) for i in range(100, 160))]
    docs = spark.createDataFrame([(d, t, "x", 1, "x", "x", "x", 1, "x", 1) for d, t in rows], CLASHING)
    none = spark.createDataFrame([], "text string, weight int")
    got = importance.importance_resample(docs, none, share=(50, 100)).collect()
    assert len(got) == len(rows) and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 32))
    order = [(r["score"], r["doc_id"]) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])]
    assert order == sorted(order, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
    assert all(r["n_features"] == 0 and r["weight"] == 0 for r in got if r["doc_id"] in (8, 9))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert importance.importance_resample(empty, none).count() == 0


@given(st.lists(st.floats(-3, 3), min_size=1, max_size=7), st.lists(st.floats(-2, 2), min_size=5, max_size=5), st.integers(0, 6))
@settings(max_examples=60, deadline=None)
def test_marginals_equal_enumeration(emit, weights, cut):
    emit, move, enter = np.array(emit), np.array(weights[:4]).reshape(2, 2), weights[4]
    begins = np.zeros(len(emit), bool)
    begins[0] = True
    begins[min(cut, len(emit) - 1)] = True
    mass = np.zeros((len(emit), 2))
    pairs = np.zeros((len(emit), 4))
    for tags in itertools.product((0, 1), repeat=len(emit)):
        total = sum(emit[i] * t + (enter * t if begins[i] else move[tags[i - 1], t]) for i, t in enumerate(tags))
        for i, t in enumerate(tags):
            mass[i, t] += np.exp(total)
            if not begins[i]:
                pairs[i, 2 * tags[i - 1] + t] += np.exp(total)
    chains = toxicity.forward_backward(emit, begins, move, enter)
    assert np.allclose(chains.odds, np.log(mass[:, 1] / mass[:, 0]), atol=1e-6)
    assert np.allclose(chains.joint, (pairs / np.maximum(pairs.sum(1, keepdims=True), 1e-300))[chains.inner], atol=1e-6)


def speech(n: int = 600, seed: int = 2) -> tuple[list[tuple[int, str]], dict[int, int]]:
    rng = random.Random(seed)
    rows, toxic = [], {}
    for d in range(n):
        words = ["".join(rng.choice(["ka", "lo", "mi", "ru", "té"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 80))]
        toxic[d] = int(d % 3 == 0)
        if toxic[d]:
            for _ in range(rng.randrange(2, 5)):
                words[rng.randrange(len(words))] = rng.choice(["Blorg", "zzinK", "zzinkung"])
        rows.append((d, " ".join(w + (". " if rng.random() < 0.1 else "") for w in words)))
    return rows, toxic


def test_toxicity_of_held_out_documents(spark):
    rows, toxic = speech()
    labels = spark.createDataFrame([(d, 1, t) for d, t in toxic.items()], "doc_id long, quality int, toxic int")
    extra = [(9000, None), (9001, ""), (9002, "Zzinkenfoo karu. mika"), (None, "blorg"), (9003, "!?"), (9004, "ka " * 30_000 + "blorg")]
    got = toxicity.toxicity(frame(spark, rows + extra), labels).collect()
    seen = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) + len(extra) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in toxic]
    assert len(held) > 100 and sum(r["predicted"] == toxic[r["doc_id"]] for r in held) >= 0.99 * len(held)
    assert [seen[d]["predicted"] for d in (9000, 9001, 9002, None, 9003, 9004)] == [0, 0, 1, 1, 0, 1]
    assert [(s["start"], s["end"]) for s in seen[9002]["spans"]] == [(0, 10)] and [(s["start"], s["end"]) for s in seen[9004]["spans"]] == [(90_000, 90_005)]
    text = dict(rows)
    named = [text[r["doc_id"]][s["start"]:s["end"]].lower() for r in got if r["doc_id"] in toxic for s in r["spans"]]
    assert len(named) > 300 and {w for x in named for w in x.split()} <= {"blorg", "zzink", "zzinkung"}


def test_toxicity_learns_from_no_held_out_label(spark):
    rows, toxic = speech(300)
    labels = spark.createDataFrame([(d, t) for d, t in toxic.items()], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    docs = frame(spark, rows)
    score = [{r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, x).collect()} for x in (labels, turned)]
    assert score[0] == score[1]


def test_toxicity_of_awkward_tables(spark):
    docs = spark.createDataFrame([(d, "blorg", "x", 1, "x", "x", "x", 1, "x", 1) for d in (1, 1, None)], CLASHING)
    none = spark.createDataFrame([], "doc_id long, toxic int, text string")
    assert [(r["score"] < 0.01, r["predicted"], r["spans"]) for r in toxicity.toxicity(docs, none).collect()] == [(True, 0, [])] * 3
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (3, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels).count() == 3
    assert toxicity.toxicity(spark.createDataFrame([], "doc_id long, text string"), labels).count() == 0


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_importance_resampling", "op13_toxicity"])
def test_queries_return_every_document(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    want = {
        "op11_periodic_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
        "op12_importance_resampling": ["doc_id", "n_features", "weight", "score", "rank"],
        "op13_toxicity": ["doc_id", "held_out", "score", "predicted", "n_spans"],
    }[name]
    assert df.columns == want and df.count() == queries.documents(spark, sf).count()
    kinds = dict(df.dtypes)
    assert all(kinds[c] == "bigint" for c in ("n_runs", "start", "length", "period", "exponent_milli", "n_features", "weight", "rank") if c in kinds)
