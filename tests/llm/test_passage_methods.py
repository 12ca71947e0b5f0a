"""Removed passages come from the automaton and the longest-previous-factor array; odd ids and large groups."""

from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import passages, substring_dedup, suffix_dedup

from . import brute
from .test_operators import ROWS, frame, passage


@given(st.lists(st.tuples(st.binary(min_size=1, max_size=40), st.integers(0, 3)), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_longest_previous_factors(texts):
    most = 16
    blob, start, owner = b"", [], []
    for text, rank in texts:
        start += range(len(blob), len(blob) + len(text))
        owner += [rank] * len(text)
        blob += text + bytes(most)  # matches may run into the padding, which is alike for all
    got = suffix_dedup.longest_previous(np.frombuffer(blob, np.uint8), np.array(start), np.array(owner), most)

    def match(a: int, b: int) -> int:
        return next((k for k in range(most) if blob[a + k:a + k + 1] != blob[b + k:b + k + 1]), most)

    want = [max((match(a, b) for b, r in zip(start, owner, strict=True) if r < own), default=0) for a, own in zip(start, owner, strict=True)]
    assert got.tolist() == want


def many_contexts() -> list[tuple[int, str]]:
    """A passage of 40 words in 300 documents, each with words of its own around it, and plain copies."""
    rng = random.Random(6)
    shared = passage(rng, 40)
    rows = [f"{passage(rng, 12)} {shared} {passage(rng, 12)}" for _ in range(300)]
    return list(enumerate([*rows, *rows[:50], rows[0], rows[0]]))


def test_a_group_far_over_the_bound_is_judged_by_windows(spark, monkeypatch):
    monkeypatch.setattr(passages, "FREQUENT", 8)
    rows = many_contexts()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()} == {
        d: x[:2] for d, x in brute.substring(rows).items()}
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect()} == {
        d: x[:3] for d, x in brute.suffix(rows).items()}


def test_nothing_goes_that_the_resolver_does_not_flag(spark, monkeypatch):
    def none(group, spec):
        return (np.zeros(int(group.n.sum()), bool),) * 2

    found = passages.removals(frame(spark), passages.Spec(True, 35, 8), False, none, "t", "doc_id", "text")
    assert not any(r["data"] for r in found.collect())
    found = passages.removals(frame(spark), passages.Spec(False, 50, 16), True, none, "t", "doc_id", "text")
    assert not any(r["data"] for r in found.collect())


def test_string_ids_keep_their_order(spark):
    rows = [(f"k{i:03d}", t) for i, (_, t) in enumerate(sorted(ROWS))] + [(None, ROWS[3][1]), (None, "free " * 60)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    number = {k: i for i, (k, _) in enumerate(rows)}
    got = {number[r["doc_id"]]: r["n_removed"] for r in suffix_dedup.suffix_dedup(docs).collect() if r["doc_id"]}
    want = brute.suffix([(i, t) for i, (k, t) in enumerate(rows) if k])
    assert got == {i: want[i][1] for i in got} and len(got) == len(ROWS)
    whole = substring_dedup.substring_dedup(docs).collect()
    assert sum(r["n_removed"] for r in whole) == sum(x[1] for x in brute.substring(list(enumerate(t for _, t in rows))).values())
