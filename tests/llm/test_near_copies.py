"""The near stage against brute-force similarity of five-word shingles."""

from __future__ import annotations

import random
import re

import pytest

import corpus_pipeline as cp
from quillstone.llm.near_copies import near_copies

from . import brute
from .test_operators import ROWS, frame


def shingles(text: str | None) -> set[bytes]:
    words = brute.WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def groups(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {d: x if r == y else r for d, r in root.items()}
    return root


def edited() -> list[tuple[int, str | None]]:
    """Chains of copies with a few words changed, texts that only share a line, and the awkward rows."""
    rng = random.Random(8)
    line = " ".join(f"line{i}" for i in range(12))
    rows = [t for _, t in ROWS]
    for n in (6, 30, 100, 400):
        for _ in range(12):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            rows.append(" ".join([*words, line] if n > 50 else words))
            for _ in range(4):
                for _ in range(max(1, n // rng.choice((25, 50, 100)))):
                    words[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
                rows.append(" ".join(words))
    return list(enumerate(rows))


def test_near_copies_miss_no_pair(spark):
    rows = edited()
    want = groups(rows)
    assert 20 < len(rows) - len(set(want.values()))
    got = {r["doc_id"]: r["component_id"] for r in near_copies(frame(spark, rows)).collect()}
    assert got == want


def test_pipeline_stage_drops_a_copy_with_one_changed_word(spark):
    rows = edited()
    want = groups(rows)
    got = dict(cp.STAGES)["near dedup"](spark, frame(spark, rows), "")
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(want.values()))


def copies(n: int, seed: int, size: int = 200) -> list[str]:
    """Texts of which each has one other word changed, so that any two are near copies."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    return [" ".join([*base[:i * 7 % size], f"x{i}", *base[i * 7 % size + 1:]]) for i in range(n)]


def unrelated(n: int, seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    return [" ".join(f"u{rng.randrange(10**7)}" for _ in range(30)) for _ in range(n)]


@pytest.mark.parametrize("texts", [copies(2, 1), unrelated(500) + copies(6, 4), copies(60, 5) + copies(60, 6)], ids=["two", "500 and six", "two groups"])
def test_few_rows_and_tasks_without_a_pair_to_list(spark, texts):
    rows = list(enumerate(texts))
    assert {r["doc_id"]: r["component_id"] for r in near_copies(frame(spark, rows)).collect()} == groups(rows)


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    a, b, c = copies(3, 7)
    rows = [(5, a), (5, a), (None, b), (9, c), (None, None), (12, ""), (13, None)]
    docs = spark.createDataFrame([(d, t, 1, "x", 2, 3) for d, t in rows], "doc_id long, text string, component_id int, cls string, text_hash int, root int")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in near_copies(docs).collect())
    assert got == [(0, 5), (0, 12), (5, 5), (5, 5), (9, 5), (12, 12), (13, 12)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_copies(empty).count() == 0
