"""Shards of the block trees and their second level, hot fingerprints and hot roots, against brute force."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillstone.llm import simhash, skew
from quillstone.llm.components import components
from quillstone.llm.scratch import Scratch

from . import brute
from .test_operators import ROWS, frame


def clustered(rng: np.random.Generator) -> np.ndarray:
    """Distinct fingerprints: random ones, close ones, and many that agree on one block."""
    base = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (3, 300), dtype=np.uint64)
    same_block = (rng.integers(0, 1 << 64, 3000, dtype=np.uint64) & ~np.uint64(simhash.blocks(2)[0])) | np.uint64(0x15555)
    return np.unique(np.concatenate([base, base ^ flips[0], base ^ flips[0] ^ flips[1], base ^ flips[0] ^ flips[2], same_block, same_block[:500] ^ flips[0, 0] ^ flips[1, 1]]))


def test_blocks_cover_the_word():
    for reach in range(4):
        masks = simhash.blocks(reach)
        assert sum(masks) == (1 << 64) - 1 and len(masks) == reach + 1


def test_close_links_lose_no_component(spark):
    points = clustered(np.random.default_rng(3))
    want = np.arange(len(points))
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2)
    simhash.merge(want, i, j)
    classes = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    scratch = Scratch(spark, "t")
    for size in (100_000, 100):  # one shard; many, the shared block's cut again
        edges = simhash.close_links(classes, 2, scratch, shard_size=size)
        roots = {r["node"]: r["root"] for r in components(edges, scratch).collect()}
        got = [roots.get(int(p), int(p)) for p in points.view(np.int64)]
        assert len(set(zip(got, want.tolist(), strict=True))) == len(set(got)) == len(set(want.tolist()))


def test_copies_of_a_fingerprint_stay_three():
    rng = np.random.default_rng(5)
    for n in (2000, 64000):
        points = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        trees = [(m, simhash.fit_tree(points & np.uint64(m), 200, 0)[0]) for m in simhash.blocks(2)]
        sizes = [len(at) for _, _, at in simhash.shards_of(points, trees)]
        assert sum(sizes) == 3 * n and max(sizes) <= 200


def test_many_blank_and_repeated_rows(spark):
    rows = [*((d, None if d % 2 else " \n") for d in range(10_000)), *((10_000 + d, t) for d, t in ROWS), *((10_000 + d, t) for d, t in ROWS[:5])]
    got = simhash.simhash_groups(frame(spark, rows), shard_size=20).collect()
    assert len(got) == len(rows)
    want = brute.near_groups([(10_000 + d, t) for d, t in ROWS])
    blank = {d for d, t in rows[10_000:] if not brute.WORD.search((t or "").encode())}
    assert {r["component_id"] for r in got if r["doc_id"] < 10_000 or r["doc_id"] in blank} == {0}
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] >= 10_000 and r["component_id"]} == {d: c for d, c in want.items() if d not in blank}


def test_null_ids_and_an_empty_table(spark):
    got = simhash.simhash_groups(frame(spark, [(None, "one two three four"), (7, "one two three four"), (None, "five six seven eight nine")])).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted([(None, 7), (7, 7), (None, None)], key=str)
    assert simhash.simhash_groups(frame(spark, [(1, "x")]).where("doc_id > 1")).count() == 0


def test_lookup_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "small", lambda table, most=0: False)
    rows = spark.range(9000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("k"), "id")
    table = spark.range(0, 9000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).union(spark.createDataFrame([(1, 5)], "k long, v long"))
    for how in ("inner", "left"):
        got = skew.lookup(rows, table, "k", how)
        assert sorted(got.select("k", "id", "v").collect(), key=str) == sorted(rows.join(table, "k", how).select("k", "id", "v").collect(), key=str)


def test_without_on_both_sides_of_the_bound(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "a"), (2, None), (3, "c")], "k long, t string")
    gone = spark.createDataFrame([(None, "a"), (2, None), (2, None), (3, "d")], "k long, t string")
    for most in (100, 1):
        assert sorted(r["k"] for r in skew.without(rows, gone, {"k": F.col("k"), "t": F.col("t")}, most).collect()) == [1, 3]
