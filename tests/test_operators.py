"""Operators on small rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import bundle, chunking, entity, fusion, manifest, profile, providers, search


def cut(spark, text: str | None, size: int, overlap: int, **options) -> list[str]:
    return spark.createDataFrame([(text,)], "t string").select(chunking.separated(F.col("t"), size, overlap, **options).alias("c")).first()["c"]


def test_split_text_cuts_at_first_separator_in_order(spark):
    assert cut(spark, "  short ", 10, 2) == ["short"]
    assert cut(spark, None, 10, 2) == cut(spark, " \n ", 10, 2) == []
    # Cut after 。 at 5; the next window begins at 3 and is cut there again; the one from 4 reaches the end.
    assert cut(spark, "aaaa。bbbb cccc", 10, 2) == ["aaaa。", "a。", "。bbbb cccc"]
    crawl = cut(spark, "x" * 50 + " " + "y" * 2000, 950, 120)
    assert len(crawl) > 50 and crawl[-1].endswith("y")
    assert cut(spark, "a b " * 10, 10, 2, threshold=100) == [("a b " * 10).strip()]


def test_windows_end_at_separators_and_cover_the_text(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh。，, \n") for _ in range(rng.randrange(0, 400))).strip() for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunking.separated(F.col("t"), 40, 10).alias("c")).collect()
    for r in rows:
        text, at, reached = texts[r["i"]], 0, 0
        for piece in r["c"]:
            assert len(piece) <= 40
            at = text.index(piece, at)
            assert text[reached:at].strip() == ""
            reached = max(reached, at + len(piece))
            assert reached == len(text) or any(text[reached - len(s):reached] == s for s in chunking.SEPARATORS) or text[reached] in " \n" or len(piece) == 40
        assert text[reached:].strip() == ""


def test_pack_segments_keeps_pages(spark):
    def packed(segments: list[tuple[str, int]], size: int, overlap: int) -> list[tuple]:
        rows = spark.createDataFrame([(segments,)], "s array<struct<text: string, page: int>>")
        return [tuple(c) for c in rows.select(chunking.packed(F.col("s"), size, overlap).alias("c")).first()["c"]]

    got = packed([("a" * 40, 1), ("b" * 40, 2), ("c" * 90, 3)], 100, 5)
    assert got == [("a" * 40 + "\n\n" + "b" * 40, 1, 2), ("bbbbb\n\n" + "c" * 90, 2, 3)]
    # Without an overlap, or where it doesn't fit, a chunk begins with its own page.
    assert packed([("a" * 90, 1), ("c" * 95, 3)], 100, 5) == [("a" * 90, 1, 1), ("c" * 95, 3, 3)]
    assert packed([("a" * 90, 1), ("c" * 20, 3)], 100, 0) == [("a" * 90, 1, 1), ("c" * 20, 3, 3)]
    assert packed([], 100, 5) == []


def test_sliding_last_chunk_may_be_contained(spark):
    got = spark.createDataFrame([("x" * 250,), ("",), (None,)], "t string").select(chunking.sliding(F.col("t"), 100, 20).alias("c")).collect()
    assert [len(c) for c in got[0]["c"]] == [100, 100, 90, 10]
    assert got[1]["c"] == got[2]["c"] == []


def test_fusion_counts_every_hit(spark):
    hits = spark.createDataFrame([("dense", 1, "p"), ("dense", 2, "p"), ("keyword", 1, "q"), ("keyword", 3, "")], "route string, rank int, product_id string")
    got = {r["product_id"]: r["score"] for r in fusion.fuse(hits).collect()}
    assert got["p"] == pytest.approx(1 / 61 + 1 / 62)
    assert got["q"] == pytest.approx(1 / 61)
    assert len(got) == 2


def test_rerank_rounds_half_to_even(spark):
    rows = spark.createDataFrame([(0, 0.5e-6, 0.0, 0.5, ["a"], ""), (1, 0.0, 0.0, 0.9, ["a"], "")], "input_rank int, rerank_score double, rrf_score double, score double, routes array<string>, best_image_path string")
    assert [r["input_rank"] for r in fusion.rerank_order(rows, 2).orderBy("final_rank").collect()] == [1, 0]
    with pytest.raises(ValueError):
        fusion.rerank_order(rows, 0)


def test_sections(spark):
    rows = spark.createDataFrame([("quality_report", "x"), ("product_field", "gift"), ("supplement", "gift"), ("other", "unknown")], "t string, f string")
    assert [r[0] for r in rows.select(bundle.section(F.col("t"), F.col("f"))).collect()] == ["quality_reports", "gift_attributes", "supplements", "basic_info"]


def test_enrich_fills_only_missing(spark):
    rows = spark.createDataFrame([("1", "", "keep"), ("2", "null", None)], "id string, a string, b string")
    fetched = spark.createDataFrame([("1", "x", "y", "z")], "id string, a string, b string, c string")
    got = {r["id"]: (r["a"], r["b"], r["c"]) for r in search.enrich(rows, fetched).collect()}
    assert got == {"1": ("x", "keep", "z"), "2": (None, None, None)}


def test_plan_actions(spark):
    log = spark.createDataFrame([("d1", "a" * 40, "p1", "success", "2", 1), ("d2", "b" * 40, "p2", "failed", "1", 2)], "source_doc_id string, source_sha1 string, source_path string, status string, updated_at string, seq int")
    plan = spark.createDataFrame([("d1", "A" * 40, "p1"), ("d1", "c" * 40, "p9"), ("d2", "b" * 40, "p2"), ("d3", "d" * 40, "p1"), ("d4", "a" * 40, "p8"), ("d5", "e" * 40, "p7"), ("", "e" * 40, "p7")],
                                 "source_doc_id string, source_sha1 string, source_path string")
    got = {(r["source_doc_id"], r["source_sha1"][:1]): r["suggested_action"] for r in manifest.plan_actions(plan, log).collect()}
    assert got == {("d1", "A"): "unchanged", ("d1", "c"): "changed", ("d2", "b"): "new", ("d3", "d"): "changed", ("d4", "a"): "duplicate_content", ("d5", "e"): "new", ("", "e"): "unknown"}


def test_change_plan_refuses_untracked_ids(spark):
    ids = spark.createDataFrame([("a", "p"), ("b", "p")], "doc_id string, product_id string")
    extra = spark.createDataFrame([("z",)], "doc_id string")
    bad = manifest.refusals(manifest.change_plan("delete-source", ids, ids, ids, extra)).first()
    assert not bad["safe_to_execute"] and len(bad["refusals"]) == 2
    good = manifest.refusals(manifest.change_plan("delete-source", ids, ids, ids)).first()
    assert good["safe_to_execute"] and good["refusals"] == []
    with pytest.raises(ValueError):
        manifest.change_plan("other", ids, ids)


def test_running_ids_follow_the_order(spark):
    rows = spark.createDataFrame([(i, i % 3 == 0) for i in range(20)], "k int, f boolean")
    got = {r["k"]: r["new_id"] for r in entity.running_ids(rows, F.col("f"), 5, ["k"], buckets=4).collect()}
    assert [got[k] for k in range(0, 20, 3)] == [f"prd_{5 + i:06d}" for i in range(7)]
    assert got[1] is None


def test_overlay_and_primary(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, ""), (3, "c")], "k int, v string")
    assert {(r["k"], r["v"]) for r in profile.overlay(a, b, "k", ["v"]).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    rows = spark.createDataFrame([(1, 5, "x"), (1, 7, "y"), (1, 7, "a")], "k int, s int, v string")
    assert profile.primary(rows, "k", [-F.col("s"), F.col("v")], ["v"]).first()["v"] == "a"


def test_provider_retries_and_verifies(spark):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"

    assert providers.with_retry(flaky, 3, 0) == "ok"
    with pytest.raises(providers.Refused):
        providers.with_retry(lambda: (_ for _ in ()).throw(providers.Refused()), 3, 0)
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string")
    got = providers.embed_documents(docs, providers.HashProvider(8)).collect()
    assert all(len(r["embedding"]) == 8 for r in got)


def test_retention_first_rule_wins(spark):
    paths = spark.createDataFrame([("src/a_test.py",), ("output/cleanup/cleanup_plan.md",), ("output/cleanup/old.md",), ("x",)], "p string")
    got = [tuple(r["r"]) for r in paths.select(profile.retention(F.col("p")).alias("r")).collect()]
    assert got == [("protected", "keep"), ("old_report", "keep"), ("old_report", "delete"), ("keep", "keep")]


def test_candidates_review_and_price(spark):
    from quillstone.operators import entity

    fields = ("key", "product_id", "barcode", "product_name", "spec", "manufacturer", "brand", "price")

    def side(name, rows):
        return spark.createDataFrame(rows, ", ".join(f"{name}_{f} string" for f in fields))

    new = side("new", [("n1", "", "77", "red wine", "500ml", "", "A", "10"), ("n2", "", "", "blue wine", "1l", "", "B", "9")])
    old = side("old", [("o1", "p1", "77", "red wine", "500ml", "", "A", "12"), ("o2", "p2", "", "green", "1l", "", "B", "9"), ("o3", "", "", "x", "2l", "", "C", "1")])
    pairs = entity.candidate_pairs(new, old, ["brand", "spec"])
    assert sorted((r["new_key"], r["old_key"]) for r in pairs.collect()) == [("n1", "o1"), ("n2", "o2")]
    judged = {r["new_key"]: r["classification"] for r in entity.classify_overlap(new, entity.overlap_pairs(pairs)).collect()}
    assert judged == {"n1": "conflict_existing_product", "n2": "ambiguous"}  # n1 differs only in price
    c = F.col
    score = entity.review_score(c("new_product_name"), c("old_product_name"), c("old_spec"), F.array(F.lit("V30")), c("new_brand"), c("new_spec"), c("new_manufacturer"))
    got = {r["old_key"]: r["s"] for r in pairs.select("old_key", score.alias("s")).collect()}
    assert got["o1"]["score"] == pytest.approx(100 + 45 + 8) and got["o1"]["evidence"].startswith("核心名完整命中:redwine；产品名高相似:1.00；规格一致")
    many = spark.createDataFrame([("k", f"c{i:02d}", "n", "s", float(i), "e") for i in range(12)],
                                 "k string, candidate_id string, candidate_name string, candidate_spec string, score double, evidence string")
    row = entity.wide_candidates(many, "k").collect()[0]
    assert [row[f"candidate_{i}_id"] for i in (1, 2, 10)] == ["c11", "c10", "c02"] and row["candidate_10_evidence"] == "e"
