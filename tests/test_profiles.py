"""Profiles lead to the same classes, identities and candidates as listed pairs, and hot blocks list no pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillstone.functions.similarity import exact_similarity, similarity
from quillstone.operators import entity, profiles

FIELDS = ("key", "product_id", "barcode", "product_name", "spec", "manufacturer", "brand", "price", "size")
BLOCK = ("brand", "size")


def odd_rows(n: int, seed: int, own_ids: bool) -> list[tuple]:
    rng = random.Random(seed)

    def one(i: int) -> tuple:
        key = rng.choice([None, *range(n // 2)]) if rng.random() < 0.4 else 1000 + i
        product = f"p{seed}{i:03d}" if own_ids else rng.choice(["", None, " ", "p1", "p2", "p3", "p4"])
        return (key, product, rng.choice(["", "", None, "7", "8", "9"]), rng.choice(["red wine", "Red  wine", "wine", "blue wine", "", None, "green tea", "green teas"]), rng.choice(["1l", "0.5l", "", None]),
                rng.choice(["", "maker", "makers"]), rng.choice(["A", "B", None]), rng.choice(["10", "12", ""]), rng.choice([1, 2, None]))

    return [one(i) for i in range(n)]


def side(spark, name: str, rows: list[tuple]):
    return spark.createDataFrame(rows, ", ".join(f"{name}_{f} {'int' if f in ('key', 'size') else 'string'}" for f in FIELDS))


def sides(spark, own_ids: bool = False):
    return side(spark, "new", odd_rows(60, 1, own_ids)).cache(), side(spark, "old", odd_rows(60, 2, own_ids)).cache()


@pytest.mark.parametrize("measure", [similarity, exact_similarity])
def test_classes_and_identities_of_odd_rows(spark, measure):
    new, old = sides(spark)
    pairs = entity.candidate_pairs(new, old, BLOCK).cache()
    keys = new.select("new_key").distinct().where("new_key IS NOT NULL")

    def shown(df):
        return sorted(map(tuple, df.collect()))

    assert pairs.count() > 500
    assert shown(entity.classify_overlap(keys, profiles.overlap_judgements(new, old, BLOCK, measure=measure))) == shown(entity.classify_overlap(keys, entity.overlap_pairs(pairs, measure)))
    assert shown(entity.identity_actions(keys, profiles.best_identities(new, old, BLOCK, measure))) == shown(entity.identity_map(keys, pairs, measure=measure))
    named = entity.candidate_pairs(new, old, similar=(6, 10))
    assert shown(entity.classify_overlap(keys, profiles.overlap_judgements(new, old, similar=(6, 10), measure=measure))) == shown(entity.classify_overlap(keys, entity.overlap_pairs(named, measure)))


def judged():
    c = F.col
    return entity.review_score(c("new_product_name"), c("old_product_name"), c("old_spec"), F.array(F.lit("wine")), c("new_brand"), c("new_spec"), c("new_manufacturer"), measure=exact_similarity)


def test_candidates_of_odd_rows(spark):
    new, old = sides(spark, own_ids=True)
    scored = entity.candidate_pairs(new, old, BLOCK).withColumn("judged", judged()).select(
        "new_key", F.col("old_product_id").alias("candidate_id"), F.col("old_product_name").alias("candidate_name"), F.col("old_spec").alias("candidate_spec"),
        F.round("judged.score", 4).alias("score"), "judged.evidence")
    want = {r[0]: r for r in entity.wide_candidates(scored, "new_key").collect()}
    got = {r[0]: r for r in profiles.review_candidates(new, old, judged(), ("product_name", "brand", "spec", "manufacturer"), ("product_name", "spec"), BLOCK).collect()}
    assert got == want and any(r["candidate_10_id"] for r in got.values())
    lone = [side(spark, name, [(i, *r[1:]) for i, r in enumerate(odd_rows(60, seed, True))]) for name, seed in (("new", 3), ("old", 4))]
    scored = entity.candidate_pairs(*lone, BLOCK).withColumn("judged", judged()).select(
        "new_key", F.col("old_product_id").alias("candidate_id"), F.col("old_product_name").alias("candidate_name"), F.col("old_spec").alias("candidate_spec"),
        F.round("judged.score", 4).alias("score"), "judged.evidence")
    want = {r[0]: r for r in entity.wide_candidates(scored, "new_key").collect()}
    got = {r[0]: r for r in profiles.review_candidates(*lone, judged(), ("product_name", "brand", "spec", "manufacturer"), ("product_name", "spec"), BLOCK).collect()}
    assert got == want


def most_rows(df) -> int:
    """The most rows that a step of the plan gave; df has been run."""
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        metric = node.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.executedPlan())
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
    return most


@pytest.mark.parametrize("name", ["identity_map", "identity_map_blocks", "review_score", "overlap_classify", "overlap_classify_blocks"])
def test_a_hot_block_lists_no_pairs(spark, tmp_path, name):
    """2,000 new and 2,000 known parts of one block would be 4,000,000 pairs."""
    from quillstone.catalogue import QUERIES

    part = spark.range(4000).selectExpr("id AS p_partkey", "'red ring' AS p_name", "'Brand#1' AS p_brand", "'LARGE' AS p_type", "1 AS p_size", "900.0D AS p_retailprice")
    part.write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    rows = df.collect()
    assert len(rows) == 2000 and 0 < most_rows(df) <= 40_000


def test_copies_of_names_list_no_pairs(spark, tmp_path):
    """1,000 new and 1,000 known parts of four names: the pairs of rows are 1,000,000."""
    from quillstone.catalogue import QUERIES

    part = spark.range(2000).selectExpr("id AS p_partkey", "elt(1 + id div 2 % 2, 'red ring', 'blue bolt') AS p_name", "'Brand#1' AS p_brand", "'LARGE' AS p_type", "1 AS p_size", "900.0D AS p_retailprice")
    part.write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES["overlap_classify_names"](spark, str(tmp_path))
    rows = df.collect()
    assert len(rows) == 1000 and {r["needs_review"] for r in rows} == {True, False} and 0 < most_rows(df) <= 20_000
