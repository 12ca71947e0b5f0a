"""Texts for reranking and answering, built with array functions only."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.extract import product_name
from quillstone.functions.text import labelled, normalize_space, tokens, truncate

from .providers import Provider

NOTHING_FOUND = "资料库中没有找到足够相关的产品。"


def hit_text(hits: Column, i: int) -> Column:
    return F.try_element_at(hits, F.lit(i + 1))["source_text"]


def rerank_text(products: DataFrame, most: int = 1800) -> DataFrame:
    """Adds rerank_text: id, routes, best text, three text hits, two image hits and the image path, each text once."""
    parts = [("产品ID", F.col("product_id").cast("string"), 120), ("召回来源", F.array_join("routes", "、"), 120), ("核心文本", F.col("best_text"), 700)]
    parts += [("文本命中", hit_text(F.col("doc_hits"), i), 420) for i in range(3)]
    if "image_hits" in products.columns:
        parts += [("图片语义命中", hit_text(F.col("image_hits"), i), 420) for i in range(2)]
    if "best_image_path" in products.columns:
        parts.append(("图片引用", F.col("best_image_path"), 180))
    return products.withColumn("rerank_text", truncate_lines(labelled(parts), most))


def truncate_lines(c: Column, most: int) -> Column:
    return F.when(F.char_length(c) > most, F.concat(F.substring(F.replace(c, F.lit("\n"), F.lit(" ")), 1, most - 3), F.lit("..."))).otherwise(F.replace(c, F.lit("\n"), F.lit(" ")))


def lexical_score(query: str, text: Column) -> Column:
    """Deterministic rerank score of the offline provider: the share of the query's distinct terms that the text has."""
    wanted = F.array_distinct(tokens(F.lit(query)))
    return F.round(F.size(F.array_intersect(wanted, tokens(text))) / F.greatest(F.size(wanted), F.lit(1)), 6)


def sources(products: DataFrame) -> DataFrame:
    """(product_id, n, route, content) of each product's first two distinct text hits."""
    each = products.select("product_id", F.explode(F.slice("doc_hits", 1, 2)).alias("h"))
    rows = each.select("product_id", F.col("h.n").alias("n"), F.col("h.route").alias("route"), normalize_space(F.col("h.source_text")).alias("content")).where("content <> ''")
    first = rows.groupBy("product_id", "route", F.substring("content", 1, 120).alias("head")).agg(F.min(F.struct("n", "content")).alias("x"))
    return first.select("product_id", "x.n", "route", truncate(F.col("x.content"), 500).alias("content"))


def context(products: DataFrame, most: int = 1200) -> DataFrame:
    """Adds product_name and context_text to ranked products (product_rank, product_id, routes, score, best_text, bundle columns)."""
    bundle = [(label, F.col(c), limit) for c, label, limit in (
        ("conflicts_text", "冲突摘要", 260), ("basic_info_text", "产品完整资料包-基础资料", 420), ("quality_reports_text", "产品完整资料包-质检报告", 420),
        ("supplements_text", "产品完整资料包-补充资料", 420), ("image_texts_text", "产品完整资料包-图片语义", 320)) if c in products.columns]
    head = F.concat_ws("\n", F.format_string("[产品 %d]", "product_rank"), F.concat(F.lit("product_id："), F.col("product_id").cast("string")),
                       F.concat(F.lit("产品名称："), product_name(F.col("best_text"))), F.concat(F.lit("routes："), F.array_join("routes", ", ")),
                       F.format_string("rerank_score：%.6f", F.col("score").cast("double")), labelled([*bundle, ("核心资料", F.col("best_text"), 520)]))
    return products.withColumns({"product_name": product_name(F.col("best_text")), "context_text": truncate_lines(head, most)})


def extractive_answer(products: DataFrame, most: int = 5) -> DataFrame:
    """One row: the offline answer that lists the best products with a line of their text."""
    name = product_name(F.col("best_text"))
    reason = truncate(normalize_space(F.coalesce(F.col("supplements_text"), F.col("best_text")) if "supplements_text" in products.columns else F.col("best_text")), 120)
    lines = products.orderBy("product_rank").limit(most).select("product_rank", F.format_string("%d. %s：%s", "product_rank", F.when(name != "", name).otherwise(F.col("product_id").cast("string")), reason).alias("line"))
    got = lines.agg(F.array_sort(F.collect_list(F.struct("product_rank", "line"))).alias("all"))
    return got.select(F.when(F.size("all") == 0, NOTHING_FOUND).otherwise(F.concat(F.lit("根据当前资料，优先推荐以下产品：\n"), F.array_join(F.transform("all", lambda x: x["line"]), "\n"))).alias("answer"))


def structured_products(products: DataFrame, told: DataFrame) -> DataFrame:
    """Ranked products with the model's name and reason where it gave them, else the text's; ids the model made up are ignored.

    products: product_rank, product_id, best_text, score; told: product_id, product_name, reason.
    """
    got = products.join(told.select("product_id", F.col("product_name").alias("told_name"), "reason").dropDuplicates(["product_id"]), "product_id", "left")
    reason = F.coalesce(F.when(F.trim("reason") != "", F.col("reason")), truncate(normalize_space(F.col("best_text")), 180))
    return got.select("product_rank", "product_id", F.coalesce(F.when(F.trim("told_name") != "", F.col("told_name")), product_name(F.col("best_text"))).alias("product_name"), reason.alias("reason"), "score")


def rerank_scores(products: DataFrame, query: str, provider: Provider, id_col: str = "product_id") -> DataFrame:
    """(id, rerank_score) from a provider, one request per Arrow batch; a missing or extra score is an error."""
    kind = products.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            scores = provider.rerank(query, rows["rerank_text"].tolist())
            if len(scores) != len(rows):
                raise ValueError("the provider returned another number of scores than asked for")
            yield rows[[id_col]].assign(rerank_score=[float(s) for s in scores])

    return products.select(id_col, "rerank_text").mapInPandas(run, f"{id_col} {kind}, rerank_score double")
