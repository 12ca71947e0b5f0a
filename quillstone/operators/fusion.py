"""Rank fusion of retrieval routes and the orders that follow it.

Hits have route, rank, product_id and, as far as they exist, doc_id, image_id,
image_path, image_url and source_text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import normalize_space, strip, truncate

ROUTES = ("dense", "keyword", "image_text")


def route_order(routes: Sequence[str] = ROUTES) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, routes)), F.col("route")), F.lit(len(routes) + 1)).cast("int")


def ranked(rows: DataFrame, route: str, score: str, id_col: str, k: int) -> DataFrame:
    """Number a route's rows by score; ranks are given before rows without a product go, so gaps stay."""
    top = rows.orderBy(F.desc(score), id_col).limit(k)
    out = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), id_col))).withColumn("route", F.lit(route))
    return out.where(strip(F.col("product_id")) != "")


def fuse(hits: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: (product_id, score, routes, first_seen); every hit counts, so a product may score often in one route."""
    return (hits.where((strip(F.col("product_id")) != "") & (F.col("rank") > 0))
            .groupBy("product_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.array_sort(F.collect_set("route")).alias("routes"),
                                       F.min(F.struct(route_order().alias("route_order"), "rank")).alias("first_seen")))


def fused_order(fused: DataFrame) -> list[Column]:
    """By score; ties by first appearance, then by product."""
    return [F.desc(F.round("score", 12)), F.col("first_seen"), F.col("product_id")]


def fuse_queries(hits: DataFrame, most: int = 30, k: int = 60, query_id: str = "query_id") -> DataFrame:
    """`fuse` for a table of queries: each query's `most` best products with final_rank, in the order of `fused_order`; hits say their query."""
    found = (hits.where((strip(F.col("product_id")) != "") & (F.col("rank") > 0))
             .groupBy(query_id, "product_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.array_sort(F.collect_set("route")).alias("routes"),
                                                  F.min(F.struct(route_order().alias("route_order"), "rank")).alias("first_seen")))
    return found.withColumn("final_rank", F.row_number().over(Window.partitionBy(query_id).orderBy(*fused_order(found)))).where(F.col("final_rank") <= most)


def route_maps(hits: DataFrame, k: int = 60) -> DataFrame:
    """(product_id, route, route_score, best_rank)."""
    return (hits.where((strip(F.col("product_id")) != "") & (F.col("rank") > 0)).groupBy("product_id", "route")
            .agg(F.sum(1.0 / (k + F.col("rank"))).alias("route_score"), F.min("rank").alias("best_rank")))


def first_arrivals(hits: DataFrame) -> DataFrame:
    """Each product's distinct hits (told by route, document and image) as they first arrived, with their order `ord`."""
    order = F.struct(route_order().alias("route_order"), F.col("rank"))
    arrived = hits.where((strip(F.col("product_id")) != "") & (F.col("rank") > 0)).withColumn("ord", order)
    return arrived.groupBy("product_id", "route", "doc_id", "image_id").agg(F.min_by(F.struct(*[c for c in arrived.columns]), "ord").alias("h")).select("h.*")


def nested_hits(hits: DataFrame, most: int = 8, best_chars: int = 600) -> DataFrame:
    """Per product: its first `most` distinct hits, images and reports in arrival order, and the best text and image.

    A hit is told by route, document and image; an image by source and path.  Only
    the first rows of each product are gathered: ranks are cut before nesting.
    """
    once = first_arrivals(hits)
    with_text = once.where(F.coalesce(F.col("source_text"), F.lit("")) != "")
    within = Window.partitionBy("product_id").orderBy("ord")
    docs = (with_text.withColumn("n", F.row_number().over(within)).where(F.col("n") <= most).groupBy("product_id")
            .agg(F.array_sort(F.collect_list(F.struct("n", "route", "doc_id", "source_text"))).alias("doc_hits"),
                 truncate(F.min_by("source_text", "ord"), best_chars).alias("best_text")))
    images = once.where((F.coalesce(F.col("image_id"), F.lit("")) != "") | (F.coalesce(F.col("image_path"), F.lit("")) != ""))
    pictures = (images.withColumn("n", F.row_number().over(within)).groupBy("product_id")
                .agg(F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.struct("n", "route", "image_id", "image_path", "source_text")))).alias("image_hits"),
                     F.min_by("image_path", F.when(F.coalesce(F.col("image_path"), F.lit("")) != "", F.col("ord"))).alias("best_image_path"),
                     F.min_by("image_url", F.when(F.coalesce(F.col("image_url"), F.lit("")) != "", F.col("ord"))).alias("best_image_url")))
    return docs.join(pictures, "product_id", "full")


#: What image and report resources take from a hit's metadata as it is.
SOURCE_FIELDS = ("source_kind", "source_file", "source_doc_id", "source_sha1", "source_url", "chunk_index")


def distinct_resources(rows: DataFrame, key: Sequence[str], fields: Sequence[Column], name: str, most: int) -> DataFrame:
    """(product_id, name): the first `most` resources in arrival order, one for each key; keys without any text don't count."""
    keyed = rows.where(F.concat(*(F.col(k) for k in key)) != "")
    one = keyed.groupBy("product_id", *key).agg(F.min(F.struct("ord", *fields)).alias("r"))
    numbered = one.withColumn("n", F.row_number().over(Window.partitionBy("product_id").orderBy("r"))).where(F.col("n") <= most)
    listed = numbered.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("n", F.col("r").dropFields("ord").alias("r")))).alias("x"))
    return listed.select("product_id", F.col("x.r").alias(name))


def nested_resources(hits: DataFrame, most: int = 8) -> DataFrame:
    """Per product its images and PDF reports in arrival order, the first report, and the first image's path and url.

    hits have a map of texts `metadata`.  An image is told by source document and path, a
    report (a hit of doc_type quality_report) by source document and file; at most `most`
    of each are kept, and resources of which neither is known don't count.
    """
    def of(name: str) -> Column:
        return normalize_space(F.try_element_at("metadata", F.lit(name)))

    once = first_arrivals(hits)
    known = once.select("product_id", "ord", of("doc_type").alias("doc_type"), *(of(f).alias(f) for f in SOURCE_FIELDS), of("page_start").alias("page_start"), of("page_end").alias("page_end"),
                        of("supplement_title").alias("supplement_title"), of("image_url").alias("told_url"), *(normalize_space(F.col(c)).alias(c) for c in ("image_id", "image_path", "image_url")))
    shown = known.where("image_id <> '' OR image_path <> ''").withColumn("image_url", F.coalesce(F.nullif("image_url", F.lit("")), "told_url"))
    images = distinct_resources(shown, ["source_doc_id", "image_path"], [F.col(c) for c in ("image_id", "image_path", "image_url", *SOURCE_FIELDS)], "images", most)
    told = known.where("doc_type = 'quality_report'").withColumn("pdf_path", F.col("source_file"))
    fields = [F.col("source_doc_id"), F.col("pdf_path"), F.col("source_url").alias("pdf_url"), *(F.col(c) for c in ("source_kind", "source_file", "source_sha1", "chunk_index", "page_start", "page_end", "supplement_title"))]
    reports = distinct_resources(told, ["source_doc_id", "pdf_path"], fields, "pdf_reports", most)
    both = images.join(reports, "product_id", "full")
    return both.select("product_id", "images", "pdf_reports", F.try_element_at("pdf_reports", F.lit(1)).alias("best_pdf_hit"),
                       F.try_element_at("images", F.lit(1))["image_path"].alias("first_image_path"), F.try_element_at("images", F.lit(1))["image_url"].alias("first_image_url"))


def rerank_order(candidates: DataFrame, top_n: int, epsilon: float = 1e-6) -> DataFrame:
    """Final order by rerank score in steps of epsilon (half to even), then route count, image-text hit, image path, fusion score, input rank.

    candidates has rerank_score, score or rrf_score, routes, best_image_path and input_rank (from 0).
    """
    if top_n <= 0:
        raise ValueError("top_n must be positive")
    score = F.coalesce(F.when(F.col("rrf_score") != 0, F.col("rrf_score")), F.col("score"), F.lit(0.0))
    step = F.rint(F.coalesce(F.col("rerank_score"), F.lit(0.0)) / epsilon)
    keys = [F.desc("step"), F.desc(F.size("routes")), F.desc(F.array_contains("routes", "image_text")), F.desc(F.coalesce(strip(F.col("best_image_path")) != "", F.lit(False))),
            F.desc("rrf_score"), F.col("input_rank")]
    rows = candidates.withColumns({"rrf_score": score, "final_score": F.coalesce(F.col("rerank_score"), F.lit(0.0)), "step": step})
    top = rows.orderBy(*keys).limit(top_n)
    return top.withColumn("final_rank", F.row_number().over(Window.orderBy(*keys))).drop("step")


def fallback_order(candidates: DataFrame, top_n: int) -> DataFrame:
    """Input order kept; all scores become the fusion score."""
    score = F.coalesce(F.when(F.col("score") != 0, F.col("score")), F.col("rrf_score"), F.lit(0.0))
    top = candidates.withColumns({"rrf_score": score, "rerank_score": score, "final_score": score}).orderBy("input_rank").limit(top_n)
    return top.withColumn("final_rank", F.row_number().over(Window.orderBy("input_rank")))


def flatten(products: DataFrame, top_k: int) -> DataFrame:
    """Hits of ranked products one a row, with the best text of products that have none; the first top_k.

    products has product_rank, product_id, best_text and doc_hits.
    """
    rows = products.select("product_rank", "product_id", "best_text", F.posexplode_outer("doc_hits").alias("pos", "hit"))
    rows = rows.where(F.col("hit").isNotNull() | (F.coalesce(F.col("best_text"), F.lit("")) != ""))
    out = rows.select("product_rank", F.coalesce("pos", F.lit(0)).alias("pos"), "product_id", F.coalesce("hit.doc_id", F.lit(None)).alias("doc_id"),
                      F.coalesce("hit.source_text", "best_text").alias("source_text"))
    top = out.orderBy("product_rank", "pos").limit(top_k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("product_rank", "pos")))
