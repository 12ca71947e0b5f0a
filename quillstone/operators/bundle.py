"""Product bundles: sections, id sets and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import normalize_space, strip

SECTIONS = ("basic_info", "packaging", "selling_points", "gift_attributes", "quality_reports", "image_texts", "supplements")
#: Field names that belong to a section.
SECTION_FIELDS = {
    "basic_info": ("basic_info", "product_info", "summary"),
    "packaging": ("packaging", "packaging_desc", "package", "package_info", "包装"),
    "selling_points": ("selling_points", "sell_point", "卖点", "介绍", "description"),
    "gift_attributes": ("gift_attributes", "gift", "gift_scene", "礼品属性"),
}
BUNDLE_TYPES = ("product_full", "product_field", "quality_report", "supplement")


def overlay(row: Column, metadata: Column) -> Column:
    """The row's value unless it is null or empty; else the metadata's."""
    return F.coalesce(F.when(row.cast("string") != "", row), metadata)


def needs_review(*values: Column) -> Column:
    """Whether any value says needs_review, case aside."""
    return F.exists(F.array(*values), lambda v: F.lower(strip(v)) == "needs_review")


def section(doc_type: Column, field: Column, other: str = "basic_info") -> Column:
    """The bundle section of a document; `other` takes what nothing else claims."""
    out = F.when(doc_type == "quality_report", "quality_reports").when(doc_type == "supplement", "supplements").when(doc_type == "product_full", "basic_info")
    for name, fields in SECTION_FIELDS.items():
        out = out.when(field.isin(*fields), name)
    return out.otherwise(other)


def bundles(rows: DataFrame, per_section: int = 120) -> DataFrame:
    """One row per product and section: the first `per_section` documents in id order, and how many there are.

    rows has product_id, doc_id, doc_type, field_name, status and text.  The cut is
    the retrieval limit of a bundle; n_docs counts all.
    """
    kept = rows.where(~needs_review(F.col("doc_type"), F.col("field_name"), F.col("status"))).withColumn("section", section(F.col("doc_type"), F.col("field_name")))
    within = Window.partitionBy("product_id", "section").orderBy("doc_id")
    counts = kept.groupBy("product_id", "section").agg(F.count("*").alias("n_docs"))
    nested = (kept.withColumn("n", F.row_number().over(within)).where(F.col("n") <= per_section).groupBy("product_id", "section")
              .agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids")))
    return counts.join(nested, ["product_id", "section"])


def conflicts(rows: DataFrame) -> DataFrame:
    """Supplements that contradict a product's first known value of a field: (product_id, field, old_value, supplement_value, supplement_doc_id, severity).

    rows is long: product_id, doc_id, doc_type, field, value; the first old value is that of the smallest doc_id.
    """
    clean = rows.withColumn("value", normalize_space(F.col("value"))).where("value <> ''")
    old = clean.where(F.col("doc_type").isin("product_full", "product_field")).groupBy("product_id", "field").agg(F.min_by("value", "doc_id").alias("old_value"))
    new = clean.where(F.col("doc_type") == "supplement").select("product_id", "field", F.col("value").alias("supplement_value"), F.col("doc_id").alias("supplement_doc_id"))
    return (old.join(new, ["product_id", "field"]).where(F.lower("old_value") != F.lower("supplement_value"))
            .withColumn("severity", F.when(F.col("field").isin("product_id", "product_name"), "high").otherwise("medium")))


def image_enrichment(products: DataFrame, index: DataFrame, urls: DataFrame) -> DataFrame:
    """Fill best_image_path from the product's image index (primary, else first path) and best_image_url from the path's url.

    index has product_id, primary_path, paths; urls has path, url.  Values found by retrieval win.
    """
    got = products.join(index, "product_id", "left")
    path = F.coalesce(F.when(strip(F.col("best_image_path")) != "", F.col("best_image_path")), F.when(strip(F.col("primary_path")) != "", F.col("primary_path")),
                      F.try_element_at("paths", F.lit(1)), F.lit(""))
    got = got.withColumn("best_image_path", path).drop("primary_path", "paths")
    named = got.join(urls.select(F.col("path").alias("best_image_path"), F.col("url").alias("mapped_url")), "best_image_path", "left")
    return named.withColumn("best_image_url", F.coalesce(F.when(strip(F.col("best_image_url")) != "", F.col("best_image_url")), F.col("mapped_url"), F.lit(""))).drop("mapped_url")
