"""Data-quality profiles, overlays of image records, primary choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import SHEET_PLACEHOLDERS, header_key, strip


def meaningful(c: Column) -> Column:
    s = strip(c)
    return (s != "") & ~s.isin(*SHEET_PLACEHOLDERS)


def fill_rate(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, n_filled, n_rows, rate): one pass over the table."""
    wide = rows.agg(F.count("*").alias("n_rows"), *(F.count_if(meaningful(F.col(f))).alias(f"f_{i}") for i, f in enumerate(fields)))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"f_{i}").alias("n_filled")) for i, f in enumerate(fields)))).alias("x")
    return wide.select("n_rows", each).select("x.field", "x.n_filled", "n_rows", F.round(F.col("x.n_filled") / F.greatest("n_rows", F.lit(1)), 6).alias("rate"))


def duplicates(rows: DataFrame, fields: Sequence[str], id_col: str, examples: int = 5) -> DataFrame:
    """Groups of rows whose fields agree up to case, spaces and signs: their keys, count and first ids."""
    keys = [F.lower(header_key(F.col(f))).alias(f"key_{f}") for f in fields]
    groups = rows.select(id_col, *keys).where(F.col(f"key_{fields[0]}") != "")
    names = [f"key_{f}" for f in fields]
    counts = groups.groupBy(*names).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id"))
    return counts.where("n > 1")


def sparse(rows: DataFrame, fields: Sequence[str], id_col: str, most: int = 5) -> DataFrame:
    """Rows with at most `most` filled fields: (id, n_filled)."""
    n = sum((F.when(meaningful(F.col(f)), 1).otherwise(0) for f in fields), F.lit(0))
    return rows.select(id_col, n.alias("n_filled")).where(F.col("n_filled") <= most)


def sheet_status(rows: DataFrame, sheet: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(sheet columns, avg_fields, n_fields, status): review where rows have under 3 filled fields on average or under 4 fields are known."""
    n = sum((F.when(meaningful(F.col(f)), 1).otherwise(0) for f in fields), F.lit(0))
    known = sum((F.max(F.when(meaningful(F.col(f)), 1).otherwise(0)) for f in fields), F.lit(0))
    out = rows.withColumn("n", n).groupBy(*sheet).agg(F.round(F.avg("n"), 6).alias("avg_fields"), known.alias("n_fields"))
    return out.withColumn("status", F.when((F.col("avg_fields") < 3) | (F.col("n_fields") < 4), "needs_review").otherwise("ok"))


def overlay(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Full outer overlay: the right table's non-empty value wins; rows of either side stay."""
    a, b = left.alias("a"), right.alias("b")
    joined = a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full")
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *(F.coalesce(F.when(strip(F.col(f"b.{f}")) != "", F.col(f"b.{f}")), F.col(f"a.{f}")).alias(f) for f in fields))


def primary(rows: DataFrame, key: str, order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order, by a minimum over the ordering struct; one partial aggregate, no window."""
    rank = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    return rows.groupBy(key).agg(F.min_by(F.struct(*keep), rank).alias("p")).select(key, "p.*")


def analysis_status(success: Column, total: Column) -> Column:
    return F.when(total == 0, "no_images").when(success == total, "all_success").when(success > 0, "partial_success").otherwise("all_failed")


def ordered_unique(rows: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """(key, values): each key's distinct non-blank values in order of first appearance."""
    firsts = rows.where(strip(F.col(value)) != "").groupBy(key, strip(F.col(value)).alias("v")).agg(F.min(F.struct(*order)).alias("at"))
    return firsts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("values"))


#: Retention rules in order, a test on the path, category and action.
RETENTION = (
    (r"^(src|web|config|docs)/", "protected", "keep"),
    (r"^scripts/.*\.py$", "protected", "keep"),
    (r"^output/acceptance/.*\.(md|json|jsonl)$", "acceptance_report", "archive"),
    (r"^output/ingest_push/.*_report\.(md|json)$", "old_report", "archive"),
    (r"^output/ingest_changes/(change_plan|delete_report)\.", "old_report", "archive"),
    (r"^output/cleanup/(cleanup_plan|script_review)\.(md|json)$", "old_report", "keep"),
    (r"^output/cleanup/", "old_report", "delete"),
    (r"^output/(product_excel_pipeline|ingest_build_test|ingest_embeddings_test)", "temp_pipeline", "archive"),
    (r"(^|/)(__pycache__|\.pytest_cache)(/|$)", "cache", "delete"),
    (r"^output/.*(_test\.jsonl$|_report\.md$|_report\.json$|test)", "old_report", "archive"),
)


def retention(path: Column, rules: Sequence[tuple[str, str, str]] = RETENTION) -> Column:
    """(category, action) of the first rule that fits a path; keep if none does."""
    category, action = F.lit("keep"), F.lit("keep")
    for test, c, a in reversed(rules):
        category, action = F.when(path.rlike(test), c).otherwise(category), F.when(path.rlike(test), a).otherwise(action)
    return F.struct(category.alias("category"), action.alias("action"))


def image_backfill(products: DataFrame, images: DataFrame) -> DataFrame:
    """Products with their images: counts, ordered distinct paths, the primary image and the analysis status.

    products: product_id; images: product_id, image_index, anchor_cell, image_path, caption, tags, ocr_text, analysis_status, has_embedding, matched.
    """
    shown = F.coalesce(F.col("image_index"), F.lit(999999999))
    order = [(F.col("analysis_status") != "success").cast("int"), -F.char_length(strip(F.col("caption"))), -F.coalesce(F.size("tags"), F.lit(0)), (strip(F.col("ocr_text")) == "").cast("int"),
             (~F.coalesce("has_embedding", F.lit(False))).cast("int"), (~F.coalesce("matched", F.lit(False))).cast("int"), shown, F.coalesce("image_path", F.lit(""))]
    best = primary(images, "product_id", order, ["image_path", "caption", "tags"]).select("product_id", F.col("image_path").alias("primary_image_path"), F.col("caption").alias("primary_image_caption"))
    counts = images.groupBy("product_id").agg(F.count_if(F.col("analysis_status") == "success").alias("ok"), F.count("*").alias("n"))
    paths = ordered_unique(images.withColumn("o", shown), "product_id", "image_path", ["o", "anchor_cell"]).withColumnRenamed("values", "image_paths")
    got = products.join(best, "product_id", "left").join(counts, "product_id", "left").join(paths, "product_id", "left")
    return got.withColumns({"image_count": F.greatest(F.coalesce(F.size("image_paths"), F.lit(0)), F.lit(0)),
                            "image_analysis_status": analysis_status(F.coalesce("ok", F.lit(0)), F.coalesce("n", F.lit(0)))}).drop("ok", "n")


def cell_bounds(cells: DataFrame, sheet: Sequence[str]) -> DataFrame:
    """(sheet columns, bounds): the A1 range of the filled cells, from row and column numbers."""
    edge = cells.where(meaningful(F.col("value"))).groupBy(*sheet).agg(F.min("row").alias("r0"), F.min("column").alias("c0"), F.max("row").alias("r1"), F.max("column").alias("c1"))
    return edge.select(*sheet, F.concat(column_letters(F.col("c0")), "r0", F.lit(":"), column_letters(F.col("c1")), "r1").alias("bounds"))


def column_letters(n: Column) -> Column:
    """Letters of a sheet column, 1 being A; up to three."""
    def letter(c: Column) -> Column:
        return F.char(F.lit(65) + c)

    one, two = n - 1, n - 27
    three = n - 703
    return (F.when(n <= 26, letter(one)).when(n <= 702, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
            .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26))))


def lookups(records: DataFrame) -> dict[str, DataFrame]:
    """Catalogue lookups: by product and by locator the last record wins, by fingerprint all product ids in order."""
    return {"by_product_id": records.groupBy("product_id").agg(F.max_by("locator", "seq").alias("locator")), "by_locator": records.groupBy("locator").agg(F.max_by("product_id", "seq").alias("product_id")),
            "by_fingerprint": records.groupBy("fingerprint").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "product_id"))), lambda x: x["product_id"]).alias("product_ids"))}
