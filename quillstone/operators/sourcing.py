"""Documents and their sources: identity ladders, embeddable rows, id collection, build checks, fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.ids import posix_path, product_source_id, valid_sha1, whole_number
from quillstone.functions.text import first_nonblank, strip


def both(row: Column, metadata: Column) -> Column:
    """The row's value if it isn't blank, else the metadata's."""
    return first_nonblank(row, metadata)


def text_source_id(source_doc_id: Column, sha1: Column, doc_id: Column, doc_type: Column, product_id: Column, field: Column) -> Column:
    """The id of a text's source: given, from its digest, from its own id, else the product's."""
    digest = valid_sha1(sha1)
    held = F.regexp_extract(doc_id, r"^supp__.*__quality_report__([0-9a-f]{12,40})__c\d+$", 1)
    part = F.when(doc_type == "product_field", first_nonblank(field, F.lit("field"))).otherwise("")
    product = F.when(strip(product_id) != "", product_source_id(product_id, part)).otherwise("")
    return (F.when(strip(source_doc_id) != "", strip(source_doc_id)).when((digest != "") & (doc_type == "quality_report"), F.concat(F.lit("pdf__"), digest))
            .when(held != "", F.concat(F.lit("pdf__"), held)).otherwise(product))


def text_source_kind(kind: Column, doc_type: Column) -> Column:
    return F.when(strip(kind) != "", strip(kind)).when(doc_type == "quality_report", "pdf_quality_report").when(doc_type.isin("product_full", "product_field"), "product_master").otherwise("")


def image_source_id(source_doc_id: Column, sha1: Column, image_id: Column) -> Column:
    return F.when(strip(source_doc_id) != "", strip(source_doc_id)).otherwise(F.concat(F.lit("imgsrc__"), first_nonblank(valid_sha1(sha1), image_id)))


def image_source_kind(kind: Column, source_type: Column) -> Column:
    return first_nonblank(kind, source_type, F.lit("excel_image"))


def chunk_number(c: Column) -> Column:
    """The chunk's number; 1 if it has none or zero."""
    n = whole_number(c)
    return F.coalesce(F.when(n != 0, n), F.lit(1))


def source_matches(expected: str, actual: Column) -> Column:
    """Equal, or beginning with what is expected; neither may be empty."""
    return F.lit(bool(expected)) & (actual != "") & actual.startswith(expected)


def embeddable(docs: DataFrame, source_type: str) -> DataFrame:
    """Documents fit to embed, with content_sha1; docs has doc_id, page_content and a metadata map whose values win.

    Rows without id or text carry the reason in `warning`.
    """
    m = F.col("metadata")
    doc_id, text = both(m["doc_id"], F.col("doc_id")), strip(F.col("page_content"))
    names = ("source_doc_id", "source_sha1", "product_id", "doc_type", "field_name")
    taken = [(both(m[n], F.col(n)) if n in docs.columns else strip(m[n])).alias(n) for n in names]
    return docs.select(doc_id.alias("doc_id"), F.lit(source_type).alias("source_type"), *taken, F.sha1(text).alias("content_sha1"), text.alias("page_content"),
                       F.when(doc_id == "", "missing doc_id").when(text == "", "text is empty").alias("warning"))


def ids_of(tables: dict[str, tuple[DataFrame, str]], column: str, value: str, prefix: bool = False) -> DataFrame:
    """(table, id) of all rows of a product or source in each table; tables maps a name to (rows, id column)."""
    out = None
    for name, (rows, id_col) in tables.items():
        test = source_matches(value, F.col(column)) if prefix else F.col(column) == value
        found = rows.where(test & (strip(F.col(id_col)) != "")).select(F.lit(name).alias("table"), F.col(id_col).cast("string").alias("id")).distinct()
        out = found if out is None else out.unionByName(found)
    return out


def plan_rollup(plan: DataFrame) -> DataFrame:
    """(what, value, n): sources by type and action, and the distinct impacts and tables."""
    def counted(c: str) -> DataFrame:
        return plan.groupBy(F.when(strip(F.col(c)) != "", strip(F.col(c))).otherwise("unknown").alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("what"), "value", "n")

    def listed(c: str) -> DataFrame:
        return plan.select(F.explode(c).alias("value")).where("value <> ''").groupBy("value").agg(F.count("*").alias("n")).select(F.lit(c).alias("what"), "value", "n")

    return counted("source_type").unionByName(counted("suggested_action")).unionByName(listed("impact_types")).unionByName(listed("vector_tables"))


def id_check(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: documents, empty ids, ids that repeat, empty texts."""
    by_id = docs.groupBy(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("k")).agg(F.count("*").alias("n"), F.count_if(strip(F.col(text_col)) == "").alias("e"))
    return by_id.agg(F.sum("n").alias("documents"), F.coalesce(F.sum(F.when(F.col("k") == "", F.col("n"))), F.lit(0)).alias("empty_ids"),
                     F.count_if((F.col("k") != "") & (F.col("n") > 1)).alias("duplicate_ids"), F.sum("e").alias("empty_texts"))


def embedding_stats(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(dim, n, empty_ids, duplicate_ids) of stored vectors by size."""
    by_id = rows.groupBy(F.coalesce(F.size("embedding"), F.lit(0)).alias("dim"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("k")).agg(F.count("*").alias("n"))
    return by_id.groupBy("dim").agg(F.sum("n").alias("n"), F.count_if(F.col("k") == "").alias("empty_ids"), F.count_if(F.col("n") > 1).alias("duplicate_ids"))


def push_outcomes(records: DataFrame, done: DataFrame) -> DataFrame:
    """(source_type, source_doc_id, n_pushed, push_status) of a push; done holds the ids that went through."""
    ok = done.select("doc_id", F.lit(True).alias("ok")).distinct()
    got = records.join(ok, "doc_id", "left").groupBy("source_type", "source_doc_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce("ok", F.lit(False))).alias("n_pushed"))
    return got.select("source_type", "source_doc_id", "n_pushed", F.when(F.col("n_pushed") == F.col("n"), "success").when(F.col("n_pushed") > 0, "partial").otherwise("failed").alias("push_status"))


def report_states(reports: DataFrame, previous: DataFrame, matches: DataFrame) -> DataFrame:
    """(relative_path, status) of each report file: skipped_unchanged, changed (never overwritten), unmatched, extract_failed or success.

    reports: relative_path, source_sha1, n_docs; previous: relative_path, processed_sha1; matches: relative_path, product_id.
    """
    joined = reports.join(previous.select("relative_path", "processed_sha1"), "relative_path", "left").join(matches.select("relative_path", "product_id"), "relative_path", "left")
    old = F.coalesce(F.col("processed_sha1"), F.lit(""))
    return joined.select("relative_path", F.when((old != "") & (old == F.col("source_sha1")), "skipped_unchanged").when(old != "", "changed").when(F.col("product_id").isNull(), "unmatched")
                         .when(F.col("n_docs") == 0, "extract_failed").otherwise("success").alias("status"))


def write_gate(push_table: str, read_table: str, stored_dim: int | None, new_dims: set[int]) -> None:
    """Refuse to write unless the tables agree and the vector size is known and equal."""
    if push_table != read_table:
        raise PermissionError(f"vectors would go to {push_table} but are read from {read_table}")
    if stored_dim is None:
        raise PermissionError("the stored vector size is unknown")
    if new_dims != {stored_dim}:
        raise PermissionError(f"vectors of size {sorted(new_dims)} don't fit the stored size {stored_dim}")


def source_products(*tables: DataFrame) -> DataFrame:
    """(source_file, product_ids, shown): each file's products, sorted; shown names three of them and how many more."""
    rows = tables[0].select("source_file", "product_id")
    for t in tables[1:]:
        rows = rows.unionByName(t.select("source_file", "product_id"))
    got = rows.where((strip(F.col("source_file")) != "") & (strip(F.col("product_id")) != "")).groupBy(posix_path(F.col("source_file")).alias("source_file")).agg(F.array_sort(F.collect_set("product_id")).alias("product_ids"))
    more = F.size("product_ids") - 3
    shown = F.concat(F.array_join(F.slice("product_ids", 1, 3), ","), F.when(more > 0, F.concat(F.lit(",...(+"), more.cast("string"), F.lit(")"))).otherwise(""))
    return got.withColumn("shown", shown)


def source_roots(plan: DataFrame) -> DataFrame:
    """(source_type, root): folders of reports two levels deep, and the workbooks themselves."""
    two = F.array_join(F.slice(F.split("source_path", "/"), 1, 2), "/")
    return plan.where(strip(F.col("source_path")) != "").select("source_type", F.when(F.col("source_type") == "quality_report_pdf", two).otherwise(F.col("source_path")).alias("root")).distinct()


def first_plan_sha1(plan: DataFrame, paths: DataFrame) -> DataFrame:
    """One row: the digest of the first planned row whose path is wanted."""
    return plan.join(paths.select("source_path").distinct(), "source_path", "left_semi").agg(F.min_by("source_sha1", "line").alias("source_sha1"))


def with_fallbacks(files: DataFrame, documents: DataFrame, products: DataFrame) -> DataFrame:
    """(source_file, origin, item): a file's prebuilt documents, else its products, else a needs_mapping row.

    documents and products have source_file and item.
    """
    built = files.join(documents, "source_file").select("source_file", F.lit("document").alias("origin"), "item")
    rest = files.join(documents.select("source_file").distinct(), "source_file", "left_anti")
    made = rest.join(products, "source_file").select("source_file", F.lit("product").alias("origin"), "item")
    none = rest.join(products.select("source_file").distinct(), "source_file", "left_anti").select("source_file", F.lit("needs_mapping").alias("origin"), F.lit(None).cast("string").alias("item"))
    return built.unionByName(made).unionByName(none)


def normalized_source(docs: DataFrame) -> DataFrame:
    """Documents re-keyed to their workbook: source_doc_id product_excel__<sha1>, the old one kept aside."""
    return docs.withColumn("legacy_source_doc_id", F.col("source_doc_id")).withColumn("source_doc_id", F.concat(F.lit("product_excel__"), "source_sha1")).withColumn("source_kind", F.lit("product_excel"))


def running_limit(rows: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    """The first rows over all partitions: the limit is the caller's budget."""
    return rows.orderBy(*order).limit(limit)
