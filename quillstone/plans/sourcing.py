"""Source identity, build checks, fallbacks and image backfill queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import extract
from quillstone.operators import profile, sourcing

from .registry import query, table


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'given' ELSE '' END AS sid, CASE WHEN doc_id % 3 = 0 THEN sha1(text) ELSE 'x' END AS sh,
                 CASE lang WHEN 'de' THEN 'quality_report' WHEN 'fr' THEN 'product_field' ELSE 'product_full' END AS t, source, lang FROM documents)
        SELECT doc_id, CASE WHEN sid <> '' THEN sid WHEN length(sh) = 40 AND t = 'quality_report' THEN 'pdf__' || sh WHEN t = 'product_field' THEN 'product__' || source || '__' || lang ELSE 'product__' || source END AS source_doc_id,
               CASE t WHEN 'quality_report' THEN 'pdf_quality_report' ELSE 'product_master' END AS source_kind FROM d""")
def source_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source id and kind of each document."""
    d = table(spark, sf_dir, "documents")
    sid = F.when(F.col("doc_id") % 7 == 0, "given").otherwise("")
    sha = F.when(F.col("doc_id") % 3 == 0, F.sha1("text")).otherwise("x")
    kind = F.when(F.col("lang") == "de", "quality_report").when(F.col("lang") == "fr", "product_field").otherwise("product_full")
    return d.select("doc_id", sourcing.text_source_id(sid, sha, F.col("doc_id").cast("string"), kind, F.col("source"), F.col("lang")).alias("source_doc_id"), sourcing.text_source_kind(F.lit(""), kind).alias("source_kind"))


@query(r"""SELECT CASE WHEN doc_id % 11 = 0 THEN '' ELSE CAST(doc_id AS VARCHAR) END AS doc_id, sha1(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS content_sha1,
        CASE WHEN doc_id % 11 = 0 THEN 'missing doc_id' END AS warning, source AS product_id FROM documents""")
def embeddable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents ready to embed, with the reason where they aren't."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.when(F.col("doc_id") % 11 != 0, F.col("doc_id").cast("string")).alias("doc_id"), F.col("text").alias("page_content"), F.create_map(F.lit("product_id"), "source").alias("metadata"))
    return sourcing.embeddable(rows, "text").select("doc_id", "content_sha1", "warning", "product_id")


@query("""SELECT 'documents' AS "table", CAST(doc_id AS VARCHAR) AS id FROM documents WHERE source = 'src1' UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR) FROM pages WHERE 'src' || (page_id % 20) = 'src1'""")
def ids_of_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ids of a product in two tables."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("src"), F.col("page_id") % 20).alias("source"), "page_id")
    return sourcing.ids_of({"documents": (table(spark, sf_dir, "documents"), "doc_id"), "pages": (pages, "page_id")}, "source", "src1")


@query("""SELECT count(*) AS documents, 0::BIGINT AS empty_ids, (SELECT count(*) FROM (SELECT doc_id % 700 AS k FROM documents GROUP BY k HAVING count(*) > 1)) AS duplicate_ids,
        count(*) FILTER (trim(text) = '') AS empty_texts FROM documents""")
def build_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sourcing.id_check(table(spark, sf_dir, "documents").select((F.col("doc_id") % 700).alias("doc_id"), "text"))


@query("""SELECT CAST(len(embedding) AS INT) AS dim, count(*) AS n, 0::BIGINT AS empty_ids, (SELECT count(*) FROM (SELECT vec_id % 300 AS k FROM embeddings GROUP BY k HAVING count(*) > 1)) AS duplicate_ids FROM embeddings GROUP BY 1""")
def embedding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sourcing.embedding_stats(table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 300).alias("doc_id"), "embedding"))


@query("""WITH r AS (SELECT lang, source, doc_id IN (SELECT doc_id FROM labels) AS ok FROM documents)
        SELECT lang AS source_type, source AS source_doc_id, count(*) FILTER (ok) AS n_pushed, CASE WHEN count(*) FILTER (ok) = count(*) THEN 'success' WHEN count(*) FILTER (ok) > 0 THEN 'partial' ELSE 'failed' END AS push_status
        FROM r GROUP BY ALL""")
def push_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each source a push got through."""
    records = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("source_type"), F.col("source").alias("source_doc_id"))
    return sourcing.push_outcomes(records, table(spark, sf_dir, "labels"))


@query("""SELECT url AS relative_path, CASE WHEN page_id % 5 = 0 THEN 'skipped_unchanged' WHEN page_id % 5 = 1 THEN 'changed' WHEN page_id % 5 = 2 THEN 'unmatched' WHEN page_id % 5 = 3 THEN 'extract_failed' ELSE 'success' END AS status
        FROM (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url)""")
def report_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incremental state of each report file."""
    p = table(spark, sf_dir, "pages").groupBy(F.col("url").alias("relative_path")).agg(F.min("page_id").alias("k"))
    reports = p.select("relative_path", F.sha1("relative_path").alias("source_sha1"), F.when(F.col("k") % 5 == 3, 0).otherwise(4).alias("n_docs"))
    previous = p.where("k % 5 < 2").select("relative_path", F.when(F.col("k") % 5 == 0, F.sha1("relative_path")).otherwise("old").alias("processed_sha1"))
    matches = p.where("k % 5 > 2").select("relative_path", F.lit("p1").alias("product_id"))
    return sourcing.report_states(reports, previous, matches)


@query("""WITH s AS (SELECT source AS f, list_sort(list(DISTINCT lang)) AS p FROM documents GROUP BY source)
        SELECT f AS source_file, CAST(len(p) AS INT) AS n, array_to_string(p[1:3], ',') || CASE WHEN len(p) > 3 THEN ',...(+' || (len(p) - 3) || ')' ELSE '' END AS shown FROM s""")
def source_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's products and how they are shown."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("source_file"), F.col("lang").alias("product_id"))
    return sourcing.source_products(d.where("product_id <> 'en'"), d).select("source_file", F.size("product_ids").alias("n"), "shown")


@query("""WITH f AS (SELECT DISTINCT 'src' || (page_id % 25) AS source_file FROM pages), d AS (SELECT source AS source_file, CAST(doc_id AS VARCHAR) AS item FROM documents WHERE lang = 'de'),
        p AS (SELECT source AS source_file, lang AS item FROM documents WHERE lang = 'es')
        SELECT source_file, 'document' AS origin, item FROM f JOIN d USING (source_file) UNION ALL SELECT source_file, 'product', item FROM f JOIN p USING (source_file) WHERE source_file NOT IN (SELECT source_file FROM d)
        UNION ALL SELECT source_file, 'needs_mapping', NULL FROM f WHERE source_file NOT IN (SELECT source_file FROM d) AND source_file NOT IN (SELECT source_file FROM p)""")
def source_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with their documents, else products, else a request to map them."""
    docs = table(spark, sf_dir, "documents")
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("src"), F.col("page_id") % 25).alias("source_file")).distinct()
    return sourcing.with_fallbacks(files, docs.where("lang = 'de'").select(F.col("source").alias("source_file"), F.col("doc_id").cast("string").alias("item")),
                                   docs.where("lang = 'es'").select(F.col("source").alias("source_file"), F.col("lang").alias("item")))


@query("""WITH e AS (SELECT event_id, user_id, event_type, value, CASE WHEN event_type = 'purchase' THEN 'success' ELSE 'failed' END AS st, 'img/' || (event_id % 40) AS path FROM events),
        b AS (SELECT user_id, path FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN st = 'success' THEN 0 ELSE 1 END, -length(event_type), event_id) = 1),
        c AS (SELECT user_id, count(DISTINCT path) AS n, count(*) FILTER (st = 'success') AS ok, count(*) AS a FROM e GROUP BY user_id)
        SELECT user_id AS product_id, CAST(n AS INT) AS image_count, path AS primary_image_path, CASE WHEN ok = a THEN 'all_success' WHEN ok > 0 THEN 'partial_success' ELSE 'all_failed' END AS image_analysis_status FROM b JOIN c USING (user_id)""")
def image_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as products and events as their images: primary image, distinct paths, status."""
    e = table(spark, sf_dir, "events")
    images = e.select(F.col("user_id").alias("product_id"), F.col("event_id").alias("image_index"), F.lit("").alias("anchor_cell"), F.concat(F.lit("img/"), F.col("event_id") % 40).alias("image_path"),
                      F.col("event_type").alias("caption"), F.array().cast("array<string>").alias("tags"), F.lit("").alias("ocr_text"),
                      F.when(F.col("event_type") == "purchase", "success").otherwise("failed").alias("analysis_status"), F.lit(True).alias("has_embedding"), F.lit(True).alias("matched"))
    return profile.image_backfill(images.select("product_id").distinct(), images).select("product_id", "image_count", "primary_image_path", "image_analysis_status")


def letters_sql(c: str) -> str:
    def one(x: str) -> str:
        return f"chr(CAST(65 + {x} AS INT))"

    return (f"CASE WHEN {c} <= 26 THEN {one(f'({c} - 1)')} WHEN {c} <= 702 THEN {one(f'({c} - 27) // 26')} || {one(f'({c} - 27) % 26')} "
            f"ELSE {one(f'({c} - 703) // 676')} || {one(f'({c} - 703) // 26 % 26')} || {one(f'({c} - 703) % 26')} END")


@query(f"""WITH c AS (SELECT l_orderkey % 50 AS sheet, l_linenumber + l_orderkey % 90 AS r, (l_partkey % 800) + 1 AS c FROM lineitem),
        b AS (SELECT sheet, min(r) AS r0, min(c) AS c0, max(r) AS r1, max(c) AS c1 FROM c GROUP BY sheet)
        SELECT sheet, {letters_sql('c0')} || r0 || ':' || {letters_sql('c1')} || r1 AS bounds FROM b""")
def cell_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The A1 range of each sheet's filled cells."""
    lines = table(spark, sf_dir, "lineitem")
    cells = lines.select((F.col("l_orderkey") % 50).alias("sheet"), (F.col("l_linenumber") + F.col("l_orderkey") % 90).alias("row"), (F.col("l_partkey") % 800 + 1).alias("column"), F.lit("x").alias("value"))
    return profile.cell_bounds(cells, ["sheet"])


@query("""SELECT item_id, '净含量：' || (item_id + 1) || 'ml' AS clues FROM benchmark""")
def ocr_clues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clues read from composed OCR text; those a field already holds are left out."""
    ocr = F.concat(F.lit("净含量: "), (F.col("item_id") + 1).cast("string"), F.lit("ml 规格：一箱\n"), F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(extract.ocr_clues(ocr, {"规格": F.lit("一箱装")}), "；").alias("clues"))
