"""Manifest, incremental and change-plan queries; events stand for the manifest log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators import manifest, profile, verify
from quillstone.operators.durable import new_folder
from quillstone.sources import keyed_table

from .registry import query, table


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as manifest records: the user is the source, props.k its digest, the event type its status."""
    e = table(spark, sf_dir, "events")
    sha = F.sha1(F.get_json_object("props", "$.k"))
    status = F.when(F.col("event_type") == "purchase", "success").otherwise(F.col("event_type"))
    return e.select(F.col("event_id").alias("seq"), F.format_string("src%d", "user_id").alias("source_doc_id"), sha.alias("source_sha1"),
                    F.format_string("path/%d", F.col("user_id") % 50).alias("source_path"), F.lit("product_excel").alias("source_type"), status.alias("status"), F.col("ts").alias("updated_at"),
                    F.format_string("prd_%06d", F.col("user_id") % 20).alias("product_id"))


LOG_SQL = """
        WITH m AS (SELECT event_id AS seq, 'src' || user_id AS source_doc_id, sha1(json_extract_string(props, '$.k')) AS source_sha1, 'path/' || (user_id % 50) AS source_path,
                          'product_excel' AS source_type, CASE event_type WHEN 'purchase' THEN 'success' ELSE event_type END AS status, ts AS updated_at FROM events)"""


@query(LOG_SQL + " SELECT source_doc_id, seq, source_sha1, status FROM m QUALIFY row_number() OVER (PARTITION BY source_doc_id ORDER BY updated_at DESC, seq DESC) = 1")
def manifest_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest record of each source."""
    return manifest.latest(log(spark, sf_dir), ["source_doc_id"]).select("source_doc_id", "seq", "source_sha1", "status")


@query(LOG_SQL + " SELECT 'status' AS what, status AS value, count(*) AS n FROM m GROUP BY ALL UNION ALL SELECT 'source_type', source_type, count(*) FROM m GROUP BY ALL")
def manifest_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.rollup(log(spark, sf_dir))


@query(LOG_SQL + " SELECT source_sha1, count(DISTINCT source_doc_id) AS n_values, count(*) AS n_records FROM m WHERE source_sha1 <> '' GROUP BY source_sha1 HAVING n_values > 1")
def manifest_dup_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that more than one source has."""
    return manifest.several(log(spark, sf_dir), "source_sha1", "source_doc_id")


@query(LOG_SQL + " SELECT source_path, count(DISTINCT source_sha1) AS n_values, count(source_sha1) AS n_records FROM m WHERE source_sha1 <> '' GROUP BY source_path HAVING n_values > 1")
def manifest_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths whose content changed."""
    return manifest.several(log(spark, sf_dir), "source_path", "source_sha1")


@query(LOG_SQL + " SELECT seq, source_doc_id, status FROM m ORDER BY updated_at DESC, seq DESC LIMIT 10")
def manifest_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten latest records: a top-k report."""
    return log(spark, sf_dir).orderBy(F.desc("updated_at"), F.desc("seq")).limit(10).select("seq", "source_doc_id", "status")


@query(LOG_SQL + """, p AS (SELECT DISTINCT 'src' || user_id AS source_doc_id, sha1(CAST(user_id % 7 AS VARCHAR)) AS source_sha1, 'path/' || (user_id % 60) AS source_path FROM events
                            UNION ALL SELECT 'new' || doc_id, sha1(CAST(doc_id AS VARCHAR)), 'path/' || (doc_id % 100) FROM documents),
        d AS (SELECT source_doc_id, source_sha1 AS ds, status AS dst FROM m QUALIFY row_number() OVER (PARTITION BY source_doc_id ORDER BY updated_at DESC, seq DESC) = 1),
        h AS (SELECT source_path, source_sha1 AS ps FROM m QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY updated_at DESC, seq DESC) = 1),
        s AS (SELECT source_sha1, max(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS ok FROM m WHERE source_sha1 <> '' GROUP BY source_sha1)
        SELECT source_doc_id, CASE WHEN source_doc_id = '' OR source_sha1 = '' THEN 'unknown' WHEN ds = source_sha1 THEN CASE WHEN dst = 'success' THEN 'unchanged' ELSE 'new' END
            WHEN ds IS NOT NULL THEN 'changed' WHEN ps <> source_sha1 THEN 'changed' WHEN ok = 1 THEN 'duplicate_content' WHEN ok IS NOT NULL THEN 'unknown' ELSE 'new' END AS suggested_action
        FROM p LEFT JOIN d USING (source_doc_id) LEFT JOIN h USING (source_path) LEFT JOIN s USING (source_sha1)""")
def plan_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The action for each planned source against the log."""
    e = table(spark, sf_dir, "events").select("user_id").distinct()
    known = e.select(F.format_string("src%d", "user_id").alias("source_doc_id"), F.sha1((F.col("user_id") % 7).cast("string")).alias("source_sha1"), F.format_string("path/%d", F.col("user_id") % 60).alias("source_path"))
    new = table(spark, sf_dir, "documents").select(F.format_string("new%d", "doc_id").alias("source_doc_id"), F.sha1(F.col("doc_id").cast("string")).alias("source_sha1"),
                                                   F.format_string("path/%d", F.col("doc_id") % 100).alias("source_path"))
    return manifest.plan_actions(known.unionByName(new), log(spark, sf_dir)).select("source_doc_id", "suggested_action")


@query("""WITH x AS (SELECT doc_id, sha1(text) AS h FROM documents), e AS (SELECT doc_id, CASE WHEN quality = 1 THEN h ELSE sha1('old') END AS h FROM x JOIN labels USING (doc_id))
        SELECT x.doc_id, CASE WHEN e.doc_id IS NOT NULL THEN 'changed' ELSE 'new' END AS embedding_plan_status FROM x LEFT JOIN e ON x.doc_id = e.doc_id WHERE e.h IS NULL OR e.h <> x.h""")
def incremental_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that still need an embedding: new ones and those whose content changed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("content_sha1"))
    done = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.col("content_sha1")).otherwise(F.sha1(F.lit("old"))).alias("content_sha1"), F.lit("m").alias("embedding_model"))
    return manifest.embedding_plan(docs, done, "m").select("doc_id", "embedding_plan_status")


@query("""WITH r AS (SELECT doc_id % 5000 AS doc_id, n_chars FROM documents)
        SELECT doc_id, n_chars, count(*) OVER (PARTITION BY doc_id) > 1 AS is_duplicate, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'skip' ELSE 'new' END AS push_action FROM r""")
def push_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's fate against the stored ids."""
    records = table(spark, sf_dir, "documents").select((F.col("doc_id") % 5000).alias("doc_id"), "n_chars")
    return manifest.push_plan(records, table(spark, sf_dir, "labels").select("doc_id")).select("doc_id", "n_chars", "is_duplicate", "push_action")


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'found' END AS status, CAST(CASE WHEN l.doc_id IS NOT NULL AND toxic = 1 THEN 1 ELSE 0 END AS INT) AS warnings
        FROM documents d LEFT JOIN labels l USING (doc_id)""")
def verify_found_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which requested ids are stored, and how many of their required fields are empty."""
    stored = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 0, "x").alias("text"), F.lit("y").alias("model"))
    return manifest.found_missing(table(spark, sf_dir, "documents").select("doc_id"), stored, ["text", "model"])


@query("""SELECT doc_id, 'missing' AS status FROM documents WHERE doc_id NOT IN (SELECT doc_id * 2 FROM labels) UNION ALL
        SELECT DISTINCT doc_id * 2, 'unknown' FROM labels WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)""")
def change_plan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that aren't stored and stored ids that are no target."""
    return manifest.target_diff(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select((F.col("doc_id") * 2).alias("doc_id")))


@query("""WITH r AS (SELECT count(DISTINCT source) AS n_products FROM documents), t AS (SELECT count(DISTINCT doc_id) AS n_targets FROM documents),
        k AS (SELECT count(*) AS n_missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
        SELECT n_products, n_targets, n_missing, 0::BIGINT AS n_unknown, 'delete-source' AS mode, n_targets > 0 AS safe_to_execute,
               CAST((n_missing > 0)::INT + (n_products > 1)::INT AS INT) AS n_risks FROM r, t, k""")
def change_plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delete plan over all documents: counts, risks and whether it is safe."""
    docs = table(spark, sf_dir, "documents")
    plan = manifest.change_plan("delete-source", docs.select(F.col("source").alias("product_id")), docs, table(spark, sf_dir, "labels"))
    return plan.select("n_products", "n_targets", "n_missing", "n_unknown", "mode", "safe_to_execute", F.size("risks").alias("n_risks"))


@query("""WITH k AS (SELECT url AS key, min(page_id) AS source_id FROM pages GROUP BY url UNION ALL SELECT 'p' || page_id, page_id FROM pages),
        d AS (SELECT page_id AS doc_id, unnest(list_distinct([url, 'p' || page_id, CASE WHEN page_id % 10 = 0 THEN 'p' || (page_id + 1) ELSE '' END])) AS key FROM pages),
        c AS (SELECT doc_id, min(source_id) AS lo, max(source_id) AS hi FROM d JOIN k USING (key) WHERE key <> '' GROUP BY doc_id)
        SELECT page_id AS doc_id, CASE WHEN lo = hi THEN lo END AS source_id FROM pages LEFT JOIN c ON page_id = doc_id""")
def unique_match_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages assigned to a source only if exactly one claims them."""
    pages = table(spark, sf_dir, "pages")
    keys = pages.groupBy(F.col("url").alias("key")).agg(F.min("page_id").alias("source_id")).unionByName(pages.select(F.format_string("p%d", "page_id").alias("key"), F.col("page_id").alias("source_id")))
    docs = pages.select(F.col("page_id").alias("doc_id"), F.array("url", F.format_string("p%d", "page_id"), F.when(F.col("page_id") % 10 == 0, F.format_string("p%d", F.col("page_id") + 1)).otherwise("")).alias("keys"))
    return manifest.unique_assignment(docs, keys)


@query("SELECT CAST(len(embedding) AS INT) AS dim, count(*) AS n, count(DISTINCT label) AS n_labels FROM embeddings GROUP BY 1")
def embedding_dim_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.countDistinct("label").alias("n_labels"))


@query("SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AS valid FROM embeddings")
def embedding_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.functions.ids import valid_vector

    return table(spark, sf_dir, "embeddings").select("vec_id", valid_vector(F.col("embedding"), 64).alias("valid"))


RETENTION_SQL = "CASE " + " ".join(f"WHEN regexp_matches(path, '{t}') THEN '{c}/{a}'" for t, c, a in profile.RETENTION) + " ELSE 'keep/keep' END"


@query(f"""WITH p AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'src/a.py' WHEN 1 THEN 'output/acceptance/r.md' WHEN 2 THEN 'output/cleanup/x.txt' WHEN 3 THEN 'output/ingest_push/push_report.json'
            WHEN 4 THEN 'output/cleanup/cleanup_plan.json' WHEN 5 THEN 'a/__pycache__/b.pyc' WHEN 6 THEN 'output/misc_test.jsonl' ELSE 'data/x' || event_id END AS path FROM events)
        SELECT split_part({RETENTION_SQL}, '/', 1) AS category, split_part({RETENTION_SQL}, '/', 2) AS action, count(*) AS n FROM p GROUP BY ALL""")
def retention_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths counted by retention rule."""
    names = ["src/a.py", "output/acceptance/r.md", "output/cleanup/x.txt", "output/ingest_push/push_report.json", "output/cleanup/cleanup_plan.json", "a/__pycache__/b.pyc", "output/misc_test.jsonl"]
    path = F.format_string("data/x%d", "event_id")
    for i, n in reversed(list(enumerate(names))):
        path = F.when(F.col("event_id") % 8 == i, n).otherwise(path)
    r = profile.retention(F.col("path"))
    return table(spark, sf_dir, "events").select(path.alias("path")).select(r.alias("r")).groupBy("r.category", "r.action").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT doc_id, text = '' AS e, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS w FROM documents)
        SELECT CASE WHEN count(*) FILTER (e) > 0 THEN 'blocked' WHEN count(*) FILTER (w) > 0 THEN 'warning' ELSE 'pass' END AS status, count(*) FILTER (e) AS n_empty, count(*) FILTER (w) AS n_warned FROM c""")
def preflight_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked by empty texts, warned by toxic labels, else pass."""
    bad = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("w"))
    one = table(spark, sf_dir, "documents").join(bad, "doc_id", "left").agg(F.count_if(F.col("text") == "").alias("n_empty"), F.count_if(F.coalesce("w", F.lit(False))).alias("n_warned"))
    return one.select(manifest.severity(F.when(F.col("n_empty") > 0, "blocked").otherwise("pass"), F.when(F.col("n_warned") > 0, "warning").otherwise("pass")).alias("status"), "n_empty", "n_warned")


@query("""WITH s AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
        g AS (SELECT user_id, count(*) FILTER (value < p) AS down, count(*) FILTER (value > p) AS up FROM s GROUP BY user_id)
        SELECT user_id, CASE WHEN down > 0 AND up > 0 THEN 'mixed' WHEN down > 0 THEN 'descending' WHEN up > 0 THEN 'ascending' ELSE 'constant' END AS direction FROM g""")
def score_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each user's values fall or rise in time."""
    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("rank"), F.col("value").alias("score"))
    return verify.score_direction(e, "user_id")


@query("""SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS n, event_id FROM events""")
def position_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of each event in its user's order."""
    return table(spark, sf_dir, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("n"), "event_id")


@query("""WITH k AS (SELECT page_id, CASE WHEN url LIKE '%.html' THEN '素材/a.xlsx' WHEN url LIKE '%?%' THEN '质检报告/b.pdf' ELSE 'x/c.txt' END AS path FROM pages)
        SELECT CASE WHEN path LIKE '%.xlsx' THEN 'product_excel' WHEN path LIKE '%.pdf' THEN 'quality_report_pdf' END AS source_type, count(*) AS n,
               CAST(sum(CASE WHEN path LIKE '%.xlsx' THEN 6 WHEN path LIKE '%.pdf' THEN 3 ELSE 0 END) AS BIGINT) AS n_targets FROM k GROUP BY 1""")
def source_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source types with the impacts and tables they reach."""
    path = F.when(F.col("url").endswith(".html"), "素材/a.xlsx").when(F.contains("url", F.lit("?")), "质检报告/b.pdf").otherwise("x/c.txt")
    kinds = table(spark, sf_dir, "pages").select(manifest.source_type(path).alias("source_type"))
    reach = F.size(manifest.impacts(F.col("source_type"))) + F.size(manifest.vector_tables(F.col("source_type")))
    return kinds.groupBy("source_type").agg(F.count("*").alias("n"), F.sum(reach).alias("n_targets"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'new' ELSE d.source END AS source FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.doc_id % 3 <> 0")
def upsert_and_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents replaced, then those divisible by three deleted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    changed = table(spark, sf_dir, "labels").join(docs.select("doc_id"), "doc_id").select("doc_id", F.lit("new").alias("source"))
    return manifest.delete_by_ids(manifest.upsert(docs, changed), docs.where("doc_id % 3 = 0"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'changed' ELSE lang END AS lang, source FROM documents WHERE doc_id % 11 <> 0
        UNION ALL SELECT -1 - doc_id, 'added', source FROM documents WHERE doc_id % 13 = 0""")
def keyed_upsert_and_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucketed table of all documents after an upsert of changed and added rows and a delete."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    kept = keyed_table.create(spark, new_folder(spark, "keyed"), docs.schema, "doc_id")
    keyed_table.upsert(kept, docs)
    added = docs.where("doc_id % 13 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), F.lit("added").alias("lang"), "source")
    keyed_table.upsert(kept, docs.where("doc_id % 7 = 0").withColumn("lang", F.lit("changed")).union(added))
    keyed_table.delete(kept, docs.where("doc_id % 11 = 0").select("doc_id"))
    return keyed_table.read(spark, kept)
