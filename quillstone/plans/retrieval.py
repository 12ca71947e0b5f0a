"""Retrieval queries on the driver's tables: documents are text rows, source the product, lang the document type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators import answer, bundle, fusion, keyword_index, search, vector_index, verify
from quillstone.operators.durable import new_folder

from .registry import query, table, texts

#: The queries' fixed question: words that the sample documents have.
QUESTION = "the and ing"
TOKENS = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def bm25_sql(name: str, docs: str, queries: str, k: int, all_terms: bool = False) -> str:
    """CTEs that end in `name` (query_id, doc_id, score, rank)."""
    need = f"JOIN (SELECT query_id, count(*) AS need FROM {name}_q GROUP BY query_id) USING (query_id) WHERE hits = need" if all_terms else ""
    return f"""
        {name}_w AS (SELECT doc_id, {TOKENS.format('text')} AS words FROM {docs}),
        {name}_s AS (SELECT count(*) AS n, avg(len(words)) AS a FROM {name}_w),
        {name}_q AS (SELECT query_id, unnest(list_distinct({TOKENS.format('query_text')})) AS term FROM {queries}),
        {name}_p AS (SELECT doc_id, len(words) AS l, term, count(*) AS tf FROM (SELECT doc_id, words, unnest(words) AS term FROM {name}_w)
                     WHERE term IN (SELECT term FROM {name}_q) GROUP BY ALL),
        {name}_d AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
        {name}_t AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score, count(*) AS hits
                     FROM {name}_q JOIN {name}_d USING (term) JOIN {name}_p USING (term), {name}_s GROUP BY query_id, doc_id),
        {name} AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {name}_t {need}) WHERE rank <= {k})"""


def vector_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    q = vectors.where("vec_id = 0").first()["embedding"]
    return search.vector_topk(vectors, q, k)


def question(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, QUESTION)], "query_id int, query_text string")


def hits(spark: SparkSession, sf_dir: str, dense: int = 50, keyword: int = 50) -> DataFrame:
    """Both routes of the flagship query: vectors (label is the product) and keywords (source is the product)."""
    v = vector_hits(spark, sf_dir, dense).select(F.lit("dense").alias("route"), F.col("rank"), F.concat(F.lit("src"), F.col("label")).alias("product_id"),
                                                 F.col("vec_id").alias("doc_id"), F.lit("").alias("source_text"))
    docs = texts(spark, sf_dir)
    k = search.keyword_bm25(docs, question(spark), keyword).join(docs.select("doc_id", "source", "text"), "doc_id")
    k = k.select(F.lit("keyword").alias("route"), "rank", F.col("source").alias("product_id"), "doc_id", F.col("text").alias("source_text"))
    return v.unionByName(k)


VECTOR_SQL = """
        q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
        vs AS (SELECT vec_id, label, round(list_inner_product(embedding::DOUBLE[], v), 6) AS score FROM embeddings, q),
        vt AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM vs QUALIFY rank <= {0})"""
HITS_SQL = f"""
        WITH {VECTOR_SQL.format(50)}, question AS (SELECT 1 AS query_id, '{QUESTION}' AS query_text),
        {bm25_sql('kw', 'documents', 'question', 50)},
        hits AS (SELECT 'dense' AS route, 1 AS route_order, rank, 'src' || label AS product_id, vec_id AS doc_id, '' AS source_text FROM vt
                 UNION ALL SELECT 'keyword', 2, rank, source, doc_id, text FROM kw JOIN documents USING (doc_id))"""


@query(HITS_SQL + """, f AS (SELECT product_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min({'o': route_order, 'r': rank}) AS seen, count(DISTINCT route) AS n_routes FROM hits GROUP BY product_id)
        SELECT product_id, round(score, 6) AS score, CAST(n_routes AS INT) AS n_routes, CAST(row_number() OVER (ORDER BY round(score, 12) DESC, seen, product_id) AS INT) AS final_rank
        FROM f QUALIFY final_rank <= 30""")
def rrf_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector and keyword routes fused by reciprocal ranks; the best 30 products."""
    fused = fusion.fuse(hits(spark, sf_dir))
    top = fused.orderBy(*fusion.fused_order(fused)).limit(30)
    return top.select("product_id", F.round("score", 6).alias("score"), F.size("routes").alias("n_routes"),
                      F.row_number().over(Window.orderBy(*fusion.fused_order(top))).alias("final_rank"))


def question_hits(spark: SparkSession, sf_dir: str, most: int = 50) -> DataFrame:
    """Both routes of every benchmark passage: by its words, and by the vector of its number."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    vectors, docs = table(spark, sf_dir, "embeddings"), texts(spark, sf_dir)
    shown = asked.join(vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), "query_id")
    v = search.vector_topk_join(vectors, shown.select("query_id", "query_vector"), most).join(vectors.select("vec_id", "label"), "vec_id")
    v = v.select("query_id", F.lit("dense").alias("route"), "rank", F.concat(F.lit("src"), F.col("label")).alias("product_id"))
    k = search.keyword_bm25(docs, asked, most).join(docs.select("doc_id", "source"), "doc_id")
    return v.unionByName(k.select("query_id", F.lit("keyword").alias("route"), "rank", F.col("source").alias("product_id")))


@query(f"""WITH qs AS (SELECT item_id AS query_id, text AS query_text FROM benchmark), {bm25_sql('kw', 'documents', 'qs', 50)},
        qv AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON vec_id = item_id),
        vs AS (SELECT query_id, vec_id, label, round(list_inner_product(embedding::DOUBLE[], v), 6) AS score FROM embeddings, qv),
        vt AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM vs QUALIFY rank <= 50),
        hits AS (SELECT query_id, 'dense' AS route, 1 AS o, rank, 'src' || label AS product_id FROM vt UNION ALL SELECT query_id, 'keyword', 2, rank, source FROM kw JOIN documents USING (doc_id)),
        f AS (SELECT query_id, product_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min({{'o': o, 'r': rank}}) AS seen, count(DISTINCT route) AS n_routes FROM hits GROUP BY ALL)
        SELECT query_id, product_id, round(score, 6) AS score, CAST(n_routes AS INT) AS n_routes,
               CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen, product_id) AS INT) AS final_rank FROM f QUALIFY final_rank <= 30""")
def rrf_every_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search of all benchmark passages in one plan: each query's 30 best products."""
    fused = fusion.fuse_queries(question_hits(spark, sf_dir))
    return fused.select("query_id", "product_id", F.round("score", 6).alias("score"), F.size("routes").alias("n_routes"), "final_rank")


@query(HITS_SQL + " SELECT product_id, route, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS route_score, CAST(min(rank) AS INT) AS best_rank FROM hits GROUP BY ALL")
def rrf_route_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.route_maps(hits(spark, sf_dir)).withColumn("route_score", F.round("route_score", 6))


@query(HITS_SQL + """, d AS (SELECT product_id, route, doc_id, source_text, route_order, rank, row_number() OVER (PARTITION BY product_id ORDER BY route_order, rank) AS n FROM hits WHERE source_text <> '')
        SELECT product_id, CAST(count(*) FILTER (n <= 8) AS INT) AS n_hits, arg_min(doc_id, n) AS first_doc, sum(doc_id * n) FILTER (n <= 8)::BIGINT AS order_sum FROM d GROUP BY product_id""")
def nested_first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight distinct hits of each product in arrival order."""
    rows = hits(spark, sf_dir).withColumns({c: F.lit("") for c in ("image_id", "image_path", "image_url")})
    nested = fusion.nested_hits(rows).where("doc_hits IS NOT NULL")
    return nested.select("product_id", F.size("doc_hits").alias("n_hits"), F.col("doc_hits")[0]["doc_id"].alias("first_doc"),
                         F.aggregate("doc_hits", F.lit(0).cast("long"), lambda s, h: s + h["doc_id"] * h["n"]).alias("order_sum"))


@query(HITS_SQL + """, h AS (SELECT product_id, route_order * 1000 + rank AS o, 's' || doc_id % 5 AS sdoc, CASE WHEN doc_id % 3 = 0 THEN 'i' || doc_id ELSE '' END AS image_id,
                 CASE WHEN doc_id % 3 = 0 THEN 'p' || doc_id % 4 ELSE '' END AS path, 'f' || doc_id % 7 AS file, doc_id % 2 = 0 AS report FROM hits),
        i AS (SELECT product_id, sdoc, path, arg_min(image_id, o) AS id, min(o) AS o FROM h WHERE image_id <> '' GROUP BY ALL),
        r AS (SELECT product_id, sdoc, file, min(o) AS o FROM h WHERE report GROUP BY ALL),
        ii AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY o) AS n FROM i QUALIFY n <= 8), rr AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY o) AS n FROM r QUALIFY n <= 8),
        iii AS (SELECT product_id, string_agg(id, ',' ORDER BY n) AS images, arg_min(path, n) AS first_image_path FROM ii GROUP BY product_id),
        rrr AS (SELECT product_id, string_agg(sdoc || '/' || file, ',' ORDER BY n) AS reports, arg_min(file, n) AS best_report FROM rr GROUP BY product_id)
        SELECT product_id, images, first_image_path, reports, best_report FROM iii FULL JOIN rrr USING (product_id)""")
def nested_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and reports of each product's hits, each once, in arrival order."""
    d = F.col("doc_id")
    shown = d % 3 == 0
    told = {"doc_type": F.when(d % 2 == 0, "quality_report").otherwise("product_full"), "source_doc_id": F.concat(F.lit("s"), d % 5), "source_file": F.concat(F.lit("f"), d % 7)}
    rows = hits(spark, sf_dir).withColumns({
        "image_id": F.when(shown, F.concat(F.lit("i"), d)).otherwise(""), "image_path": F.when(shown, F.concat(F.lit("p"), d % 4)).otherwise(""), "image_url": F.lit(""),
        "metadata": F.create_map(*(x for k, v in told.items() for x in (F.lit(k), v)))})
    report = F.transform("pdf_reports", lambda r: F.concat_ws("/", r["source_doc_id"], r["pdf_path"]))
    return fusion.nested_resources(rows).select("product_id", F.array_join("images.image_id", ",").alias("images"), "first_image_path", F.array_join(report, ",").alias("reports"),
                                                F.col("best_pdf_hit.pdf_path").alias("best_report"))


@query(f"WITH {VECTOR_SQL.format(20)} SELECT vec_id, label, score, CAST(rank AS INT) AS rank FROM vt")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors of largest inner product with vector 0."""
    return vector_hits(spark, sf_dir, 20).select("vec_id", "label", "score", "rank")


#: The query set of the searches by example: every row whose id is divisible by 50, against all rows.
EXAMPLES_SQL = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
        s AS (SELECT query_id, vec_id, round(list_inner_product(embedding::DOUBLE[], v), 6) AS score FROM embeddings, q)
        SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s QUALIFY rank <= 30"""


def examples(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query(EXAMPLES_SQL)
def vector_topk_by_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 nearest of every stored vector that serves as an example (ids divisible by 50: the stated query set)."""
    vectors = table(spark, sf_dir, "embeddings")
    return search.vector_topk_join(vectors, examples(vectors), 30)


@query(EXAMPLES_SQL)
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from an inverted-file index of all vectors, searched exactly."""
    vectors = table(spark, sf_dir, "embeddings")
    index = vector_index.build_index(vectors, new_folder(spark, "vectors"))
    return vector_index.index_topk(index, examples(vectors), 30, exact=True).drop("list")


@query()
def vector_index_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the lists that hold 95 % of the nearest of up to 64 of the examples, by codes first."""
    vectors = table(spark, sf_dir, "embeddings")
    index = vector_index.build_index(vectors, new_folder(spark, "vectors"))
    probes = vector_index.tuned_probes(index, examples(vectors), 30)
    return vector_index.index_topk(index, examples(vectors), 30, probes).drop("list")


@query(f"WITH qs AS (SELECT item_id AS query_id, text AS query_text FROM benchmark), {bm25_sql('kw', 'documents', 'qs', 10)} SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM kw")
def keyword_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark passage by any of its words."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return search.keyword_bm25(texts(spark, sf_dir), queries, 10)


@query(f"WITH qs AS (SELECT item_id AS query_id, text AS query_text FROM benchmark), {bm25_sql('kw', 'documents', 'qs', 10)} SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM kw")
def keyword_index_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as keyword_bm25 from a stored inverted index, whose second half is appended to the first."""
    docs = texts(spark, sf_dir).select("doc_id", "text")
    index = keyword_index.build_keyword_index(docs.where("doc_id % 2 = 0"), new_folder(spark, "words"))
    keyword_index.append_documents(index, docs.where("NOT doc_id % 2 <=> 0"))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return keyword_index.keyword_topk(index, queries, 10)


@query(f"WITH qs AS (SELECT 1 AS query_id, '{QUESTION}' AS query_text), {bm25_sql('kw', 'documents', 'qs', 50, True)} SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM kw")
def keyword_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have every word of the question."""
    return search.keyword_bm25(texts(spark, sf_dir), question(spark), 50, all_terms=True)


@query("""SELECT l.doc_id, quality, CASE WHEN toxic = 1 THEN 'flagged' ELSE d.lang END AS lang, d.source FROM labels l LEFT JOIN documents d USING (doc_id)""")
def point_fetch_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rows whose missing language and product come from the fetched documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", F.when(F.col("toxic") == 1, "flagged").otherwise("null").alias("lang"))
    fetched = search.point_lookup(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), labels, "doc_id")
    return search.enrich(labels, fetched, "doc_id")


def bundle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels as bundle rows: languages stand for document types, a toxic label asks for review."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    kind = F.when(F.col("lang") == "en", "product_full").when(F.col("lang") == "fr", "product_field").when(F.col("lang") == "de", "quality_report").otherwise("supplement")
    field = F.when(F.col("doc_id") % 3 == 0, "packaging").when(F.col("doc_id") % 3 == 1, "sell_point").otherwise("gift")
    return d.select(F.col("source").alias("product_id"), "doc_id", kind.alias("doc_type"), field.alias("field_name"), F.when(F.col("toxic") == 1, "needs_review").otherwise("").alias("status"), "text")


BUNDLE_SQL = """
        WITH b AS (SELECT source AS product_id, doc_id, CASE lang WHEN 'en' THEN 'product_full' WHEN 'fr' THEN 'product_field' WHEN 'de' THEN 'quality_report' ELSE 'supplement' END AS doc_type,
                          CASE doc_id % 3 WHEN 0 THEN 'packaging' WHEN 1 THEN 'sell_point' ELSE 'gift' END AS field_name, coalesce(toxic, 0) AS toxic, text
                   FROM documents LEFT JOIN labels USING (doc_id)),
        k AS (SELECT *, CASE WHEN doc_type = 'quality_report' THEN 'quality_reports' WHEN doc_type = 'supplement' THEN 'supplements' WHEN doc_type = 'product_full' THEN 'basic_info'
                             WHEN field_name = 'packaging' THEN 'packaging' WHEN field_name = 'sell_point' THEN 'selling_points' ELSE 'gift_attributes' END AS section FROM b WHERE toxic = 0)"""


@query(BUNDLE_SQL + """ SELECT product_id, section, count(*) AS n_docs, min(doc_id) AS first_doc, CAST(least(count(*), 120) AS INT) AS n_kept FROM k GROUP BY product_id, section""")
def bundle_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product's documents by section."""
    out = bundle.bundles(bundle_rows(spark, sf_dir))
    return out.select("product_id", "section", "n_docs", F.col("doc_ids")[0].alias("first_doc"), F.size("doc_ids").alias("n_kept"))


@query(BUNDLE_SQL + r""", v AS (SELECT product_id, doc_id, doc_type, trim(regexp_replace(split_part(text, chr(10), 1), '[\s\p{Z}]+', ' ', 'g')) AS value FROM b),
        o AS (SELECT product_id, arg_min(value, doc_id) AS old_value FROM v WHERE doc_type IN ('product_full', 'product_field') AND value <> '' GROUP BY product_id)
        SELECT product_id, 'product_name' AS field, old_value, value AS supplement_value, doc_id AS supplement_doc_id, 'high' AS severity
        FROM o JOIN v USING (product_id) WHERE doc_type = 'supplement' AND value <> '' AND lower(old_value) <> lower(value)""")
def bundle_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplements whose first line contradicts the product's first known one."""
    from quillstone.functions.text import normalize_space

    rows = bundle_rows(spark, sf_dir)
    name = normalize_space(F.split("text", "\n")[0])
    return bundle.conflicts(rows.select("product_id", "doc_id", "doc_type", F.lit("product_name").alias("field"), name.alias("value")))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused candidates with a stand-in rerank score that has ties and near-ties."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    routes = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("dense"), F.lit("image_text"))).otherwise(F.array(F.lit("dense")))
    return d.select("doc_id", (F.col("n_chars") % 7 * 0.1 + F.col("doc_id") % 2 * 1e-8).alias("rerank_score"), F.lit(0.0).alias("rrf_score"),
                    (1.0 / (60 + F.col("doc_id") % 11)).alias("score"), routes.alias("routes"), F.when(F.col("quality") == 1, "x.png").otherwise("").alias("best_image_path"),
                    F.col("doc_id").alias("input_rank"))


CANDIDATES_SQL = """
        WITH c AS (SELECT doc_id, n_chars % 7 * 0.1::DOUBLE + doc_id % 2 * 1e-8::DOUBLE AS rerank_score, 1.0::DOUBLE / (60 + doc_id % 11) AS rrf, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS routes,
                          CASE WHEN quality = 1 THEN 1 ELSE 0 END AS img FROM documents JOIN labels USING (doc_id))"""


@query(CANDIDATES_SQL + """ SELECT doc_id, CAST(row_number() OVER (ORDER BY round_even(rerank_score / 1e-6, 0) DESC, routes DESC, img DESC, rrf DESC, doc_id) AS INT) AS final_rank
        FROM c QUALIFY final_rank <= 10""")
def rerank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rerank_order(candidates(spark, sf_dir), 10).select("doc_id", "final_rank")


@query(CANDIDATES_SQL + " SELECT doc_id, round(rrf, 6) AS final_score, CAST(row_number() OVER (ORDER BY doc_id) AS INT) AS final_rank FROM c QUALIFY final_rank <= 10")
def rerank_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fallback_order(candidates(spark, sf_dir), 10).select("doc_id", F.round("final_score", 6).alias("final_score"), "final_rank")


@query("""WITH i AS (SELECT 'src' || (page_id % 25) AS product_id, arg_min(url, page_id) AS path, min(page_id) AS p FROM pages GROUP BY 1),
        s AS (SELECT DISTINCT source AS product_id FROM documents)
        SELECT product_id, coalesce(path, '') AS best_image_path, coalesce('img://' || (SELECT page_id FROM pages WHERE page_id = p), '') AS best_image_url FROM s LEFT JOIN i USING (product_id)""")
def best_resource_first_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products without an image of their own get their index's primary image and its url."""
    pages = table(spark, sf_dir, "pages")
    index = pages.groupBy(F.concat(F.lit("src"), F.col("page_id") % 25).alias("product_id")).agg(F.min_by("url", "page_id").alias("primary_path"))
    index = index.withColumn("paths", F.array("primary_path"))
    urls = pages.groupBy(F.col("url").alias("path")).agg(F.concat(F.lit("img://"), F.min("page_id")).alias("url"))
    products = table(spark, sf_dir, "documents").select(F.col("source").alias("product_id")).distinct().withColumns({"best_image_path": F.lit(""), "best_image_url": F.lit("")})
    return bundle.image_enrichment(products, index, urls).select("product_id", "best_image_path", "best_image_url")


@query(f"""WITH chosen AS (SELECT doc_id, text FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
        qs AS (SELECT doc_id AS query_id, substr(trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g')), 1, 80) AS qt, CASE WHEN qt <> '' THEN qt ELSE CAST(doc_id AS VARCHAR) END AS query_text FROM chosen),
        {bm25_sql('kw', 'documents', 'qs', 5)}
        SELECT c.doc_id, rank IS NOT NULL AS hit, CAST(rank AS INT) AS rank FROM chosen c LEFT JOIN kw ON kw.query_id = c.doc_id AND kw.doc_id = c.doc_id""")
def self_retrieval_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each well-rated document is among the five best for its own first 80 characters."""
    docs = texts(spark, sf_dir)
    checked = docs.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return verify.self_retrieval(docs, checked)


@query(HITS_SQL + """, f AS (SELECT product_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min({'o': route_order, 'r': rank}) AS seen FROM hits GROUP BY product_id),
        p AS (SELECT product_id, row_number() OVER (ORDER BY round(score, 12) DESC, seen, product_id) AS product_rank FROM f QUALIFY product_rank <= 10),
        d AS (SELECT product_id, doc_id, row_number() OVER (PARTITION BY product_id ORDER BY route_order, rank) AS n FROM hits WHERE source_text <> '' QUALIFY n <= 8)
        SELECT CAST(row_number() OVER (ORDER BY product_rank, n) AS INT) AS rank, product_id, doc_id FROM p JOIN d USING (product_id) QUALIFY rank <= 20""")
def retrieval_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the ten best products, one a row, the first 20."""
    rows = hits(spark, sf_dir).withColumns({c: F.lit("") for c in ("image_id", "image_path", "image_url")})
    fused = fusion.fuse(rows)
    top = fused.orderBy(*fusion.fused_order(fused)).limit(10)
    top = top.withColumn("product_rank", F.row_number().over(Window.orderBy(*fusion.fused_order(top))))
    return fusion.flatten(top.join(fusion.nested_hits(rows), "product_id", "left"), 20).select("rank", "product_id", "doc_id")


@query()
def answer_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rerank text, context and sources of the five best products."""
    rows = hits(spark, sf_dir).withColumns({c: F.lit("") for c in ("image_id", "image_path", "image_url")})
    fused = fusion.fuse(rows)
    top = fused.orderBy(*fusion.fused_order(fused)).limit(5)
    top = top.withColumn("product_rank", F.row_number().over(Window.orderBy(*fusion.fused_order(top))))
    full = answer.context(answer.rerank_text(top.join(fusion.nested_hits(rows), "product_id", "left")))
    return full.select("product_rank", "product_id", "product_name", "rerank_text", "context_text")


@query()
def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline answer from the five best products."""
    ranked = answer_context(spark, sf_dir).withColumnRenamed("context_text", "best_text")
    return answer.extractive_answer(ranked)
