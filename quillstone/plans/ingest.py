"""Chunking, normalisation, profiling and document-building queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import extract, ids, metadata, text
from quillstone.operators import chunking, profile

from .registry import query, table

CHUNKS_SQL = r"""
        WITH t AS (SELECT doc_id, regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS s FROM documents),
        i AS (SELECT doc_id, s, unnest(range(0, length(s), 780)) AS pos FROM t WHERE s <> ''),
        c AS (SELECT doc_id, CAST(pos // 780 AS INT) AS chunk_index, s[pos + 1:pos + 900] AS chunk FROM i)"""


@query(CHUNKS_SQL + " SELECT doc_id, chunk_index, CAST(length(chunk) AS INT) AS char_count, sha1(chunk) AS sha1 FROM c")
def chunk_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 900 characters, 120 shared with the next, of every document."""
    return chunking.chunks(table(spark, sf_dir, "documents")).select("doc_id", "chunk_index", "char_count", "sha1")


@query(CHUNKS_SQL + r""", d AS (SELECT sha1(chunk) AS h, count(*) AS n, count(*) FILTER (regexp_full_match(chunk, '[\s\p{Z}]*')) AS e, count(*) FILTER (length(chunk) < 20) AS s FROM c GROUP BY h)
        SELECT sum(n)::BIGINT AS chunk_count, sum(e)::BIGINT AS empty_text, sum(s)::BIGINT AS too_short, 0::BIGINT AS too_long, count(*) FILTER (n > 1) AS duplicate_hashes FROM d""")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_stats(chunking.chunks(table(spark, sf_dir, "documents")))


@query(CHUNKS_SQL + " SELECT doc_id, chunk_index, row_number() OVER (PARTITION BY sha1(chunk) ORDER BY doc_id, chunk_index) > 1 AS is_repeat FROM c")
def chunk_repeat_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.repeat_flags(chunking.chunks(table(spark, sf_dir, "documents"))).select("doc_id", "chunk_index", "is_repeat")


def cut_sql(name: str, source: str, keys: str, size: int = 950, overlap: int = 120) -> str:
    """Recursive CTEs that end in `name` (keys, k, chunk) of `source` (keys, s: stripped texts that aren't empty); k counts from 0."""
    ends = [f"CASE WHEN contains(w, {s}) AND length(w) - strpos(reverse(w), {s}) + 1 > length({s}) THEN length(w) - strpos(reverse(w), {s}) + 1 END"
            for s in ("chr(10) || chr(10)", "chr(10)", *(f"'{x}'" for x in chunking.SEPARATORS[2:]))]
    end = f"coalesce({', '.join(ends)}, length(w))"
    return f"""
        {name}_a AS (SELECT {keys}, s, 0 AS k, 0::BIGINT AS start, s[1:{size}] AS w, {size} >= length(s) AS final FROM {source}
                     UNION ALL SELECT {keys}, s, k + 1, nxt, s[nxt + 1:nxt + {size}], nxt + {size} >= length(s)
                     FROM (SELECT *, greatest(start + {end} - {overlap}, start + 1) AS nxt FROM {name}_a WHERE NOT final)),
        {name}_b AS (SELECT {keys}, k, regexp_replace(CASE WHEN final THEN w ELSE w[1:{end}] END, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS chunk FROM {name}_a),
        {name} AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY k) - 1 AS k, chunk FROM {name}_b WHERE chunk <> '')"""


STRIPPED_SQL = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


@query(f"WITH RECURSIVE t AS (SELECT doc_id, {STRIPPED_SQL.format('text')} AS s FROM documents WHERE s <> ''), {cut_sql('c', 't', 'doc_id')} SELECT doc_id, CAST(k AS INT) AS chunk_index, chunk FROM c")
def chunk_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks cut at separators."""
    docs = table(spark, sf_dir, "documents")
    return chunking.exploded(docs, chunking.separated(F.col("text")), ["doc_id"])


NORMAL_SQL = STRIPPED_SQL.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\f\x0B]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")


@query(f"""WITH RECURSIVE t AS (SELECT conv_id, turn, {NORMAL_SQL} AS s FROM conversations WHERE s <> ''), {cut_sql('c', 't', 'conv_id, turn')},
        g AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k, chunk) AS n, turn AS page, chunk AS text FROM c),
        r AS (SELECT conv_id, n, text AS held, page AS first, page AS last, NULL::VARCHAR AS o, page AS o_first, page AS o_last FROM g WHERE n = 1
              UNION ALL SELECT conv_id, n, CASE WHEN fits THEN joined WHEN led_fits THEN led ELSE text END, CASE WHEN fits THEN first WHEN led_fits THEN last ELSE page END, page,
                               CASE WHEN NOT fits THEN held END, first, last
              FROM (SELECT g.*, r.held, r.first, r.last, held || chr(10) || chr(10) || g.text AS joined, length(joined) <= 950 AS fits, {STRIPPED_SQL.format('right(held, 120)')} AS tail,
                           tail || chr(10) || chr(10) || g.text AS led, tail <> '' AND length(led) <= 950 AS led_fits FROM r JOIN g ON g.conv_id = r.conv_id AND g.n = r.n + 1)),
        e AS (SELECT conv_id, n, o AS chunk, o_first AS page_start, o_last AS page_end FROM r WHERE o IS NOT NULL
              UNION ALL SELECT conv_id, n + 1, held, first, last FROM r QUALIFY n = max(n) OVER (PARTITION BY conv_id))
        SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY n) - 1 AS INT) AS chunk_index, chunk, CAST(page_start AS INT) AS page_start, CAST(page_end AS INT) AS page_end FROM e""")
def chunk_pages_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as paged documents: turns packed into chunks with their page ranges."""
    pages = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page"), "text")
    return chunking.packed_pages(pages, "conv_id")


@query(r"""SELECT doc_id, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) AS flat, sha1(text)[1:12] AS digest,
        CASE WHEN length(flat) > 60 THEN flat[1:57] || '...' ELSE flat END AS preview FROM documents""")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space collapsed, digest prefix and preview of every document."""
    flat = text.normalize_space(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", flat.alias("flat"), ids.sha1_prefix(F.col("text"), 12).alias("digest"), text.truncate(flat, 60).alias("preview"))


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '\([^)]*\)', '', 'g'), '[^0-9a-z一-鿿]+', '', 'g') AS match_key,
        regexp_replace(lower(p_name), '[·•\s\p{Z}]+', '', 'g') AS name_key, sha1(lower(concat_ws('||', trim(regexp_replace(p_name, '[\s\p{Z}]+', ' ', 'g')), p_brand, '', p_type, '')))[1:20] AS fingerprint FROM part""")
def match_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match key, name key and catalogue fingerprint of every part."""
    c = F.col
    return table(spark, sf_dir, "part").select("p_partkey", text.match_key(c("p_name")).alias("match_key"), text.name_key(c("p_name")).alias("name_key"),
                                               ids.fingerprint(c("p_name"), c("p_brand"), F.lit(""), c("p_type"), F.lit("")).alias("fingerprint"))


@query(r"""WITH t AS (SELECT p_partkey, '名称：' || p_name || '；品牌: ' || p_brand || chr(10) || '规格:' || p_type AS s FROM part)
        SELECT p_partkey, trim(regexp_extract(s, '(?:产品名称|商品名称|酒名|名称|品名)[:：]\s*([^。；;\n，,]{2,80})', 1)) AS product_name,
               trim(regexp_extract(s, '(?:品牌)[:：]\s*([^。；;\n，,]{2,60})', 1)) AS brand, trim(regexp_extract(s, '(?:规格型号|规格|净含量)[:：]\s*([^。；;\n，,]{2,80})', 1)) AS spec FROM t""")
def extract_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled fields read back out of composed text."""
    composed = F.concat(F.lit("名称："), "p_name", F.lit("；品牌: "), "p_brand", F.lit("\n规格:"), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", *(extract.label(composed, f).alias(f) for f in ("product_name", "brand", "spec")))


@query(r"""WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[,\n，、;；]+'), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> '') AS a FROM documents)
        SELECT doc_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i)[1:8], '|') AS tags FROM t""")
def tag_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight distinct tags of each text (the feature keeps eight)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.tags(F.col("text"), 8), "|").alias("tags"))


@query(r"""SELECT doc_id, length(regexp_replace(text, '[\s\p{Z}]', '', 'g')) >= 200 AND length(regexp_replace(text, '[^a-z]', '', 'g')) >= 40 AS good,
        CASE WHEN length(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) > 300 THEN text_300 || '...' ELSE text_300 END AS short
        FROM (SELECT *, regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')[1:300] AS text_300 FROM documents)""")
def truncate_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length gate and 300-character preview of every document (the feature cuts previews)."""
    solid = F.char_length(F.regexp_replace("text", rf"[{text.SPACE}]", "")) >= 200
    letters = F.char_length(F.regexp_replace("text", "[^a-z]", "")) >= 40
    return table(spark, sf_dir, "documents").select("doc_id", (solid & letters).alias("good"), text.shorten(F.col("text"), 300).alias("short"))


@query("""WITH n AS (SELECT count(*) AS n_rows, count(*) FILTER (trim(p_name) <> '') AS a, count(*) FILTER (trim(p_brand) <> '') AS b, count(*) FILTER (p_size IS NOT NULL) AS c FROM part)
        SELECT unnest(['p_name', 'p_brand', 'p_size']) AS field, unnest([a, b, c]) AS n_filled, n_rows, round(unnest([a, b, c]) / greatest(n_rows, 1), 6) AS rate FROM n""")
def profile_fill_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.fill_rate(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_size"])


HEADER = r"regexp_replace({0}, '[\s\p{{Z}}，,：:；;（()）【】\[\]/\\|·•、\-—_]+', '', 'g')"


@query(f"""WITH k AS (SELECT p_partkey, lower({HEADER.format('p_brand')}) AS key_p_brand, lower({HEADER.format('p_type')}) AS key_p_type FROM part)
        SELECT key_p_brand, key_p_type, count(*) AS n, min(p_partkey) AS first_id FROM k WHERE key_p_brand <> '' GROUP BY ALL HAVING count(*) > 1""")
def profile_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.duplicates(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_partkey")


@query("""SELECT c_custkey, CAST((CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) + (CASE WHEN c_mktsegment <> 'BUILDING' THEN 1 ELSE 0 END) AS INT) AS n_filled FROM customer
        WHERE (CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) + (CASE WHEN c_mktsegment <> 'BUILDING' THEN 1 ELSE 0 END) <= 1""")
def profile_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, "x").alias("a"), F.when(F.col("c_mktsegment") != "BUILDING", "x").otherwise("暂无").alias("b"))
    return profile.sparse(rows, ["a", "b"], "c_custkey", 1)


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(CASE WHEN b.name <> '' THEN b.name END, a.name) AS name
        FROM (SELECT p_partkey AS k, p_name AS name FROM part) a FULL JOIN (SELECT s_suppkey * 3 AS k, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS name FROM supplier) b ON a.k = b.k""")
def overlay_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names overlaid by supplier names where those aren't empty."""
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    b = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("k"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise("").alias("name"))
    return profile.overlay(a, b, "k", ["name"])


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_extendedprice DESC, l_discount, l_returnflag, l_linestatus, l_linenumber) = 1""")
def primary_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary line of each order by six keys."""
    order = [-F.col("l_quantity"), -F.col("l_extendedprice"), F.col("l_discount"), F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")]
    return profile.primary(table(spark, sf_dir, "lineitem"), "l_orderkey", order, ["l_partkey", "l_suppkey", "l_linenumber"])


@query("""WITH l AS (SELECT *, CASE WHEN l_linenumber > 3 THEN NULL ELSE l_linenumber END AS n FROM lineitem)
        SELECT count(*) AS n_pairs, sum(a.l_quantity) AS quantity FROM l a JOIN (SELECT l_orderkey, l_suppkey, n, l_partkey FROM l) b
        ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.n IS NOT DISTINCT FROM b.n""")
def composite_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-column equi-join in which null matches null."""
    lines = table(spark, sf_dir, "lineitem").withColumn("n", F.when(F.col("l_linenumber") <= 3, F.col("l_linenumber")))
    a, b = lines.alias("a"), lines.select("l_orderkey", "l_suppkey", "n").alias("b")
    on = (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_suppkey") == F.col("b.l_suppkey")) & F.col("a.n").eqNullSafe(F.col("b.n"))
    return a.join(b, on).agg(F.count("*").alias("n_pairs"), F.sum("a.l_quantity").alias("quantity"))


@query("""SELECT p_brand AS k, array_to_string(list(p_type ORDER BY pos), '|') AS types FROM (SELECT p_brand, p_type, min(p_partkey) AS pos FROM part GROUP BY ALL) GROUP BY p_brand""")
def ordered_unique_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's types in order of first appearance."""
    out = profile.ordered_unique(table(spark, sf_dir, "part"), "p_brand", "p_type", ["p_partkey"])
    return out.select(F.col("p_brand").alias("k"), F.array_join("values", "|").alias("types"))


@query("""WITH f AS (SELECT p_partkey, unnest(['p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS field_name,
                         trim(unnest([p_name, p_brand, p_type, CAST(p_size AS VARCHAR), CAST(p_retailprice AS VARCHAR)])) AS value, unnest([1, 2, 3, 4, 5]) AS n FROM part),
        r AS (SELECT p_partkey, count(*) FILTER (value <> '') <= 1 AS needs_review, coalesce(string_agg(field_name || '：' || value, chr(10) ORDER BY n) FILTER (value <> ''), '') AS whole FROM f GROUP BY p_partkey)
        SELECT p_partkey, 'product_full' AS doc_type, 'full' AS field_name, 0 AS chunk_index, p_partkey || '__product_full' AS doc_id, whole AS text, needs_review FROM r
        UNION ALL SELECT p_partkey, 'product_field', field_name, 0, p_partkey || '__field__' || field_name || '__001', value, needs_review FROM f JOIN r USING (p_partkey) WHERE value <> ''""")
def product_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as documents: one of all fields and one per field."""
    return chunking.fan_out(table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"])


@query("""WITH p AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN left(props, 5) WHEN 2 THEN '{"meta": ' || props || ', "tags": ["a", ' || user_id || '], "event_type": "told"}' ELSE '[' || props || ']' END AS m,
                            CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS event_type FROM events),
        o AS (SELECT *, CASE WHEN json_valid(m) AND json_type(CASE WHEN json_valid(m) THEN m ELSE '0' END) = 'OBJECT' THEN m ELSE '{}' END AS j FROM p)
        SELECT event_id, coalesce(nullif(event_type, ''), json_extract_string(j, '$.event_type')) AS event_type, json_extract_string(j, '$.k') AS k,
               CAST(json_extract_string(j, '$.meta.k') AS BIGINT) AS deep, json_extract_string(j, '$.tags[1]') AS tag FROM o""")
def metadata_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain, malformed, nested and listed metadata of every event, read by path and laid under the row."""
    n, props = F.col("event_id") % 4, F.col("props")
    nested = F.concat(F.lit('{"meta": '), props, F.lit(', "tags": ["a", '), F.col("user_id").cast("string"), F.lit('], "event_type": "told"}'))
    m = F.when(n == 0, props).when(n == 1, F.substring(props, 1, 5)).when(n == 2, nested).otherwise(F.concat(F.lit("["), props, F.lit("]")))
    rows = table(spark, sf_dir, "events").select("event_id", m.alias("m"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")).alias("event_type"))
    out = metadata.overlaid(rows, "m", ["event_type", "k"]).withColumn("v", metadata.metadata(F.col("m")))
    return out.select("event_id", "event_type", "k", metadata.field(F.col("v"), "$.meta.k", "bigint").alias("deep"), metadata.field(F.col("v"), "$.tags[1]").alias("tag"))
