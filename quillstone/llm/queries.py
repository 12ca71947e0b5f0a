"""The corpus operators' queries over their whole tables, with SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, media
from .exact_dedup import exact_dedup
from .importance import importance_resample
from .langid import languages
from .packing import pack_documents
from .periodic_runs import periodic_runs, planted, run_digests
from .sharding import byte_shards
from .simhash import simhash_groups
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .toxicity import toxicity
from .url_filter import url_verdicts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir)).drop("kept")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("text_hash")


def op4_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(documents(spark, sf_dir))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir)).drop("kept")


def op7_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.store(documents(spark, sf_dir)))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(documents(spark, sf_dir)))


def op9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return run_digests(periodic_runs(docs.select("doc_id", planted(docs["doc_id"], docs["text"]).alias("text"))))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.withColumn("n_spans", F.size("spans").cast("long")).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_simhash_groups,
        op2_substring_dedup,
        op3_exact_dedup,
        op4_url_verdicts,
        op5_byte_shards,
        op6_suffix_dedup,
        op7_jpeg_media,
        op8_byte_bpe,
        op9_languages,
        op10_packing,
        op11_periodic_runs,
        op12_importance_resampling,
        op13_toxicity,
    )
}

#: CRC-32 of a list of byte values: the reversed polynomial applied eight times a byte.
CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], {0}),
                     lambda x, c: list_reduce(list_concat([xor(x, c)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295)"""
ID_CRC = CRC.format("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)")
TEXT_BYTES = "list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda b: ('0x' || b)::BIGINT)"


def feature_sql(name: str, key: str, table: str) -> str:
    """CTEs <name>w (id, words) and <name> (id, feature f, its number c)."""
    return rf"""
        {name}w AS (SELECT {key} AS id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
               FROM {table}),
        {name} AS (SELECT id, array_to_string(words[i + 1:i + n], ' ') AS f, count(*) AS c FROM (SELECT id, words, n, unnest(range(len(words) - n + 1)) AS i FROM {name}w, (VALUES (1), (2), (3)) k(n)) GROUP BY ALL)"""


SQL: dict[str, str] = {
    "op2_substring_dedup": r"""
        WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
        w AS (SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS seq
              FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM t WHERE len(words) >= 35)),
        r AS (SELECT doc_id, i FROM w WHERE seq IN (SELECT seq FROM w GROUP BY seq HAVING count(*) > 1)),
        k AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
        a AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS p, unnest(words) AS word FROM t),
        m AS (SELECT a.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS kept FROM a ANTI JOIN k USING (doc_id, p) GROUP BY a.doc_id)
        SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN m USING (doc_id)
    """,
    "op6_suffix_dedup": r"""
        WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM t WHERE length(h) >= 100)),
        f AS (SELECT doc_id, i FROM w JOIN (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1) USING (s) WHERE doc_id > first_id),
        g AS (SELECT doc_id, i, CASE WHEN i > 50 + max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS cut FROM f),
        u AS (SELECT doc_id, i, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
        s AS (SELECT doc_id, min(i) AS lo, max(i) + 50 AS hi FROM u GROUP BY doc_id, run),
        e AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, array_agg(lo ORDER BY lo) AS los, array_agg(hi ORDER BY lo) AS his FROM s GROUP BY doc_id),
        k AS (SELECT doc_id, h, coalesce(n_spans, 0) AS n_spans, coalesce(n_removed, 0) AS n_removed,
                     array_to_string(list_transform(range(1, coalesce(n_spans, 0) + 2), lambda j: substr(h, 2 * coalesce(his[j - 1], 0) + 1,
                         2 * (coalesce(los[j], length(h) // 2) - coalesce(his[j - 1], 0)))), '') AS kept FROM t LEFT JOIN e USING (doc_id))
        SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
               sha256(unhex(kept)) AS kept_sha256 FROM k
    """,
    "op3_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op4_url_verdicts": r"""
        WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        b AS (SELECT page_id, regexp_extract(rest, '^([^?#]*)', 1, 's') AS plain FROM a),
        c AS (SELECT page_id, translate(regexp_extract(plain, '^([^/]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(plain, '^[^/]*(.*)$', 1, 's') AS path FROM b),
        r(rule_host, rule_path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                             ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        m AS (SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
                     arg_max(verdict, length(rule_host || rule_path)) AS verdict
              FROM c JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM c LEFT JOIN m USING (page_id)
    """,
    "op5_byte_shards": f"""
        WITH t AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {CRC.format(TEXT_BYTES.format("coalesce(text, '')"))} AS text_crc32 FROM documents),
        c AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS start, sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id) AS n FROM t),
        s AS (SELECT *, CAST(least(15, (2 * start + size) * 16 // (2 * total)) AS INT) AS shard FROM c)
        SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard, n - min(n) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INT) AS grown_shard FROM s
    """,
    "op11_periodic_runs": rf"""
        WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words, {ID_CRC} AS h FROM documents),
        g AS (SELECT *, h // 10 AS g, len(words) AS n FROM t),
        p AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a, 3 + g % 8 AS times FROM g),
        c AS (SELECT doc_id, CASE WHEN a IS NULL THEN words ELSE list_concat(words[1:a], flatten(list_transform(range(times), lambda k: words[a + 1:a + 1 + (n - a) // times])))[1:n] END AS ws FROM p),
        w AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM c),
        k AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 6], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(len(ws) - 5)) AS i FROM c)),
        e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i),
        s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
        m AS (SELECT doc_id, q, min(i) AS lo, max(i) + 6 + q AS hi FROM s GROUP BY doc_id, q, island HAVING hi - lo >= greatest(12, 2 * q)),
        r AS (SELECT doc_id, lo, hi, min(q) AS q FROM m GROUP BY doc_id, lo, hi),
        b AS (SELECT doc_id, count(*) AS n_runs, min({{'l': lo - hi, 's': lo, 'q': q}}) AS best, string_agg(lo || ',' || (hi - lo) || ',' || q || chr(10), '' ORDER BY lo, q) AS listed FROM r GROUP BY doc_id),
        x AS (SELECT DISTINCT doc_id, unnest(range(lo + q, hi)) AS i FROM r),
        o AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN x USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, -best.l AS length, best.q AS period, 1000 * -best.l // best.q AS exponent_milli,
               sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM c LEFT JOIN b USING (doc_id) LEFT JOIN o USING (doc_id)
    """,
    "op12_importance_resampling": rf"""
        WITH {feature_sql('d', 'doc_id', 'documents')}, {feature_sql('b', 'item_id', 'benchmark')},
        h AS (SELECT f, {CRC.format(TEXT_BYTES.format('f'))} % 10000 AS bucket FROM (SELECT f FROM d UNION SELECT f FROM b)),
        s AS (SELECT bucket, sum(c) AS s FROM d JOIN h USING (f) GROUP BY bucket),
        t AS (SELECT bucket, sum(c) AS t FROM b JOIN h USING (f) GROUP BY bucket),
        g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000))))::BIGINT AS gain
              FROM s FULL JOIN t USING (bucket)),
        v AS (SELECT id, sum(c) AS n_features, sum(c * gain) AS weight FROM d JOIN h USING (f) JOIN g USING (bucket) GROUP BY id),
        o AS (SELECT id AS doc_id, len(words) AS n, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                     (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM dw LEFT JOIN v USING (id)),
        r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM o WHERE n >= 20 QUALIFY rank <= 5 * (SELECT count(*) FROM o WHERE n >= 20) // 100)
        SELECT doc_id, n_features, weight, score, rank FROM o LEFT JOIN r USING (doc_id)
    """,
}
