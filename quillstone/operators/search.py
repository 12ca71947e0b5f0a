"""Vector, keyword and point scans."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from quillstone.functions.ids import valid_vector
from quillstone.functions.text import safe_text, strip, tokens

#: A query side is broadcast only below this many rows; beyond it Spark chooses the join.
BROADCAST_ROWS = 100_000
#: Query vectors that are broadcast at a time: 80 MB of 1024 numbers each.
QUERY_ROWS = 10_000
#: Scores that are held at a time: 16 MB.
PRODUCT_NUMBERS = 2_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def inner_product(a: Column, b: Column) -> Column:
    """Inner product of two vectors in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_topk(vectors: DataFrame, query: Sequence[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k vectors of largest inner product with a query vector, ties by id; adds score and rank.

    Each task keeps its own best k, so only k rows a task meet at the end.
    """
    q = F.array(*(F.lit(float(x)) for x in query))
    best = vectors.withColumn("score", F.round(inner_product(F.col(vector_col), q), 6)).orderBy(F.desc("score"), id_col).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def rounded(x: np.ndarray) -> np.ndarray:
    """To six digits, halves away from zero; no negative zero."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5), x) / 1e6 + 0.0


def best_of_task(queries: np.ndarray, k: int, rows: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the query, id, score) of the k best of each query over the batches (ids, vectors) of a task.

    Scores are matrix products of a few queries and a batch.  Only those that reach a
    query's k-th best so far are looked at, so a task holds k rows a query and one product.
    """
    n = len(queries)
    least = np.full(n, -np.inf)
    held = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for ids, vectors in rows:
        found = [held]
        step = max(1, PRODUCT_NUMBERS // max(1, len(ids)))
        for at in range(0, n, step):
            scores = queries[at:at + step] @ vectors.T
            floor = least[at:at + step]
            if len(ids) > k:
                open_ = np.isinf(floor)
                if open_.any():
                    floor = floor.copy()
                    floor[open_] = np.partition(scores[open_], -k, axis=1)[:, -k]
            # Scores that round to the same value as the k-th best may still win by their id.
            q, i = np.nonzero(scores >= floor[:, None] - 2e-6)
            found.append((q + at, ids[i], rounded(scores[q, i])))
        q, i, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((i, -score, q))
        q, i, score = q[order], i[order], score[order]
        starts = np.searchsorted(q, np.arange(n))
        place = np.arange(len(q)) - starts[q]
        keep = place < k
        held = q[keep], i[keep], score[keep]
        full = place == k - 1
        least[q[full]] = score[full]
    return held


def vector_topk_join(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
                     query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """The k best vectors of each query of a stated set; exact.  The queries are broadcast as a matrix that every batch of vectors meets.

    More than QUERY_ROWS queries go in blocks, dealt by a hash of the query's id.  Vectors
    and queries that aren't whole (null, of another length, not finite) or have no whole
    number as id are scored one by one.
    """
    head = queries.agg(F.count("*").alias("n"), F.mode(F.size(query_vector)).alias("size")).first()
    n, size = head["n"], max(head["size"] or 0, 0)
    blocks = 1 if n <= QUERY_ROWS else -(-n * 11 // (QUERY_ROWS * 10))  # a tenth more, as a hash deals unevenly
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    numbered = vectors.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")

    def whole(c: str) -> Column:
        return F.coalesce(valid_vector(F.col(c), size), F.lit(False))

    plain = whole(vector_col) & F.col(id_col).isNotNull() & F.lit(numbered)

    def one_by_one(rows: DataFrame, some: DataFrame) -> DataFrame:
        many = some.agg(F.collect_list(F.struct(query_id, query_vector)).alias("qs"))
        return (rows.join(F.broadcast(many)).select(id_col, vector_col, F.explode("qs").alias("q"))
                .select(F.col(f"q.{query_id}"), id_col, F.round(inner_product(F.col(vector_col), F.col(f"q.{query_vector}")), 6).alias("score")))

    def products(some: DataFrame) -> DataFrame:
        asked = some.select(query_id, F.col(query_vector).cast("array<double>").alias(query_vector)).toArrow()
        held = vectors.sparkSession.sparkContext.broadcast((asked.column(query_id).combine_chunks(), matrix(asked.column(query_vector).combine_chunks(), size)))
        schema = StructType([queries.schema[query_id], vectors.schema[id_col], StructField("score", DoubleType())])
        kinds = to_arrow_schema(schema)

        def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in rows:
                if batch.num_rows:
                    yield batch.column(0).cast(pa.int64()).to_numpy(), matrix(batch.column(1), size)

        def stream(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked_ids, asked_vectors = held.value
            q, ids, scores = best_of_task(asked_vectors, k, batches(rows))
            columns = asked_ids.take(pa.array(q)), pa.array(ids), pa.array(scores)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

        return vectors.where(plain).select(id_col, vector_col).mapInArrow(stream, schema)

    def best(some: DataFrame) -> DataFrame:
        scored = products(some.where(whole(query_vector))).union(one_by_one(vectors.where(~plain), some)).union(one_by_one(vectors.where(plain), some.where(~whole(query_vector))))
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    out = best(queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == 0))
    for i in range(1, blocks):
        out = out.union(best(queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == i)))
    return out


def matrix(column: pa.ListArray, size: int) -> np.ndarray:
    """The vectors of a column without nulls, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def keyword_bm25(docs: DataFrame, queries: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text", query_id: str = "query_id",
                 query_text: str = "query_text", all_terms: bool = False, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best documents of each query by BM25: (query_id, doc_id, score, rank); ties by doc_id.

    all_terms asks for documents with every query term (AND); else any will do.
    Only the queries' terms are joined, after each document has counted its own;
    documents are read once for the statistics and once for the postings.
    """
    terms = queries.select(query_id, F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
    words = docs.select(doc_id, tokens(F.col(text)).alias("words"))
    stats = words.agg(F.count("*").alias("n_docs"), F.avg(F.size("words")).alias("avg_len"))
    wanted = small(terms.select("term").distinct())
    # An outer explode brings no filter on the token array, which would tokenise every text twice.
    postings = (words.select(doc_id, F.size("words").alias("len"), F.explode_outer("words").alias("term")).join(wanted, "term", "left_semi")
                .groupBy(doc_id, "len", "term").agg(F.count("*").alias("tf")))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    weighted = (terms.join(df, "term").join(F.broadcast(stats))
                .withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    # One row per query term, so the terms' number bounds it; counting the rows themselves would read the documents.
    weights = F.broadcast(weighted) if terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else weighted
    scored = (postings.join(weights, "term").groupBy(query_id, doc_id)
              .agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("hits")))
    if all_terms:
        need = terms.groupBy(query_id).agg(F.count("*").alias("need"))
        scored = scored.join(small(need), query_id).where(F.col("hits") == F.col("need"))
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), doc_id)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query_id, doc_id, "score", "rank")


def point_lookup(rows: DataFrame, ids: DataFrame, id_col: str, with_vector: bool = True, vector_col: str = "embedding") -> DataFrame:
    """Rows of the given ids; the vector column is left out unless asked for."""
    found = rows.join(small(ids.select(id_col).distinct()), id_col, "left_semi")
    return found if with_vector or vector_col not in rows.columns else found.drop(vector_col)


def enrich(rows: DataFrame, fetched: DataFrame, id_col: str = "id") -> DataFrame:
    """Left join that fills only missing values (null, empty or the text null) and adds the columns rows lacks; score is never filled."""
    extra = fetched.select(id_col, *(F.col(c).alias(f"fetched_{c}") for c in fetched.columns if c != id_col)).dropDuplicates([id_col])
    joined = rows.join(extra, id_col, "left")
    out = []
    for c in rows.columns:
        if c in fetched.columns and c not in (id_col, "score"):
            missing = F.col(c).isNull() | strip(F.col(c)).isin("", "null") if rows.schema[c].dataType.typeName() == "string" else F.col(c).isNull()
            out.append(F.when(missing, F.col(f"fetched_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out, *(F.col(f"fetched_{c}").alias(c) for c in fetched.columns if c not in rows.columns))


def probes(rows: DataFrame, wanted: DataFrame, id_col: str = "doc_id", keyword_k: int = 20) -> DataFrame:
    """Candidate rows of each wanted product by product_id, then by barcode, then by keywords; the first way that found a row is kept.

    wanted has key, product_id, barcode and words.
    """
    by_id = rows.join(wanted.select("key", "product_id"), "product_id").select("key", id_col, F.lit(1).alias("way"))
    by_code = rows.where(strip(F.col("barcode")) != "").join(wanted.select("key", "barcode"), "barcode").select("key", id_col, F.lit(2).alias("way"))
    found = keyword_bm25(rows.select(id_col, "source_text"), wanted.select(F.col("key").alias("query_id"), F.col("words").alias("query_text")), keyword_k,
                         id_col, "source_text").select(F.col("query_id").alias("key"), id_col, F.lit(3).alias("way"))
    return by_id.unionByName(by_code).unionByName(found).groupBy("key", id_col).agg(F.min("way").alias("way"))


def flatten_result(row: DataFrame) -> DataFrame:
    """Search results with a `fields` struct: its members win over outer columns; score falls back to __score__, then _score."""
    inner = row.schema["fields"].dataType.fieldNames()
    outer = [c for c in row.columns if c != "fields" and c not in inner]
    out = row.select("fields.*", *outer)
    if "score" not in out.columns:
        backups = [F.col(c) for c in ("__score__", "_score") if c in out.columns]
        out = out.withColumn("score", F.coalesce(*(F.when(c != 0, c) for c in backups)) if backups else F.lit(None).cast("double"))
    return out


def query_string(field: str, c: Column, default_op: str = "OR") -> Column:
    """The terms of a text joined by an operator, for logs and exports."""
    return F.concat(F.lit(f"{field}: "), F.array_join(tokens(safe_text(c)), f" {default_op} "))
