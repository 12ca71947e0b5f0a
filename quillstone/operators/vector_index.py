"""An inverted-file index over vectors, with product-quantised codes.

Every vector is written under its nearest centroid, one folder a list, so a search
reads the folders of the lists it probes and no others.  Beside the vector lies a code
of one byte a subspace, which a first pass reads instead of the vector; the best
candidates of that pass are scored exactly.  An exact search takes the k-th score
of such a search as a threshold and then visits the lists that the bound q c + |q| r
(centroid c, radius r) doesn't rule out.  Centroids and codebooks are fitted on a
bounded sample; rows appended later go under the same centroids.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors that are scored against queries at a time.
ROWS = 4096
#: Bytes of query vectors (doubles) that are broadcast at a time.
QUERY_BYTES = 32 << 20
#: Bytes of the sample that centroids and codebooks are fitted on.
SAMPLE_BYTES = 48 << 20
#: A score may be this much below a threshold that was computed in another order of additions.
SLACK = 1e-6


class VectorIndex(NamedTuple):
    """Where the index lies, the id's type, centroids (lists x dimensions) and codebooks (subspaces x codes x dimensions of a subspace)."""

    path: str
    id_type: str
    centroids: np.ndarray
    books: np.ndarray

    def rows(self, spark: SparkSession) -> DataFrame:
        """list, id, apart (distance from the centroid), code, vector."""
        schema = f"id {self.id_type}, apart double, code binary, vector array<double>, list int"
        return spark.read.schema(schema).parquet(f"{self.path}/rows")


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of each point's nearest centre."""
    return (points @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1)


def kmeans(points: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """k centres of the points by Lloyd's steps; a centre that loses all its points takes one drawn at random."""
    rng = np.random.default_rng(seed)
    k = min(k, len(points))
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        at = np.concatenate([nearest(points[i:i + ROWS], centres) for i in range(0, len(points), ROWS)])
        order = np.argsort(at, kind="stable")
        live, first = np.unique(at[order], return_index=True)
        centres = points[rng.choice(len(points), k)]
        centres[live] = np.add.reduceat(points[order], first, axis=0) / np.bincount(at, minlength=k)[live][:, None]
    return centres


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a column of lists of `dim` numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vector_col: str, dim: int | None = None) -> DataFrame:
    """(id, vector) of the rows that have an id and a vector of the index's length without nulls."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)")
    return rows.where(F.size("vector") == dim) if dim is not None else rows


def build_index(vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None, subspaces: int = 16,
                sample_rows: int = 20_000) -> VectorIndex:
    """Write an index of all vectors to `path` (a new folder that all executors share).

    There are half as many lists as the square root of the rows, 4,096 at most.  The
    sample is the `sample_rows` (and 48 MB at most) of smallest id hash; its first vector
    sets the length, and rows without an id or of another length aren't indexed.
    """
    found = usable(vectors, id_col, vector_col)
    first = found.orderBy(F.xxhash64("id"), "id").limit(1).collect()
    dim = len(first[0]["vector"]) if first else 1
    found = found.where(F.size("vector") == dim)
    most = max(256, min(sample_rows, SAMPLE_BYTES // (8 * dim)))
    sample = found.orderBy(F.xxhash64("id"), "id").limit(most).select("vector").toArrow()
    points = matrix(sample.column("vector"), dim) if sample.num_rows else np.zeros((1, dim))
    n = found.count()
    centroids = kmeans(points, lists or int(min(4096, max(1, np.ceil(np.sqrt(n) / 2)))))
    while dim % subspaces:
        subspaces -= 1
    rest = (points - centroids[nearest(points, centroids)]).reshape(len(points), subspaces, dim // subspaces)
    books = [kmeans(rest[:, s], 256, 6) for s in range(subspaces)]
    index = VectorIndex(path, found.schema["id"].dataType.simpleString(), centroids, np.stack(books))
    append_vectors(index, found, "id", "vector")
    spark = vectors.sparkSession
    model = [("centroid", i, c.tolist()) for i, c in enumerate(centroids)] + [("book", s, b.ravel().tolist()) for s, b in enumerate(index.books)]
    spark.createDataFrame(model, "kind string, n int, numbers array<double>").coalesce(1).write.parquet(f"{path}/model")
    return index


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """The index that build_index wrote to `path`."""
    rows = spark.read.parquet(f"{path}/model").orderBy("kind", "n").collect()
    centroids = np.array([r["numbers"] for r in rows if r["kind"] == "centroid"])
    books = [np.array(r["numbers"]) for r in rows if r["kind"] == "book"]
    id_type = spark.read.parquet(f"{path}/rows").schema["id"].dataType.simpleString()
    return VectorIndex(path, id_type, centroids, np.stack([b.reshape(-1, centroids.shape[1] // len(books)) for b in books]))


def append_vectors(index: VectorIndex, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
    """Write more vectors under the index's centroids; a list's rows may lie in many files, so a list that holds much of the rows is split."""
    centroids, books = index.centroids, index.books
    dim = centroids.shape[1]

    def assign(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                x = matrix(part.column("vector"), dim)
                at = nearest(x, centroids)
                rest = x - centroids[at]
                pieces = rest.reshape(len(x), len(books), -1)
                code = np.stack([nearest(pieces[:, s], b) for s, b in enumerate(books)], axis=1).astype(np.uint8)
                codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(books)), len(x), [None, pa.py_buffer(np.ascontiguousarray(code))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.linalg.norm(rest, axis=1)), codes, part.column("vector"), pa.array(at.astype(np.int32))],
                                                 names=["id", "apart", "code", "vector", "list"])

    schema = f"id {index.id_type}, apart double, code binary, vector array<double>, list int"
    placed = usable(vectors, id_col, vector_col, dim).mapInArrow(assign, schema)
    placed.hint("rebalance", "list").write.mode("append").partitionBy("list").parquet(f"{index.path}/rows")


def query_blocks(queries: DataFrame, dim: int, query_id: str, query_vector: str) -> Iterator[tuple[list, np.ndarray]]:
    """The queries' ids and vectors, at most QUERY_BYTES of them at a time, dealt by a hash of the id."""
    rows = queries.select(F.col(query_id).alias("id"), F.col(query_vector).cast("array<double>").alias("vector")).where(F.size("vector") == dim)
    n = rows.count()
    blocks = max(1, -(-n * 8 * dim * 11 // (QUERY_BYTES * 10)))
    for b in range(blocks):
        got = rows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        if got.num_rows:
            yield got.column("id").to_pylist(), matrix(got.column("vector"), dim)


def by_list(probed: np.ndarray) -> dict[int, np.ndarray]:
    """The queries (numbers) that visit each list, of a table queries x lists of booleans."""
    return {int(c): np.flatnonzero(probed[:, c]) for c in np.flatnonzero(probed.any(0))}


def stretches(lists: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of equal values, at most ROWS long."""
    cut = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]]) if len(lists) else np.zeros(0, int)
    for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(lists)], strict=True):
        for lo in range(i, j, ROWS):
            yield lo, min(j, lo + ROWS)


def first_pass(index: VectorIndex, spark: SparkSession, q: np.ndarray, probed: np.ndarray, keep: int) -> DataFrame:
    """(query, list, id) of the `keep` best vectors of each query (a number) among its probed lists by their codes."""
    visits = by_list(probed)
    held = spark.sparkContext.broadcast((q, visits, index.centroids, index.books))

    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, visits, centroids, books = held.value
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in rows:
            lists, ids = batch.column("list").to_numpy(), batch.column("id").to_numpy(zero_copy_only=False)
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, len(books))
            for lo, hi in stretches(lists):
                some = visits[int(lists[lo])]
                near = centroids[lists[lo]] + np.concatenate([b[codes[lo:hi, s]] for s, b in enumerate(books)], axis=1)
                scores = q[some] @ near.T
                for i, n in enumerate(some.tolist()):
                    s, at = scores[i], ids[lo:hi]
                    where = np.full(len(s), lists[lo], np.int32)
                    if n in best:
                        s, at, where = (np.concatenate(x) for x in zip(best[n], (s, at, where), strict=True))
                    top = np.argpartition(-s, keep - 1)[:keep] if len(s) > keep else slice(None)
                    best[n] = s[top], at[top], where[top]
        for n, (s, at, where) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), n)), pa.array(where), pa.array(at), pa.array(s)], names=["query", "list", "id", "rough"])

    rows = index.rows(spark).where(F.col("list").isin(*visits)).select("list", "id", "code")
    found = rows.mapInArrow(score, f"query bigint, list int, id {index.id_type}, rough double")
    order = Window.partitionBy("query").orderBy(F.desc("rough"), "id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep).select("query", "list", "id")


def scored(index: VectorIndex, spark: SparkSession, q: np.ndarray, candidates: DataFrame) -> DataFrame:
    """(query, list, id, score) of candidate rows by their vectors."""
    held = spark.sparkContext.broadcast(q)
    dim = q.shape[1]

    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            exact = (held.value[batch.column("query").to_numpy()] * matrix(batch.column("vector"), dim)).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("list"), batch.column("id"), pa.array(exact)], names=["query", "list", "id", "score"])

    met = index.rows(spark).select("list", "id", "vector").join(candidates, ["list", "id"])
    return met.select("query", "list", "id", "vector").mapInArrow(score, f"query bigint, list int, id {index.id_type}, score double")


def reaching(index: VectorIndex, spark: SparkSession, q: np.ndarray, least: np.ndarray) -> dict[int, np.ndarray]:
    """The queries that visit each list which may hold a vector whose score reaches that query's `least`."""
    radius = np.full(len(index.centroids), -np.inf)
    for r in index.rows(spark).groupBy("list").agg(F.max("apart").alias("r")).collect():
        radius[r["list"]] = r["r"]
    bound = q @ index.centroids.T + np.linalg.norm(q, axis=1)[:, None] * radius
    return by_list(bound >= least[:, None] - SLACK)


def beyond(index: VectorIndex, spark: SparkSession, q: np.ndarray, least: np.ndarray) -> DataFrame:
    """(query, list, id, score) of all vectors whose score with a query reaches that query's `least`; lists that can't hold one aren't read."""
    visits = reaching(index, spark, q, least)
    held = spark.sparkContext.broadcast((q, least, visits))
    dim = q.shape[1]

    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, least, visits = held.value
        for batch in rows:
            lists = batch.column("list").to_numpy()
            x = matrix(batch.column("vector"), dim)
            for lo, hi in stretches(lists):
                some = visits[int(lists[lo])]
                for few in np.array_split(some, -(-len(some) // 1024)):
                    scores = q[few] @ x[lo:hi].T
                    n, at = np.nonzero(scores >= least[few][:, None] - SLACK)
                    if len(n):
                        yield pa.RecordBatch.from_arrays([pa.array(few[n]), pa.array(lists[lo + at]), batch.column("id").take(pa.array(lo + at)), pa.array(scores[n, at])],
                                                         names=["query", "list", "id", "score"])

    rows = index.rows(spark).where(F.col("list").isin(*visits)).select("list", "id", "vector")
    return rows.mapInArrow(score, f"query bigint, list int, id {index.id_type}, score double")


def index_topk(index: VectorIndex, queries: DataFrame, k: int, probes: int = 8, exact: bool = False, refine: int = 4, query_id: str = "query_id",
               query_vector: str = "query_vector", id_col: str = "vec_id") -> DataFrame:
    """The k vectors of largest inner product with each query: query_id, vec_id, score (six digits), rank, list; ties by id.

    probes lists of the largest q c are searched by codes and the refine * k best
    candidates scored by their vectors.  With exact=True that only gives a threshold, and
    all lists that may reach it are searched by their vectors: no row is missed.
    Queries without a vector of the index's length find nothing.
    """
    spark = queries.sparkSession
    kind = queries.schema[query_id].dataType
    out = None
    for ids, q in query_blocks(queries, index.centroids.shape[1], query_id, query_vector):
        near = q @ index.centroids.T
        p = min(probes, near.shape[1])
        probed = np.zeros(near.shape, bool)
        np.put_along_axis(probed, np.argpartition(-near, p - 1, axis=1)[:, :p], True, axis=1)
        found = scored(index, spark, q, first_pass(index, spark, q, probed, refine * k))
        if exact:
            least = np.full(len(ids), -np.inf)
            order = Window.partitionBy("query").orderBy(F.desc("score"))
            for r in found.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select("query", "score").collect():
                least[r["query"]] = r["score"]
            found = beyond(index, spark, q, least)
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        top = found.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), f"query bigint, {query_id} {kind.simpleString()}")
        top = top.join(F.broadcast(names), "query").select(query_id, F.col("id").alias(id_col), "score", "rank", "list")
        out = top if out is None else out.union(top)
    schema = f"{query_id} {kind.simpleString()}, {id_col} {index.id_type}, score double, rank int, list int"
    return out if out is not None else spark.createDataFrame([], schema)


def tuned_probes(index: VectorIndex, queries: DataFrame, k: int, share: float = 0.95, most: int = 64, query_id: str = "query_id", query_vector: str = "query_vector") -> int:
    """The fewest probes whose lists hold `share` of the true k best of at most `most` of the queries (those of smallest id hash)."""
    some = queries.orderBy(F.xxhash64(query_id), query_id).limit(most).select(query_id, query_vector)
    held = some.collect()
    place = {}
    for r in held:
        near = index.centroids @ np.asarray(r[query_vector], float)
        place[r[query_id]] = np.argsort(np.argsort(-near, kind="stable"))
    depths = [int(place[r[query_id]][r["list"]]) for r in index_topk(index, some, k, exact=True, query_id=query_id, query_vector=query_vector).collect()]
    return 1 + int(np.sort(depths)[int(np.ceil(share * len(depths))) - 1]) if depths else 1
