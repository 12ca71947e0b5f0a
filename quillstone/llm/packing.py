"""Packing by lexical retrieval.

Documents are cut into full windows; what is left of each is packed with its
lexical neighbours.  Document frequencies and lengths are those of the whole
corpus.  Every document joins the centroid, one of a bounded sample of documents,
that BM25 ranks highest for it; range partitions by centroid and by the least hash
of the document's heaviest terms bring neighbours together, and runs of a few
thousand of them are the index's shards.  The seed of a window asks its shard for
unused neighbours, which fill the window greedily.  The last neighbour is cut at
the window's end and what remains of it seeds the next window, so only a shard's
last window has padding.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from .bytesops import CACHES, arrow_map, batches, mix, text_chunks
from .pieces import Pieces, classes
from .scratch import Scratch, parts

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
WINDOW = 1024
END = 0


@functools.lru_cache(1)
def codec(path: str, pattern: str) -> Pieces:
    pieces = Pieces(Tokenizer.from_file(path), pattern, 400_000)
    CACHES[__name__] = forget
    return pieces


def forget() -> None:
    """Let go of the codec, tokenizer and table of classes included."""
    codec.cache_clear()
    classes.cache_clear()


class Statistics(NamedTuple):
    """The corpus's documents, tokens a document, and each token's document frequency."""

    rows: int
    mean: float
    df: np.ndarray

    def idf(self) -> np.ndarray:
        return np.log1p((self.rows - self.df + 0.5) / (self.df + 0.5))


K1, B = 1.2, 0.75


def frequencies(each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, token, times) of all documents' distinct tokens, in order."""
    if not each:
        return (np.zeros(0, np.int64),) * 3
    kind, bits = (np.uint32, 16) if each[0].dtype == np.uint16 and len(each) <= 1 << 16 else (np.uint64, 32)
    doc = np.repeat(np.arange(len(each), dtype=kind), [len(x) for x in each])
    keys, times = np.unique(np.concatenate(each).astype(kind) | doc << kind(bits), return_counts=True)
    return (keys >> kind(bits)).astype(np.int64), (keys & kind((1 << bits) - 1)).astype(np.int64), times


class Index:
    """BM25 postings of some documents, over token ids, by the corpus's statistics."""

    def __init__(self, each: list[np.ndarray], corpus: Statistics, query_terms: int | None) -> None:
        self.n, self.query_terms = len(each), query_terms
        doc, term, times = frequencies(each)
        norm = K1 * (1 - B + B * np.array([len(x) for x in each], np.float64) / max(1.0, corpus.mean))
        weight = corpus.idf()[term] * times * (K1 + 1) / (times + norm[doc])
        self.doc_terms, self.doc_weight = term, weight
        self.doc_first = np.searchsorted(doc, np.arange(self.n + 1))
        order = np.argsort(term, kind="stable")
        self.posting_doc, self.posting_weight = doc[order], weight[order]
        self.term_first = np.searchsorted(term[order], np.arange(len(corpus.df) + 1))

    def heaviest(self, doc: int) -> np.ndarray:
        """The document's tokens of most weight, `query_terms` of them (None: all)."""
        lo, hi = self.doc_first[doc], self.doc_first[doc + 1]
        terms, weight = self.doc_terms[lo:hi], self.doc_weight[lo:hi]
        if self.query_terms is not None and len(terms) > self.query_terms:
            terms = terms[np.argpartition(-weight, self.query_terms)[:self.query_terms]]
        return terms

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """BM25 score of every document for these tokens."""
        spans = [slice(lo, hi) for lo, hi in zip(self.term_first[terms].tolist(), self.term_first[terms + 1].tolist(), strict=True) if hi > lo]
        if not spans:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.posting_doc[s] for s in spans]), np.concatenate([self.posting_weight[s] for s in spans]), self.n)

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a query token with the seed, best first; ties by position."""
        score = self.scores(self.heaviest(seed))
        score[~unused] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def pack(each: list[np.ndarray], corpus: Statistics, window: int = WINDOW, query_terms: int | None = 32) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece of one shard; sequences count from 0."""
    sequence = 0
    rest = np.zeros(len(each), np.int64)
    for i, ids in enumerate(each):
        full = len(ids) // window
        for k in range(full):
            yield i, k * window, window, sequence, 0
            sequence += 1
        rest[i] = full * window
    size = np.array([len(x) for x in each], np.int64)
    unused = rest < size
    index = Index(each, corpus, query_terms)
    following = 0
    seed = -1
    while True:
        if seed < 0:
            while following < len(each) and not unused[following]:
                following += 1
            if following == len(each):
                return
            seed = following
        filled, now, ranked, at = 0, seed, None, 0
        seed_of_window, seed = seed, -1
        while True:
            take = min(window - filled, int(size[now] - rest[now]))
            yield now, int(rest[now]), take, sequence, filled
            rest[now] += take
            filled += take
            unused[now] = False
            if rest[now] < size[now]:
                seed = now
                break
            if filled == window:
                break
            if ranked is None:
                ranked = index.neighbours(seed_of_window, unused)
            if at < len(ranked):
                now = int(ranked[at])
                at += 1
                continue
            while following < len(each) and not unused[following]:
                following += 1
            if following == len(each):
                break
            now = following
        sequence += 1


def pack_documents(docs: DataFrame, path: str = TOKENIZER, pattern: str = PATTERN, window: int = WINDOW, shard_docs: int = 2048, query_terms: int | None = 32,
                   centroids: int = 512, centroid_tokens: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are its text's (null: none) and a closing id 0.  Shards are
    consecutive rows of a range partition, at most `shard_docs` of them or about 4 MB
    of ids; sequence_id has the partition in its upper 32 bits.  A seed asks with its
    `query_terms` heaviest tokens (None: all).  Centroids are at most `centroids`
    sampled documents of at most `centroid_tokens` tokens; they only decide which
    documents meet in a shard.  Repeated rows and null ids are packed like any other
    row; equal texts may lie in several shards.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    size = Tokenizer.from_file(path).get_vocab_size()
    unit = "<u2" if size <= 1 << 16 else "<u4"

    def tokenise(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(path, pattern)
        df = np.zeros(size, np.int64)
        for table in batches(rows):
            for part in text_chunks(table.column("text"), 1 << 20):
                t = table.slice(part.lo, part.hi - part.lo)
                each = [np.append(ids, END).astype(unit) for ids in pieces.chunk_ids(part.data, part.offsets)]
                df += np.bincount(frequencies(each)[1], minlength=size)
                n = len(each)
                yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), pa.array([x.tobytes() for x in each], pa.binary()), pa.array([len(x) for x in each], pa.int64()),
                                                  pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names=["doc_id", "ids", "tokens", "term", "df"])
        term = np.flatnonzero(df).astype(np.int32)
        n = len(term)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, id_type), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.array(term), pa.array(df[term])],
                                         names=["doc_id", "ids", "tokens", "term", "df"])

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    written = scratch.keep(arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), tokenise,
                                     f"doc_id {kind}, ids binary, tokens bigint, term int, df bigint"))
    tokens = written.where("ids IS NOT NULL").select("doc_id", "ids", "tokens")
    found = tokens.agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens")).first()
    df = np.zeros(size, np.int64)
    for r in written.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df")).collect():  # one row a token at most
        df[r["term"]] = r["df"]
    corpus = Statistics(found["rows"], (found["tokens"] or 0) / max(1, found["rows"]), df)
    sample = []
    if corpus.rows > shard_docs:
        share = max(1, corpus.rows // (2 * centroids))
        picked = tokens.where((F.col("tokens") > 1) & (F.col("tokens") <= centroid_tokens) & (F.pmod(F.xxhash64("ids"), F.lit(share)) == 0)).limit(centroids)
        sample = [np.frombuffer(r["ids"], unit) for r in picked.select("ids").collect()]

    def place(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sample, corpus, None)
        for table in batches(rows, 2 << 20, "ids"):
            each = [np.frombuffer(x, unit) for x in table.column("ids").to_pylist()]
            own = Index(each, corpus, 32)
            cluster, near = np.zeros(len(each), np.int32), np.zeros(len(each), np.int64)
            for i in range(len(each)):
                terms = own.heaviest(i)
                near[i] = mix(terms.astype(np.uint64)).min().astype(np.int64)
                if len(sample):
                    cluster[i] = index.scores(terms).argmax()
            yield from pa.table([table.column("doc_id"), table.column("ids"), cluster, near], names=["doc_id", "ids", "cluster", "near"]).to_batches()

    placed = scratch.keep(arrow_map(tokens.select("doc_id", "ids"), place, f"doc_id {kind}, ids binary, cluster int, near bigint"))
    scratch.free(written)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        for table in batches(rows, 4 << 20, "ids"):
            for lo in range(0, table.num_rows, shard_docs):
                part = table.slice(lo, shard_docs)
                each = [np.frombuffer(x, unit) for x in part.column("ids").to_pylist()]
                cut = list(pack(each, corpus, window, query_terms))
                doc, start, length, seq, offset = (np.array(x, np.int64) for x in zip(*cut, strict=True))
                crc = [zlib.crc32(each[d][s:s + n].astype("<u4").tobytes()) for d, s, n, _, _ in cut]
                total = np.array([len(x) for x in each], np.int64)
                ids = part.column("doc_id").combine_chunks().take(pa.array(doc))
                yield from pa.table([ids, start, length, pa.array(crc, pa.int64()), total[doc], seq + sequence, offset], names=names).to_batches()
                sequence += int(seq[-1]) + 1

    # Equal keys, as of copies, are split by the document's own hash.
    order = ["cluster", "near", F.xxhash64("doc_id", "ids")]
    dealt = placed.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order).select("doc_id", "ids")
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return arrow_map(dealt, run, schema)
