"""Byte-level BPE encoding and decoding over Arrow batches.

Text bytes are mapped to printable characters, one each, so the tokenizers
library sees bytes as characters and its offsets are byte offsets.  Decoding
reverses the table; bytes that a cut of the ids has split from their character
are kept in `decoded` and shown as U+FFFD in `text`.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import CACHES, arrow_map, text_chunks
from .pieces import Pieces, byte_to_char, ranks_tokenizer

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@functools.lru_cache(1)
def codec(path: str, pattern: str) -> Pieces:
    CACHES[__name__] = codec.cache_clear
    return Pieces(ranks_tokenizer(path), pattern)


@functools.lru_cache(2)
def token_bytes(path: str) -> list[bytes]:
    """Bytes of each id; ids without a token are empty."""
    back = {c: b for b, c in enumerate(byte_to_char())}
    vocab = ranks_tokenizer(path).get_vocab()
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(map(back.__getitem__, token))
    return out


def encode(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """One row per input row: doc_id, ids array<int> and, if asked for, starts array<int>.

    starts holds the byte of the text at which each id begins.  Null texts count
    as empty and have no ids.  Null ids and repeated rows are encoded like any
    other row.  Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(path, pattern)
        widths = pieces.lengths() if offsets else None
        for batch in rows:
            texts = batch.column("text")
            for chunk in text_chunks(texts):
                each = pieces.all_ids([t or "" for t in texts.slice(chunk.lo, chunk.hi - chunk.lo).to_pylist()])
                sizes = np.cumsum([0, *map(len, each)]).astype(np.int32)
                flat = np.concatenate([*each, np.zeros(0, "<u4")]).astype(np.int32)
                columns = [batch.column("doc_id").slice(chunk.lo, chunk.hi - chunk.lo), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))]
                if widths is not None:
                    begin = np.cumsum(widths[flat]) - widths[flat]
                    base = np.concatenate([begin, [0]])[np.minimum(sizes[:-1], max(0, len(begin) - 1))]
                    starts = begin - np.repeat(base, np.diff(sizes))
                    columns.append(pa.ListArray.from_arrays(pa.array(sizes), pa.array(starts.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "starts"][:len(columns)])

    schema = f"doc_id {kind}, ids array<int>" + ", starts array<int>" * offsets
    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, schema)


def id_lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    """Ids of each row; null counts as none."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for lo, hi, ok in zip(ends[:-1], ends[1:], column.is_valid().to_pylist(), strict=True):
        yield values[lo:hi] if ok else values[:0]


def decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """One row per input row (doc_id, ids): doc_id, decoded binary, text string."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in rows:
            raw = [b"".join([table[i] for i in ids.tolist()]) for ids in id_lists(batch.column("ids"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(raw, pa.binary()), pa.array([b.decode("utf-8", "replace") for b in raw], pa.string())],
                names=["doc_id", "decoded", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), run, f"doc_id {kind}, decoded binary, text string")


def digests(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """One row per input row (doc_id, ids): n_tokens, SHA-256 of the decimal ids joined by commas and of the decoded bytes."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        decimal = [str(i) for i in range(len(table))]
        for batch in rows:
            sizes, shown, back = [], [], []
            for ids in id_lists(batch.column("ids")):
                each = ids.tolist()
                sizes.append(len(each))
                shown.append(hashlib.sha256(",".join([decimal[i] for i in each]).encode()).hexdigest())
                back.append(hashlib.sha256(b"".join([table[i] for i in each])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(shown, pa.string()), pa.array(back, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(encoded.select("doc_id", "ids"), run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
