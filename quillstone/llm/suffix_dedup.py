"""Suffix-array deduplication by longest-previous-factor arrays.

The suffixes that begin a window are sorted by prefix doubling.  In suffix order
the nearest entries before and after that belong to an earlier document (previous
and next smaller values) give the longest previous factor: the longest match with
anything earlier, compared byte by byte up to the window's length.  Where it
reaches that length, the later copy goes and the first stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytesops import arrow_map, text_chunks, words8
from .passages import Group, Spec, covered, ragged, removals


def dense(values: np.ndarray) -> np.ndarray:
    """Rank of each value among the distinct ones."""
    order = np.argsort(values)
    v = values[order]
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(np.r_[False, v[1:] != v[:-1]]) if len(v) else 0
    return out


def suffix_order(text: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """start's suffixes in the order of their first `length` bytes; ranks of longer and longer prefixes, two or three of the last length each."""
    padded = np.concatenate([text, np.zeros(length, np.uint8)])
    rank, span = dense(words8(padded)[:len(padded)].byteswap()), 8
    bits = len(padded).bit_length()
    times = 3 if 3 * bits <= 63 else 2

    def joined(at: np.ndarray, shifts: list[int]) -> np.ndarray:
        key = rank[at]
        for s in shifts:
            key = key << bits | rank[np.minimum(at + s, len(padded) - 1)]
        return key

    while times * span < length:
        rank = dense(joined(np.arange(len(padded)), [span * i for i in range(1, times)]))
        span *= times
    return np.argsort(joined(start, [span] * (2 * span < length) + [length - span]))


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """Nearest position before each with a smaller value, or -1; by pointer jumping."""
    p = np.arange(len(values)) - 1
    while True:
        jump = np.flatnonzero((p >= 0) & (values[p] >= values))
        if not len(jump):
            return p
        p[jump] = p[p[jump]]


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Bytes that the suffixes at a and b share, `most` at most; words are the 8-byte words at each position."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for step in range(0, most, 8):
        differ = words[a[live] + step] ^ words[b[live] + step]
        low = differ & (~differ + np.uint64(1))  # the lowest bit that differs, in the first byte that differs
        out[live] += np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8)
        live = live[differ == 0]
    return np.minimum(out, most)


def longest_previous(text: np.ndarray, start: np.ndarray, owner: np.ndarray, most: int) -> np.ndarray:
    """The longest previous factor of each suffix, `most` at most: its longest match with one whose document (owner is its rank) is earlier."""
    order = suffix_order(text, start, most)
    words = words8(np.concatenate([text, np.zeros(most, np.uint8)]))
    ranks, at = owner[order], start[order]
    with np.errstate(over="ignore"):
        before = previous_smaller(ranks)
        after = len(ranks) - 1 - previous_smaller(ranks[::-1])[::-1]
        factor = np.zeros(len(order), np.int64)
        for near, have in ((before, before >= 0), (after, after < len(ranks))):
            i = np.flatnonzero(have)
            factor[i] = np.maximum(factor[i], common_prefix(words, at[i], at[near[i]], most))
    out = np.empty(len(order), np.int64)
    out[order] = factor
    return out


def resolve(group: Group, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """Windows of each piece that a document of smaller rank has; the suffixes of a piece that later documents have too are entered twice."""
    again = np.repeat(group.later, group.n)
    start, owner = ragged(group.begin, group.n), np.repeat(group.rank, group.n)
    factor = longest_previous(group.blob, np.concatenate([start, start[again]]), np.concatenate([owner, owner[again] + 1]), spec.window)
    later = np.zeros(len(start), bool)
    later[again] = factor[len(start):] >= spec.window
    return factor[:len(start)] >= spec.window, later


def remaining(text: str, pairs: list[bytes] | None, window: int) -> tuple[bytes, int, bytes]:
    """A text's bytes, the number of its maximal removed runs, and the bytes that remain."""
    raw = text.encode()
    lo, hi = covered(pairs, window)
    edges = [0, *np.stack([lo, hi], 1).ravel().tolist(), len(raw)]
    return raw, len(lo), b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])


def pieces(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with little text each, so that results are passed on in small batches."""
    for batch in rows:
        for chunk in text_chunks(batch.column("text")):
            yield batch.slice(chunk.lo, chunk.hi - chunk.lo)


def found_in(docs: DataFrame, window: int, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return removals(docs, Spec(False, window, 16), True, resolve, "suffix", id_col, text_col, 1 << 17, keep)


def suffix_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes).

    Each byte covered by a `window`-byte string that also starts in a document of
    smaller id goes.  Null texts count as empty; null ids are larger than all
    others and equal among themselves; rows of equal id don't remove each other.
    Texts shorter than the window stay whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(rows):
            each = [remaining(t, p, window) for t, p in zip(batch.column("text").to_pylist(), batch.column("data").to_pylist(), strict=True)]
            raw, spans, kept = zip(*each, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array([len(r) - len(k) for r, k in zip(raw, kept, strict=True)], pa.int64()),
                 pa.array(spans, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return arrow_map(found_in(docs, window, id_col, text_col), cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def remaining_text(kept: bytes) -> str:
    """The remaining bytes as text, without the parts of characters that a cut has split."""
    return kept.decode("utf-8", "ignore")


def without_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The input's rows and columns with repeated passages cut from the text, and length_col, if given, set to its characters.

    Rows nothing was cut from stay as they are, null texts included.  Parts of characters that a cut has split go.
    """
    names = tuple(docs.columns)
    sent = [f"kept_{i}" for i in range(len(names))]
    where, size = names.index(text_col), names.index(length_col) if length_col is not None else None
    schema = ", ".join(f"{s} {docs.schema[c].dataType.simpleString()}" for s, c in zip(sent, names, strict=True))

    def put(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(rows):
            columns = [batch.column(s) for s in sent]
            pairs = batch.column("data").to_pylist()
            if any(pairs):
                before = columns[where].to_pylist()
                after = [remaining_text(remaining(t, p, window)[2]) if p else t for t, p in zip(before, pairs, strict=True)]
                columns[where] = pa.array(after, columns[where].type)
                if size is not None:
                    columns[size] = pa.array([len(t) if p else n for t, p, n in zip(after, pairs, columns[size].to_pylist(), strict=True)], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names=sent)

    return arrow_map(found_in(docs, window, id_col, text_col, names), put, schema).toDF(*names)
