"""Vectorised byte-level helpers over Arrow batches of text.

All of them work on one flat uint8 buffer per chunk of documents, so no Python
code runs per character or per word.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The five primes of the XXH64 definition.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))

CHUNK_BYTES = 1 << 19


#: What empties the caches that a Python worker keeps between tasks, by the module whose tasks use them.
CACHES: dict[str, Callable[[], None]] = {}


def release() -> None:
    """Give freed memory back to the system, so that idle Python workers hold little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(f, schema) whose tasks drop other operators' caches first and release what they have freed when they end."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owner in [x for x in CACHES if x != f.__module__]:
            CACHES.pop(owner)()
            gc.collect()
            release()
        try:
            yield from f(rows)
        finally:
            release()

    return df.mapInArrow(run, schema)


class Chunk(NamedTuple):
    """Rows lo..hi of a batch: their concatenated UTF-8 bytes and where each text begins (one more offset than rows)."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES, rows: int = 1 << 14) -> Iterator[Chunk]:
    """Cut a string column into runs of whole texts of about `limit` bytes and at most `rows` rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.type == pa.string() or column.type == pa.large_string() else column.fill_null(b"")
    if column.type in (pa.string(), pa.binary()):
        kind = np.int32
    else:
        kind = np.int64
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + rows)
        yield Chunk(lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


def rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def words8(data: np.ndarray) -> np.ndarray:
    """The little-endian 8-byte word that begins at each position (zeros beyond the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    return np.ascontiguousarray(np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,)))


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[start:start+length] for each pair, as uint64."""
    w8 = words8(data)
    at = start.astype(np.int64).copy()
    left = length.astype(np.int64).copy()
    s = np.uint64(seed)
    acc = np.full(len(at), s + P5, np.uint64)
    with np.errstate(over="ignore"):
        long = np.flatnonzero(left >= 32)
        if len(long):
            v = [np.full(len(long), x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            live = np.arange(len(long))
            while len(live):
                rows = long[live]
                for k in range(4):
                    v[k][live] = rotl(v[k][live] + w8[at[rows] + 8 * k] * P2, 31) * P1
                at[rows] += 32
                left[rows] -= 32
                live = live[left[rows] >= 32]
            h = rotl(v[0], 1) + rotl(v[1], 7) + rotl(v[2], 12) + rotl(v[3], 18)
            for k in range(4):
                h = (h ^ (rotl(v[k] * P2, 31) * P1)) * P1 + P4
            acc[long] = h
        acc += length.astype(np.uint64)
        for _ in range(3):
            live = np.flatnonzero(left >= 8)
            if not len(live):
                break
            acc[live] = rotl(acc[live] ^ (rotl(w8[at[live]] * P2, 31) * P1), 27) * P1 + P4
            at[live] += 8
            left[live] -= 8
        live = np.flatnonzero(left >= 4)
        acc[live] = rotl(acc[live] ^ ((w8[at[live]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
        at[live] += 4
        left[live] -= 4
        for _ in range(3):
            live = np.flatnonzero(left >= 1)
            if not len(live):
                break
            acc[live] = rotl(acc[live] ^ ((w8[at[live]] & np.uint64(0xFF)) * P5), 11) * P1
            at[live] += 1
            left[live] -= 1
        acc ^= acc >> np.uint64(33)
        acc *= P2
        acc ^= acc >> np.uint64(29)
        acc *= P3
        acc ^= acc >> np.uint64(32)
    return acc


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, multiply, shift) for values that are already words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * P1
        x = (x ^ (x >> np.uint64(29))) * P2
        return x ^ (x >> np.uint64(32))


class Words(NamedTuple):
    """Words of a chunk: bytes with one space after each word, word starts and ends there, each document's first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words are maximal runs outside bytes 0x20 and 0x09-0x0D; none spans two texts."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets[:-1]] = True
    solid = ~space
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | begins[:-1]))
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | begins[1:])) + 1
    first = np.searchsorted(start, offsets)
    size = end - start
    to = np.zeros(len(start), np.int64)
    if len(start):
        np.cumsum(size[:-1] + 1, out=to[1:])
        out = np.full(int(to[-1] + size[-1] + 1), 32, np.uint8)
        shift = np.repeat(to - start, size)
        where = np.flatnonzero(solid)
        out[where + shift] = data[where]
    else:
        out = np.zeros(0, np.uint8)
    return Words(out, to, to + size, first)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes unchanged."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def sliced(rows: Iterable[pa.RecordBatch], limit: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of whole rows whose text column holds about `limit` bytes."""
    for batch in rows:
        for chunk in text_chunks(batch.column(text), limit):
            yield batch.slice(chunk.lo, chunk.hi - chunk.lo)


def batches(rows: Iterable[pa.RecordBatch], limit: int = 8 << 20, text: str = "text") -> Iterator[pa.Table]:
    """Join small Arrow batches until their text column holds about `limit` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in rows:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column(text).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
