"""Substring deduplication by suffix automata of reference shards.

Reference shards are the distinct pieces that can repeat at all (see ``passages``),
each with its number of occurrences, whole groups of one anchor; a shard holds
about `shard_bytes` or one group of at most FREQUENT pieces.  A shard's automaton
counts the occurrences of every word sequence in it; streaming the pieces through
it gives matching statistics, which alone decide the windows to remove.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytesops import arrow_map, split_words, text_chunks
from .passages import Group, Spec, covered, removals


class SuffixAutomaton:
    """Suffix automaton of several sequences of non-negative numbers, with weighted occurrence counts."""

    def __init__(self, sequences: Sequence[Sequence[int]], weights: Sequence[int]) -> None:
        step: list[dict[int, int]] = [{}]
        link, size, count = [-1], [0], [0]
        last = 0
        for i, (sequence, weight) in enumerate(zip(sequences, weights, strict=True)):
            for symbol in (*sequence, -1 - i):  # a number of its own ends each sequence
                now = len(step)
                step.append({})
                size.append(size[last] + 1)
                link.append(0)
                count.append(weight)
                p = last
                while p >= 0 and symbol not in step[p]:
                    step[p][symbol] = now
                    p = link[p]
                if p >= 0:
                    q = step[p][symbol]
                    if size[q] == size[p] + 1:
                        link[now] = q
                    else:
                        clone = len(step)
                        step.append(step[q].copy())
                        size.append(size[p] + 1)
                        link.append(link[q])
                        count.append(0)
                        while p >= 0 and step[p].get(symbol) == q:
                            step[p][symbol] = clone
                            p = link[p]
                        link[q] = link[now] = clone
                last = now
        for v in sorted(range(1, len(step)), key=size.__getitem__, reverse=True):
            if link[v] > 0:
                count[link[v]] += count[v]
        self.step, self.link, self.size, self.count = step, link, size, count

    def statistics(self, sequence: Sequence[int], window: int) -> Iterator[tuple[int, int]]:
        """For each position: the longest match that ends there, `window` at most, and its occurrences."""
        step, link, size, count = self.step, self.link, self.size, self.count
        state = matched = 0
        for symbol in sequence:
            while state and symbol not in step[state]:
                state = link[state]
                matched = size[state]
            if symbol in step[state]:
                state = step[state][symbol]
                matched += 1
            if matched > window:
                matched = window
            while state and size[link[state]] >= matched:
                state = link[state]
            yield matched, count[state] if state else 0


def resolve(group: Group, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """Windows of each piece that occur again, in another piece of the shard or in another copy of this one."""
    numbers: dict[bytes, int] = {}
    raw = group.blob.tobytes()
    sequences = [[numbers.setdefault(w, len(numbers)) for w in raw[b:b + s].split(b" ")] for b, s in zip(group.begin.tolist(), group.size.tolist(), strict=True)]
    automaton = SuffixAutomaton(sequences, group.count.tolist())
    out = np.zeros(int(group.n.sum()), bool)
    at = 0
    for sequence, n in zip(sequences, group.n.tolist(), strict=True):
        seen = [matched == spec.window and times > 1 for matched, times in automaton.statistics(sequence, spec.window)]
        out[at:at + n] = seen[spec.window - 1:]
        at += n
    return out, out


def substring_dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and kept (remaining words joined by one space).

    Words are runs outside bytes 0x20 and 0x09-0x0D, unchanged.  Each word covered
    by a `window`-word sequence that also starts anywhere else, in the same
    document too, goes; so of repeated passages no copy stays.  Null texts have no
    words; repeated rows remove each other.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found = removals(docs, Spec(True, window, 8), False, resolve, "substring", id_col, text_col, 1 << 18)

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            pairs = batch.column("data").to_pylist()
            out = []
            for chunk in text_chunks(batch.column("text")):
                words = split_words(chunk.data, chunk.offsets)
                raw = words.data.tobytes()
                for d in range(chunk.hi - chunk.lo):
                    first, n = int(words.first[d]), int(words.first[d + 1] - words.first[d])
                    lo, hi = covered(pairs[chunk.lo + d], window)
                    edges = [0, *np.stack([lo, hi], 1).ravel().tolist(), n]
                    parts = [(first + a, first + b - 1) for a, b in zip(edges[::2], edges[1::2], strict=True) if b > a]
                    kept = b" ".join([raw[words.start[a]:words.end[b]] for a, b in parts])
                    out.append((n, int((hi - lo).sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            if out:
                n_words, removed, sha, kept_text = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha), pa.array(kept_text, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return arrow_map(found, cut, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
