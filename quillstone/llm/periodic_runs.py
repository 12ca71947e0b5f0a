"""Runs of words that repeat with a period, found by Main and Lorentz's division on what repeated k-grams leave.

A run of smallest period q and length n >= max(least, 2q) equals itself q words on
over n - q words.  That overlap is at least k = ceil(least / 2) whatever q is, and
overlap and copy cover the run, so each of its words lies in a k-gram that the
document holds more than once.  Words outside such k-grams are masked, and only the
segments between them are divided: a run that crosses a segment's middle m shows for
its period p in how far the words from m and from m + p (or m - p) agree, forwards and
backwards.  Agreement is read from names of the 2^j-grams (equal names, equal
words), so all segments of a chunk, all middles of a depth and all periods are
compared at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesops import Words, arrow_map, batches, split_words, text_chunks

#: Pairs of positions that are compared at a time.
PAIRS = 1 << 18


def named(keys: np.ndarray) -> np.ndarray:
    """Small whole numbers, equal where the keys are."""
    return pd.factorize(keys)[0].astype(np.int64)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of the pairs (a, b) of names below the arrays' length."""
    return named(a * (len(a) + 1) + b)


def ahead(names: np.ndarray, step: int) -> np.ndarray:
    """Each position's name `step` positions on; 0 beyond the end."""
    return np.concatenate([names[step:], np.zeros(min(step, len(names)), np.int64)])


def kgram_names(codes: np.ndarray, k: int) -> np.ndarray:
    """Names of the k-grams that begin at each position (meaningless in the last k - 1)."""
    names, size = codes, 1
    while size < k:
        step = min(size, k - size)
        names, size = paired(names, ahead(names, step)), size + step
    return names


def segments(codes: np.ndarray, first: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of `least` or more words that k-grams occurring twice in their document cover; document i's words are first[i]:first[i + 1]."""
    n = len(codes)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    names = kgram_names(named(codes * len(first) + doc), k)
    whole = np.arange(n) + k <= first[doc + 1] if n else np.zeros(0, bool)
    again = whole & (np.bincount(names[whole], minlength=n + 1)[names] > 1)
    edge = np.zeros(n + k + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + k, -1)
    free = np.cumsum(edge)[:n] > 0
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    start = np.flatnonzero(free & (begins[:-1] | ~np.r_[False, free[:-1]]))
    end = np.flatnonzero(free & (begins[1:] | ~np.r_[free[1:], False])) + 1
    long = end - start >= least
    return start[long], end[long]


class Agreement:
    """How far a text agrees with itself from two positions, by names of its 2^j-grams."""

    def __init__(self, codes: np.ndarray, longest: int) -> None:
        self.levels = [codes]
        while 2 << (len(self.levels) - 1) <= longest:
            names = self.levels[-1]
            self.levels.append(paired(names, ahead(names, 1 << (len(self.levels) - 1))))

    def forwards(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree from i and j on, at most `most` (which stays inside the text)."""
        done = np.zeros(len(i), np.int64)
        for level in reversed(range(len(self.levels))):
            at = np.flatnonzero(done + (1 << level) <= most)
            names = self.levels[level]
            at = at[names[i[at] + done[at]] == names[j[at] + done[at]]]
            done[at] += 1 << level
        return done

    def backwards(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree up to, not including, i and j."""
        done = np.zeros(len(i), np.int64)
        for level in reversed(range(len(self.levels))):
            at = np.flatnonzero(done + (1 << level) <= most)
            names, back = self.levels[level], done[at] + (1 << level)
            at = at[names[i[at] - back] == names[j[at] - back]]
            done[at] += 1 << level
        return done


def crossing(text: Agreement, mid: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool, least: int) -> np.ndarray:
    """(start, end, period) of the repetitions through `mid` whose period lies right (or left) of it, inside the segments lo:hi."""
    other = mid + p if right else mid - p
    low, high = (mid, other) if right else (other, mid)
    # A repetition needs max(p, least - p) agreeing words around the middle, so a pair of them before or after it.
    codes, last = text.levels[0], len(text.levels[0]) - 1
    one, two = (codes[np.minimum(x, last)] for x in (low, high))
    before, after = codes[np.maximum(low - 1, 0)], codes[np.maximum(high - 1, 0)]
    may = ((one == two) & (high < hi)) | ((before == after) & (low > lo))
    low, high, p, lo, hi = (x[may] for x in (low, high, p, lo, hi))
    fore, back = text.forwards(low, high, hi - high), text.backwards(low, high, low - lo)
    found = (fore + back >= p) & (fore + back + p >= least)
    return np.stack([(low - back)[found], (high + fore)[found], p[found]])


def divide(codes: np.ndarray, start: np.ndarray, end: np.ndarray, least: int) -> np.ndarray:
    """(start, end, period) of all runs in the segments start:end of codes, by start, then end; period is the smallest."""
    found = [np.zeros((3, 0), np.int64)]
    text = Agreement(codes, int((end - start).max(initial=0)))
    lo, hi, seg = start, end, np.arange(len(start))
    while len(lo):
        mid = (lo + hi) // 2
        for right in (True, False):
            # A run inside lo:hi fits twice, so its period is at most half.
            reach = (hi - lo) // 2
            cuts = np.concatenate([[0], np.cumsum(reach)])
            at = 0
            while at < len(lo):
                to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + PAIRS, "right")) - 1)
                for first in range(0, int(reach[at:to].max(initial=0)), PAIRS):
                    size = np.clip(reach[at:to] - first, 0, PAIRS)
                    node = np.repeat(np.arange(at, to), size)
                    p = np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size) + first + 1
                    found.append(crossing(text, mid[node], p, start[seg[node]], end[seg[node]], right, least))
                at = to
        lo, hi, seg = np.concatenate([lo, mid]), np.concatenate([mid, hi]), np.concatenate([seg, seg])
        big = hi - lo >= least
        lo, hi, seg = lo[big], hi[big], seg[big]
    s, e, p = np.concatenate(found, axis=1)
    order = np.lexsort((p, e, s))
    s, e, p = s[order], e[order], p[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (e[1:] != e[:-1])][:len(s)]
    return np.stack([s[new], e[new], p[new]])


def word_codes(words: Words) -> np.ndarray:
    """A number for each word, equal where the words' bytes are."""
    if not len(words.start):
        return np.zeros(0, np.int64)
    # Each word is followed by one space in words.data.
    cut = np.append(words.start, len(words.data)).astype(np.int64)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words.start), [None, pa.py_buffer(cut), pa.py_buffer(words.data)])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def runs_of(codes: np.ndarray, first: np.ndarray, least: int = 12) -> np.ndarray:
    """(start, end, period) of all runs of the documents whose words are codes[first[i]:first[i + 1]], in order of start, then period."""
    start, end = segments(codes, first, -(-least // 2), least)
    size = end - start
    to = np.cumsum(size) - size
    held = np.repeat(start - to, size) + np.arange(size.sum())
    s, e, p = divide(named(codes[held]), to, to + size, least)
    shift = (start - to)[np.searchsorted(to, s, "right") - 1] if len(s) else s
    s, e = s + shift, e + shift
    order = np.lexsort((p, s))
    return np.stack([s, e, p])[:, order]


def periodic_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, runs (start, length, period; words are numbered from 0) by start, then period, and collapsed.

    A run is a stretch of words of smallest period q (words q apart are equal) and
    length max(least, 2q) or more that no neighbouring word extends.  collapsed is the
    text's words joined by one space without those that any run contains after its
    first q words.  Words are runs of bytes outside 0x20 and 0x09-0x0D.  A null text
    is empty: no runs, collapsed empty.  Null ids and repeated rows are treated like
    any other row; other columns aren't read.  A text must fit in an Arrow batch.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches(rows):
            for chunk in text_chunks(table.column("text")):
                words = split_words(chunk.data, chunk.offsets)
                s, e, p = runs_of(word_codes(words), words.first, least)
                edge = np.zeros(len(words.start) + 1, np.int64)
                np.add.at(edge, s + p, 1)
                np.add.at(edge, e, -1)
                kept = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
                size = (words.end - words.start + 1)[kept]
                to = np.concatenate([[0], np.cumsum(size)])
                data = words.data[np.repeat(words.start[kept] - to[:-1], size) + np.arange(to[-1])]
                ends = to[np.searchsorted(kept, words.first)]
                # Every kept word brings its space; the last one of a text goes.
                texts = [data[i:max(i, j - 1)].tobytes().decode() for i, j in zip(ends[:-1], ends[1:], strict=True)]
                doc = np.searchsorted(words.first, s, "right") - 1
                cut = np.searchsorted(doc, np.arange(chunk.hi - chunk.lo + 1)).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(x) for x in (s - words.first[doc], e - s, p)], names=["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(cut), items).cast(shape)
                ids = table.column("doc_id").slice(chunk.lo, chunk.hi - chunk.lo)
                yield from pa.table({"doc_id": ids, "runs": runs, "collapsed": pa.array(texts, pa.string())}).to_batches()

    sent = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(sent, run, f"doc_id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The words of text joined by one space; where crc32 of the id ends in 0, a stretch up to the end repeats with a period.

    With h the crc32, g = h / 10 and n words, word i >= a = g % n becomes word a + (i - a) % p for p = 1 + (n - a) / (3 + g % 8).  A null id plants nothing.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    a = F.pmod(g, F.greatest(n, F.lit(1)))
    times = 3 + F.pmod(g, F.lit(8))
    p = 1 + F.floor((n - a) / times)
    # p is over (n - a) / times, so `times` copies of the period reach the end.
    again = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), times.cast("int")))
    changed = F.slice(F.concat(F.slice(words, F.lit(1), a.cast("int")), again), F.lit(1), n)
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), F.array_join(changed, " ")).otherwise(text)


def run_digests(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one (ties: smallest start, then period) and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shortest"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return (found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                         F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
            .select("doc_id", "n_runs", (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.shortest")).alias("period"),
                    F.floor(1000 * F.col("best.length") / -F.col("best.shortest")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256"))
