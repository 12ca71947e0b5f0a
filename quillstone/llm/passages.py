"""Passages that repeat across a corpus: the distributed part of both passage deduplicators.

A document is a sequence of units (bytes or words) and a passage is a window of a
fixed number of them.  Each window chooses an anchor, the k-gram in it with the
least hash, so equal windows choose equal anchors; windows with the same anchor
occurrence form a piece.  Hashes only rule out pieces that can't repeat: those
whose anchor no other piece has.  A resolver (suffix automaton or suffix array)
judges every window that is removed, from its content.  Three steps:

1. ``seeds``: pieces are dealt out by anchor hash, packed in arrays.  Equal ones of
   a batch go once; the resolver judges the others in the batch.  Pieces that occur
   twice or share their anchor with other pieces are asked for.
2. ``gather``: they are dealt out again, one of each class of equal pieces with its
   content, and the resolver judges each anchor's classes together.  Anchors of
   over FREQUENT classes are dealt window by window, so that no group fills a task.
3. ``removals`` brings the judged windows back to their documents.

Classes of equal pieces are told apart by two 64-bit hashes.  Everything is keyed
by the document's rank (its id's place; null last) and a hash of its text, so
repeated rows get equal results.  No step caps a group or drops a row.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import P1, P2, Chunk, arrow_map, batches, mix, rotl, sliced, split_words, text_chunks, words8, xxh64
from .scratch import Scratch, parts

LAST = (1 << 63) - 1
LOW = np.uint64(0xFFFFFFFF)
BASE = np.uint64(0x9E3779B97F4A7C15)
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


class Spec(NamedTuple):
    """What a passage is: `window` units, found by `gram` of them; `words` or bytes."""

    words: bool
    window: int
    gram: int


class Units(NamedTuple):
    """Units of a chunk: value of each, first unit of each document, and the byte spans they cover."""

    value: np.ndarray
    first: np.ndarray
    data: np.ndarray
    start: np.ndarray | None
    end: np.ndarray | None

    def span(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte range of units lo..hi-1."""
        return (lo, hi) if self.start is None else (self.start[lo], self.end[hi - 1])


class Pieces(NamedTuple):
    """Pieces of a chunk: document, first window (unit in chunk), windows, anchor hash, content hash."""

    doc: np.ndarray
    lo: np.ndarray
    n: np.ndarray
    h: np.ndarray
    ph: np.ndarray


def units_of(chunk: Chunk, spec: Spec) -> Units:
    if not spec.words:
        return Units(chunk.data, chunk.offsets, chunk.data, None, None)
    w = split_words(chunk.data, chunk.offsets)
    return Units(xxh64(w.data, w.start, w.end - w.start), w.first, w.data, w.start, w.end)


def gram_hashes(units: Units, k: int) -> np.ndarray:
    """Hash of the k units from each position on; meaningless where fewer are left.  k is a power of two, 16 at least for bytes."""
    with np.errstate(over="ignore"):
        if units.value.dtype == np.uint8:
            g, span = words8(units.value)[:len(units.value)] * P1, 8
        else:
            g, span = units.value, 1
        while span < k:
            right = np.zeros_like(g)
            right[:max(0, len(g) - span)] = g[span:]
            g = g * P1 + rotl(right * P2, 31)
            g ^= g >> np.uint64(32)
            span *= 2
        return mix(g)


@functools.lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2 to the 64th."""
    with np.errstate(over="ignore"):
        both = []
        for x in (int(BASE), pow(int(BASE), -1, 1 << 64)):
            p = np.full(n, x, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        return both[0], both[1]


class Contents:
    """Polynomial hashes of unit ranges, from prefix sums."""

    def __init__(self, value: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            power, self.inverse = powers(1 << (len(value) + 1).bit_length())
            self.total = np.zeros(len(value) + 1, np.uint64)
            each = BYTE_VALUES[value] if value.dtype == np.uint8 else mix(value)
            np.cumsum(each * power[:len(value)], out=self.total[1:])

    def hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[hi] - self.total[lo]) * self.inverse[lo] + (hi - lo).astype(np.uint64))


def pieces_of(units: Units, spec: Spec) -> tuple[Pieces, Contents | None]:
    """Group each document's windows by the leftmost least k-gram in them."""
    n, none = len(units.value), np.zeros(0, np.int64)
    if n < spec.window:
        return Pieces(none, none, none, none.astype(np.uint64), none.astype(np.uint64)), None
    g = gram_hashes(units, spec.gram)
    least = (g & ~LOW) | np.arange(n, dtype=np.uint64)
    wide, span = spec.window - spec.gram + 1, 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[:span - wide], least[wide - span:])
    size = np.diff(units.first)
    open_ = np.zeros(n + 1, np.int32)
    long = size >= spec.window
    np.add.at(open_, units.first[:-1][long], 1)
    np.add.at(open_, units.first[1:][long] - spec.window + 1, -1)
    at = np.flatnonzero(np.cumsum(open_[:len(least)]))
    if not len(at):
        return Pieces(none, none, none, none.astype(np.uint64), none.astype(np.uint64)), None
    anchor = (least[at] & LOW).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    lo, count = at[head], np.diff(np.append(head, len(at)))
    doc = np.searchsorted(units.first, lo, "right") - 1
    contents = Contents(units.value)
    return Pieces(doc, lo, count, g[anchor[head]], contents.hash(lo, lo + count + spec.window - 1)), contents


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, group of each ordered row, first ordered row of each group) by the keys together, the first key foremost."""
    order = np.argsort(keys[0])
    k = keys[0][order]
    new = np.ones(len(order), bool)
    new[1:] = k[1:] != k[:-1]
    if len(keys) > 1 and len(order):
        alone = new.copy()
        alone[:-1] &= new[1:]
        at = np.flatnonzero(~alone)  # only rows that share the first key need the others
        rows = order[at]
        rows = rows[np.lexsort((*(key[rows] for key in keys[:0:-1]), np.cumsum(new)[at]))]
        order[at] = rows
        for key in keys[1:]:
            k = key[order]
            new[1:] |= k[1:] != k[:-1]
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


def ragged(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices lo[0].., lo[1].., each `size` long."""
    if not len(lo):
        return np.zeros(0, np.int64)
    begin = np.cumsum(size) - size
    return np.repeat(lo - begin, size) + np.arange(int(size.sum()))


def ranked(docs: DataFrame, id_col: str, scratch: Scratch) -> DataFrame | None:
    """(id, place) for ids that aren't integers: places are in the ids' order; None for integers, which are their own place."""
    if docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return None
    ids = docs.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct().orderBy("id")
    return scratch.keep(ids.withColumn("place", F.monotonically_increasing_id()))


def keyed(docs: DataFrame, id_col: str, text_col: str, places: DataFrame | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, rank, th, text, kept_0...: the rows under the key that all steps use; null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"), *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)))
    if places is None:
        return rows.withColumn("rank", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
    joined = rows.join(places, rows["doc_id"] == places["id"], "left")
    return joined.withColumn("rank", F.coalesce("place", F.lit(LAST))).drop("id", "place")


def packed(dealt: int, slot: np.ndarray, doc: np.ndarray, rank: np.ndarray, th: np.ndarray, columns: dict[str, np.ndarray],
           known: bool, blob: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows for each slot, with each column's values as one array of bytes; blob adds (data, lo, hi) ranges."""
    order = np.argsort(slot, kind="stable")
    cut = np.searchsorted(slot[order], np.arange(dealt + 1))
    rows: dict[str, list] = {"slot": [], "known": [], "rank": [], "th": [], "doc": [], **{c: [] for c in columns}, "size": [], "blob": []}
    for s in np.flatnonzero(np.diff(cut)):
        part = order[cut[s]:cut[s + 1]]
        ids, local = np.unique(doc[part], return_inverse=True)
        rows["slot"].append(int(s))
        rows["known"].append(known)
        rows["rank"].append(rank[ids].astype("<i8").tobytes())
        rows["th"].append(th[ids].astype("<i8").tobytes())
        rows["doc"].append(local.astype("<u4").tobytes())
        for c, v in columns.items():
            rows[c].append(v[part].tobytes() if len(v) else b"")
        if blob is None:
            rows["size"].append(b"")
            rows["blob"].append(b"")
        else:
            data, lo, hi = blob
            size = (hi - lo)[part]
            rows["size"].append(size.astype("<u4").tobytes())
            rows["blob"].append(data[ragged(lo[part], size)].tobytes())
    if rows["slot"]:
        yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int32() if c == "slot" else pa.bool_() if c == "known" else pa.binary()) for c, v in rows.items()})


def unpacked(rows: Iterator[pa.RecordBatch], kinds: dict[str, str]) -> dict[str, np.ndarray]:
    """All packed rows of a task joined: per entry rank, th, known and the columns; blob is one array with sizes."""
    out: dict[str, list] = {c: [] for c in (*kinds, "rank", "th", "known", "size", "blob")}
    for batch in rows:
        for row in batch.to_pylist():
            doc = np.frombuffer(row["doc"], "<u4")
            out["rank"].append(np.frombuffer(row["rank"], "<i8")[doc])
            out["th"].append(np.frombuffer(row["th"], "<i8")[doc])
            out["known"].append(np.full(len(doc), row["known"]))
            for c, kind in kinds.items():
                out[c].append(np.frombuffer(row[c], kind))
            out["size"].append(np.frombuffer(row["size"], "<u4"))
            out["blob"].append(np.frombuffer(row["blob"], np.uint8))
    empty = {"rank": "<i8", "th": "<i8", "known": bool, "size": "<u4", "blob": np.uint8, **kinds}
    return {c: np.concatenate([*out.pop(c), np.zeros(0, empty[c])]) for c in list(out)}  # what is joined goes at once


def drained(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a list, which lets go of each one."""
    while held:
        yield held.pop(0)


def send_back(slots: int, rank: np.ndarray, th: np.ndarray, pairs: np.ndarray, ask: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Deal pairs of 32-bit numbers out by document, packed; `ask` marks those that ask for content."""
    order, group, first = groups(rank, th)
    doc = np.empty(len(rank), np.int64)
    doc[order] = group
    r, t = rank[order[first]], th[order[first]]
    slot = (mix(r.view(np.uint64) ^ rotl(t.view(np.uint64), 17)) % np.uint64(slots)).astype(np.int64)
    pair = np.ascontiguousarray(pairs.astype("<u4")).view("<u8").ravel()
    yield from packed(slots, slot[doc], doc, r, t, {"pair": pair, "ask": np.zeros(len(rank), "u1") if ask is None else ask.astype("u1")}, False)


def by_document(batch_rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document: (rank, th, cut, ask), the pairs that were sent back; null where there are none."""
    a = unpacked(batch_rows, {"pair": "<u8", "ask": "u1"})
    order, group, first = groups(a["rank"], a["th"])
    order = order[np.argsort(2 * group + a["ask"][order])]
    pair, ends = a["pair"][order], np.append(first, len(order))
    middle = ends[1:] - (np.add.reduceat(a["ask"][order].astype(np.int64), first) if len(first) else first)
    for lo in range(0, len(first), 5000):
        hi = min(lo + 5000, len(first))
        spans = list(zip(ends[lo:hi].tolist(), middle[lo:hi].tolist(), ends[lo + 1:hi + 1].tolist(), strict=True))
        yield pa.RecordBatch.from_pydict({
            "rank": pa.array(a["rank"][order[first[lo:hi]]]), "th": pa.array(a["th"][order[first[lo:hi]]]),
            "cut": pa.array([pair[x:y].tobytes() if y > x else None for x, y, _ in spans], pa.binary()),
            "ask": pa.array([pair[y:z].tobytes() if z > y else None for _, y, z in spans], pa.binary())})


PACKED = "slot int, known boolean, rank binary, th binary, doc binary, {}size binary, blob binary"
REPLY = PACKED.format("pair binary, ask binary, ")


def apart(batch_rows: Iterator[pa.RecordBatch]) -> tuple[list[pa.RecordBatch], list[pa.RecordBatch]]:
    """Rows that only pass on what is known already, and those to judge."""
    told, asked = [], []
    for batch in batch_rows:
        known = batch.column("known")
        told.append(batch.filter(known))
        asked.append(batch.filter(pc.invert(known)))
    return told, asked


#: Bytes of text whose pieces are combined at once; larger Arrow batches are cut, as a task's arrays are many times this.
BATCH = 1 << 20
#: Arrow batches of the steps that are written.
SENT = "2m"
#: Distinct pieces an anchor may have without being dealt window by window.
FREQUENT = 2048
#: Neighbouring pieces that are judged as one at most.
RUN = 512
#: Set in the second number of an ask: this piece's anchor is frequent.
BY_WINDOW = 1 << 31
#: Occurrences are counted up to this number.
MOST = (1 << 30) - 1


class Group(NamedTuple):
    """Distinct pieces to judge together: contents, windows of each, smallest rank, occurrences, and whether documents of larger rank have it too."""

    blob: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    n: np.ndarray
    rank: np.ndarray
    count: np.ndarray
    later: np.ndarray


#: Judges pieces: for each piece, in order, a flag for each of its windows; and the flags of its copies in documents of larger rank.
Resolver = Callable[[Group, Spec], tuple[np.ndarray, np.ndarray]]


class Judge(NamedTuple):
    """How windows are judged: earlier: a window goes if it occurs in a document of smaller rank; else if it occurs anywhere else."""

    spec: Spec
    earlier: bool
    resolve: Resolver
    shard_bytes: int

    def verdicts(self, data: np.ndarray, lo: np.ndarray, size: np.ndarray, key: np.ndarray, n: np.ndarray, rank: np.ndarray,
                 count: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first flag of each piece, flags, flags of later copies) of pieces with content data[lo:lo + size]; those of one key, side by side, are judged together."""
        at = np.cumsum(n) - n
        flags = np.zeros((2, int(n.sum())), bool)
        for part in shards(key, size, self.shard_bytes):
            s = size[part]
            found = self.resolve(Group(data[ragged(lo[part], s)], np.cumsum(s) - s, s, n[part], rank[part], count[part], later[part]), self.spec)
            flags[:, ragged(at[part], n[part])] = found
        return at, flags[0], flags[1]


def runs(flags: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, first window, windows) of the maximal runs of set flags; entry i has flags[at[i]:at[i] + n[i]]."""
    entry = np.repeat(np.arange(len(n)), n)
    on = flags[ragged(at, n)]
    within = np.arange(len(on)) - np.repeat(np.cumsum(n) - n, n)
    head = on & ~(np.concatenate([[False], on[:-1]]) & (within > 0))
    tail = on & ~(np.concatenate([on[1:], [False]]) & (within < n[entry] - 1))
    return entry[head], within[head], within[tail] - within[head] + 1


class Entries(NamedTuple):
    """Pieces of a batch: document, key, content hash, first window in the document, windows, content range, occurrences (0: counted elsewhere)."""

    doc: np.ndarray
    key: np.ndarray
    ph: np.ndarray
    lo: np.ndarray
    n: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    count: np.ndarray


def combined(e: Entries, data: np.ndarray, rank: np.ndarray, judge: Judge) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sent, their occurrences, which of them bring content, cut): of equal pieces of a batch one is sent, or those of the
    smallest rank; the others' windows are judged here, cut being their (entry, first window, windows)."""
    order, group, first = groups(e.key, e.ph)
    own = rank[e.doc[order]]
    head = np.zeros(len(order), bool)
    head[first] = True
    least = np.minimum.reduceat(own, first) if judge.earlier and len(first) else own[first]
    if judge.earlier:
        goes = own == least[group]
        index = np.flatnonzero(goes)
        head[:] = False
        head[index[np.unique(group[index], return_index=True)[1]]] = True
    else:
        goes = head
    total = np.bincount(group, e.count[order], len(first)).astype(np.int64)
    told = np.flatnonzero(~goes)
    which, place = np.unique(group[told], return_inverse=True)
    # Neighbouring pieces of a document are judged in one piece; only that this is the first copy or a later one counts.
    one = order[first[which]]
    line = np.argsort(e.start[one], kind="stable")
    one = one[line]
    n = e.n[one]
    new = np.arange(len(one)) % RUN == 0
    new[1:] |= (e.doc[one[1:]] != e.doc[one[:-1]]) | (e.lo[one[1:]] != e.lo[one[:-1]] + n[:-1])
    head_of = np.flatnonzero(new)
    tail_of = np.append(head_of, len(one))[1:] - 1
    zeros = np.zeros(len(head_of), np.int64)
    _, flags, later = judge.verdicts(data, e.start[one[head_of]], e.stop[one[tail_of]] - e.start[one[head_of]], np.arange(len(head_of)),
                                     np.add.reduceat(n, head_of) if len(n) else n, zeros, zeros + 2, zeros == 0)
    at = np.empty(len(one), np.int64)
    at[line] = np.cumsum(n) - n
    entry, lo, number = runs(later if judge.earlier else flags, at[place], e.n[order[told]])
    count = np.where(head, total[group], 0)[goes]
    return order[goes], np.minimum(count, MOST), count > 0, (order[told[entry]], lo, number)


def seeds(rows: DataFrame, slots: int, how: Judge) -> DataFrame:
    """(rank, th, cut, ask): windows that a batch alone removes, and pieces to judge.

    cut holds (first window, windows) pairs.  ask holds (first window, occurrences)
    pairs of pieces that occur twice or share an anchor with other ones; of each
    class one has the occurrences of all and the others 0.
    """
    spec = how.spec
    schema = PACKED.format("h binary, ph binary, lo binary, n binary, count binary, ")
    if spec.window - spec.gram + 1 > 255:
        raise ValueError("a window holds at most 255 grams")

    def emit(batch_rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches(sliced(batch_rows, BATCH), BATCH // 2):
            found, blobs, base = [], [], 0
            for chunk in text_chunks(table.column("text"), 1 << 17):
                units = units_of(chunk, spec)
                p, _ = pieces_of(units, spec)
                a, b = units.span(p.lo, p.lo + p.n + spec.window - 1) if len(p.lo) else (p.lo, p.lo)
                found.append((p.doc + chunk.lo, p.h, p.ph, p.lo - units.first[p.doc], p.n, a + base, b + base, np.ones(len(p.lo), np.int64)))
                blobs.append(units.data)
                base += len(units.data)
            e = Entries(*(np.concatenate(x) for x in zip(*found, strict=True)))
            del found
            rank, th = table.column("rank").to_numpy(), table.column("th").to_numpy()
            send, count, _, (entry, lo, number) = combined(e, np.concatenate(blobs), rank, how)
            del blobs
            yield from packed(slots, (e.key[send] % np.uint64(slots)).astype(np.int64), e.doc[send], rank, th, {
                "h": e.key[send], "ph": e.ph[send], "lo": e.lo[send].astype("<u4"), "n": e.n[send].astype("u1"), "count": np.minimum(count, 65535).astype("<u2")}, False)
            yield from told(slots, e, entry, lo, number, rank, th, ("h", "ph"))

    def judge(batch_rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, asked = apart(batch_rows)
        yield from passed_on(slots, known)
        a = unpacked(drained(asked), {"h": "<u8", "ph": "<u8", "lo": "<u4", "n": "u1", "count": "<u2"})
        order, group, first = groups(a["h"], a["ph"])
        if not len(order):
            return
        h = a["h"][order[first]]
        heads = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        kinds = np.repeat(np.diff(np.append(heads, len(h))), np.diff(np.append(heads, len(h))))  # classes of each class's anchor
        total = np.add.reduceat(a["count"][order].astype(np.int64), first)
        if how.earlier:
            rank = a["rank"][order]
            least = np.minimum.reduceat(rank, first)
            again = np.maximum.reduceat(rank, first) > least
            # A document of the smallest rank brings the content.
            index = np.flatnonzero(rank == least[group])
            bring = index[np.unique(group[index], return_index=True)[1]]
        else:
            again, bring = total > 1, first
        times = np.zeros(len(order), np.int64)
        times[bring] = np.clip(total, 1, MOST)
        wanted = (again | (kinds > 1))[group]
        times |= np.where(kinds[group] > FREQUENT, BY_WINDOW, 0)
        ask = order[wanted]
        yield from send_back(slots, a["rank"][ask], a["th"][ask], np.stack([a["lo"][ask], times[wanted]], 1), np.ones(len(ask), bool))

    return returned(arrow_map(rows.select("rank", "th", "text"), emit, schema), judge)


def told(slots: int, e: Entries, entry: np.ndarray, lo: np.ndarray, number: np.ndarray, rank: np.ndarray, th: np.ndarray, hashes: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Rows that only tell documents which windows go."""
    if len(entry):
        none = np.zeros(0, "<u8")
        doc = e.doc[entry]
        yield from packed(slots, doc % slots, doc, rank, th, {
            **dict.fromkeys(hashes, none), "lo": (e.lo[entry] + lo).astype("<u4"), "n": number.astype("u1"), "count": none}, True)


def passed_on(slots: int, known: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k = unpacked(drained(known), {"lo": "<u4", "n": "u1"})
    if len(k["lo"]):
        yield from send_back(slots, k["rank"], k["th"], np.stack([k["lo"], k["n"]], 1))


def returned(dealt: DataFrame, judge: Callable) -> DataFrame:
    """Judge what was dealt out by content, a slot a task, and bring the answers back by document: (rank, th, cut, ask)."""
    n = parts(dealt.sparkSession)
    answers = arrow_map(dealt.repartitionById(n, F.col("slot")), judge, REPLY)
    return arrow_map(answers.repartitionById(n, F.col("slot")), by_document, "rank bigint, th bigint, cut binary, ask binary")


def gather(rows: DataFrame, candidates: DataFrame, slots: int, how: Judge) -> DataFrame:
    """(rank, th, cut): (first window, windows) pairs to remove, as 32-bit numbers, in document units."""
    spec = how.spec
    schema = PACKED.format("key binary, ph binary, lo binary, n binary, count binary, ")
    kinds = {"key": "<u8", "ph": "<u8", "lo": "<u4", "n": "u1", "count": "<u4"}

    def emit(batch_rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches(sliced(batch_rows, BATCH), BATCH // 2):
            rank, th = table.column("rank").to_numpy(), table.column("th").to_numpy()
            lists = [np.frombuffer(x, "<u4").reshape(-1, 2).astype(np.int64) for x in table.column("ask").to_pylist()]
            found, blobs, base = [], [], 0
            for chunk in text_chunks(table.column("text"), 1 << 17):
                units = units_of(chunk, spec)
                p, _ = pieces_of(units, spec)
                if not len(p.lo):
                    continue
                asked = np.concatenate(lists[chunk.lo:chunk.hi])
                where = np.searchsorted(p.lo, np.repeat(units.first[:-1], [len(x) for x in lists[chunk.lo:chunk.hi]]) + asked[:, 0])
                by_window = asked[:, 1] >= BY_WINDOW
                count = asked[:, 1] & MOST
                plain, common = where[~by_window], where[by_window]
                single = ragged(p.lo[common], p.n[common])
                lo = np.concatenate([p.lo[plain], single])
                n = np.concatenate([p.n[plain], np.ones(len(single), np.int64)])
                doc = np.concatenate([p.doc[plain], np.repeat(p.doc[common], p.n[common])])
                a, b = units.span(lo, lo + n + spec.window - 1) if len(lo) else (lo, lo)
                c, d = a[len(plain):], (b - a)[len(plain):]
                found.append((doc + chunk.lo, np.concatenate([p.h[plain], xxh64(units.data, c, d)]), np.concatenate([p.ph[plain], xxh64(units.data, c, d, 7)]),
                              lo - units.first[doc], n, a + base, b + base, np.concatenate([count[~by_window], np.repeat(count[by_window], p.n[common])])))
                blobs.append(units.data)
                base += len(units.data)
            if not blobs:
                continue
            e = Entries(*(np.concatenate(x) for x in zip(*found, strict=True)))
            data = np.concatenate(blobs)
            del found, blobs
            send, count, brings, (entry, lo, number) = combined(e, data, rank, how)
            yield from packed(slots, (e.key[send] % np.uint64(slots)).astype(np.int64), e.doc[send], rank, th,
                              {"key": e.key[send], "ph": e.ph[send], "lo": e.lo[send].astype("<u4"), "n": e.n[send].astype("u1"), "count": count.astype("<u4")},
                              False, (data, e.start[send], np.where(brings, e.stop[send], e.start[send])))
            yield from told(slots, e, entry, lo, number, rank, th, ("key", "ph"))

    def judge(batch_rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, asked = apart(batch_rows)
        yield from passed_on(slots, known)
        a = unpacked(drained(asked), kinds)
        begin = np.cumsum(a["size"], dtype=np.int64) - a["size"]
        order, group, first = groups(a["key"], a["ph"])
        if not len(order):
            return
        index = np.flatnonzero(a["size"][order])
        which, at = np.unique(group[index], return_index=True)
        if len(which) != len(first):
            raise RuntimeError("a piece came without its content")
        one = order[index[at]]
        rank = a["rank"][order]
        least, most = np.minimum.reduceat(rank, first), np.maximum.reduceat(rank, first)
        count = np.add.reduceat(a["count"][order].astype(np.int64), first)
        at, flags, later = how.verdicts(a["blob"], begin[one], a["size"][one].astype(np.int64), a["key"][one], a["n"][one].astype(np.int64), least, count, most > least)
        del a["blob"]
        behind = rank > least[group] if how.earlier else np.zeros(len(order), bool)
        for these, verdict in ((~behind, flags), (behind, later)):
            some = np.add.reduceat(verdict, at) > 0
            these &= some[group]
            rows_of, classes = order[these], group[these]
            entry, lo, number = runs(verdict, at[classes], a["n"][rows_of].astype(np.int64))
            hit = rows_of[entry]
            if len(hit):
                yield from send_back(slots, a["rank"][hit], a["th"][hit], np.stack([a["lo"][hit].astype(np.int64) + lo, number], 1))

    joined = rows.join(candidates, ["rank", "th"]).select("rank", "th", "text", "ask")
    return returned(arrow_map(joined, emit, schema), judge).drop("ask")


def shards(key: np.ndarray, size: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Runs of pieces, whole key groups each, of about `limit` bytes."""
    if not len(key):
        return
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    total = np.add.reduceat(size.astype(np.int64), head)
    bucket = (np.cumsum(total) - total) // limit
    cut = head[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])]
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(key)], strict=True):
        yield np.arange(lo, hi)


def removals(docs: DataFrame, spec: Spec, earlier: bool, resolve: Resolver, name: str, id_col: str, text_col: str,
             shard_bytes: int = 1 << 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, data and the kept columns: for each input row the windows to remove as lists of (first, number) pairs, null if there are none."""
    spark = docs.sparkSession
    scratch = Scratch(spark, name)
    places = ranked(docs, id_col, scratch)
    rows = keyed(docs, id_col, text_col, places)
    slots = parts(spark)
    how = Judge(spec, earlier, resolve, shard_bytes)
    seeded = scratch.keep(seeds(rows, slots, how), SENT)
    scratch.settle()
    judged = scratch.keep(gather(rows, seeded.where("ask IS NOT NULL").select("rank", "th", "ask"), slots, how), SENT)
    scratch.settle()
    whole = seeded.where("cut IS NOT NULL").select("rank", "th", F.col("cut").alias("whole"))
    kept = [f"kept_{i}" for i in range(len(keep))]
    found = keyed(docs, id_col, text_col, places, keep).join(whole, ["rank", "th"], "left").join(judged.withColumnRenamed("cut", "part"), ["rank", "th"], "left")
    return found.select("doc_id", "text", F.array_compact(F.array("whole", "part")).alias("data"), *kept)


def covered(pairs: list[bytes] | None, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal unit ranges [lo, hi) that the windows cover."""
    flat = np.frombuffer(b"".join(pairs or ()), "<u4").astype(np.int64).reshape(-1, 2)
    if not len(flat):
        return flat[:, 0], flat[:, 0]
    flat = flat[np.argsort(flat[:, 0], kind="stable")]
    lo, hi = flat[:, 0], np.maximum.accumulate(flat[:, 0] + flat[:, 1] + window - 1)
    new = np.r_[True, lo[1:] > hi[:-1]]
    return lo[new], hi[np.r_[np.flatnonzero(new)[1:] - 1, len(hi) - 1]]
