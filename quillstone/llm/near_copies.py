"""Near copies by exact Jaccard similarity of word shingles, proposed by SimHash trees and by prefixes.

The SimHash operator's vantage-point trees propose pairs of near fingerprints.  At
similarity 0.8 fingerprints of 64 bits differ in about 9 bits and in up to 20, a
reach at which a tree rules nothing out, so the other pairs are found by prefixes:
if every set is put in one common order, two sets of similarity t or more share
one of the first n - ceil(t n) + 1 members, so no pair is missed.  Rare shingles
come first in the order, so that common lines propose few pairs, and a pair must
share as many members of its prefixes as its sizes require.  Parity bitmaps then
bound the symmetric difference of a pair from below, and what they leave is
compared member by member before it is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesops import Chunk, arrow_map, batches, lower_ascii, mix, split_words, text_chunks, xxh64
from .components import components
from .scratch import Scratch, parts
from .skew import lookup, small
from .simhash import close_links, majority, text_hash

#: Bits of a parity bitmap, and the 64-bit columns of a short one that pairs must pass before they are listed.
PARITY = 2048
SHORT = ("q0", "q1", "q2", "q3")


def shingle_sets(chunk: Chunk, shingle: int, common: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, members): text i's distinct shingle hashes are members[first[i]:first[i + 1]], ascending, but those in `common` (sorted) last, by their `place`.

    Texts with fewer words than a shingle hash as a whole; texts without words have the one member 0.
    """
    words = split_words(lower_ascii(chunk.data), chunk.offsets)
    count = np.diff(words.first)
    grams = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(count)), grams)
    head = words.first[doc] + np.arange(len(doc)) - (np.cumsum(grams) - grams)[doc]
    tail = np.minimum(head + shingle, words.first[doc + 1]) - 1
    blank = np.flatnonzero(grams == 0)
    h = np.zeros(0, np.uint64) if not len(doc) else xxh64(words.data, words.start[head], words.end[tail] - words.start[head])
    doc, h = np.concatenate([doc, blank]), np.concatenate([h, np.zeros(len(blank), np.uint64)])
    late = np.zeros(len(h), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        late = np.where(common[at] == h, place[at], 0)
    order = np.lexsort((h, late, doc))
    doc, h = doc[order], h[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
    doc, h = doc[new], h[new]
    return np.searchsorted(doc, np.arange(len(count) + 1)), h


def similar(a: np.ndarray, b: np.ndarray, t: tuple[int, int]) -> bool:
    """Whether two ascending sets have Jaccard similarity t[0] / t[1] or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * t[1] >= t[0] * (len(a) + len(b) - both)


def grouped(rows: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...] | None:
    """The partition's columns as arrays, by h, then size, then class; repeats and values of h with one class go; and each group's number."""
    held = [b for b in rows if b.num_rows]
    if not held:
        return None
    table = pa.Table.from_batches(held)
    c = {n: table.column(n).to_numpy() for n in table.column_names}
    order = np.lexsort((c["cls"], c["size"], c["h"]))
    h, cls = c["h"][order], c["cls"][order]
    new = np.r_[True, (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])]
    order, h = order[new], h[new]
    group = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1
    more = np.bincount(group)[group] > 1
    return (*(x[order[more]] for x in c.values()), group[more])


def folded(parity: np.ndarray) -> np.ndarray:
    """Parity bitmaps (rows of bytes) folded to 64 bits a column of SHORT; the difference of two folded ones is still a lower bound."""
    return np.bitwise_xor.reduce(np.ascontiguousarray(parity).view(np.int64).reshape(len(parity), -1, len(SHORT)), axis=1)


def counted(a: np.ndarray, b: np.ndarray, sa: np.ndarray, sb: np.ndarray) -> pa.RecordBatch:
    """Pairs (a, b), a < b, with their sizes and how often each occurs."""
    turn = a > b
    a, b, sa, sb = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, sb, sa), np.where(turn, sa, sb)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[first], b[first], sa[order][first], sb[order][first], np.diff(np.append(first, len(a))))],
                                      names=["a", "b", "sa", "sb", "n"])


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, t: tuple[int, int] = (4, 5),
                sample_share: int = 32, sample_rows: int = 4000, common_rows: int = 100_000, reach: int = 3,
                draws: int = 8, turns: int = 4) -> DataFrame:
    """One row per input row: doc_id, text_hash, component_id (the smallest doc_id reachable by links).

    Two texts are linked if the sets of their word shingles, A-Z lower-cased, have
    similarity t[0] / t[1] or more; all such pairs count.  Texts without words are alike.
    Sets and their members are told apart by 64-bit hashes.  One document in
    `sample_share` (all, up to `sample_rows`) shows which shingles are common; that
    only sets the order, as do the at most `common_rows` shingles it keeps.  First the
    pairs that the SimHash trees find within `reach` bits are compared, each value's
    smallest set with the others, and in up to `turns` turns each set with `draws`
    others of its most common value; then all pairs that share enough values of their
    prefixes and aren't connected yet.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    kind = docs.schema[id_col].dataType.simpleString()
    none = np.zeros(0, np.uint64)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_hash(text_col).alias("text_hash"))

    def members(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches(rows, 4 << 20):
            for chunk in text_chunks(table.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(chunk, shingle, none, none)[1].view(np.int64))], names=["h"])

    sample = texts if docs.count() <= sample_rows else texts.where(F.pmod("text_hash", F.lit(sample_share)) == 0)
    counts = arrow_map(sample.select("text"), members, "h bigint").groupBy("h").count().where("count > 3")
    common = np.array([r["h"] for r in counts.orderBy(F.desc("count"), "h").limit(common_rows).collect()], np.int64).view(np.uint64)
    order = np.argsort(common)
    common, place = common[order], len(common) - order  # the most common one comes last

    def sign(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches(rows, 4 << 20):
            for chunk in text_chunks(table.column("text")):
                first, h = shingle_sets(chunk, shingle, common, place)
                size = np.diff(first)
                with np.errstate(over="ignore"):
                    cls = mix(np.add.reduceat(mix(h), first[:-1]) + size.astype(np.uint64)).view(np.int64)
                doc = np.repeat(np.arange(len(size)), size)
                fp = majority(h, doc, size)
                length = size - -(-size * t[0] // t[1]) + 1
                front = h[np.arange(len(h)) - first[doc] < length[doc]]
                cut = np.concatenate([[0], np.cumsum(length)])
                parity, short = [], []
                for lo in range(0, len(size), 256):
                    hi = min(lo + 256, len(size))
                    at = slice(first[lo], first[hi])
                    bits = np.bincount((doc[at] - lo) * PARITY + (h[at] % np.uint64(PARITY)).astype(np.int64), minlength=(hi - lo) * PARITY) & 1
                    packed = np.packbits(bits.astype(np.uint8).reshape(-1, PARITY), axis=1)
                    parity += [p.tobytes() for p in packed]
                    short.append(folded(packed))
                part = table.slice(chunk.lo, chunk.hi - chunk.lo)
                yield from pa.table({"doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"), "cls": cls, "size": size, "fp": fp.view(np.int64),
                                     "front": pa.array([front[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                                     "parity": pa.array(parity, pa.binary()), **dict(zip(SHORT, map(pa.array, np.concatenate(short).T), strict=True))}).to_batches()

    signed = scratch.keep(arrow_map(texts, sign, f"doc_id {kind}, text_hash bigint, cls bigint, size bigint, fp bigint, front binary, parity binary, " + ", ".join(f"{q} bigint" for q in SHORT)))

    slots = parts(spark)

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches(rows, 4 << 20, "front"):
            front = table.column("front").to_pylist()
            n = np.array([len(f) // 8 for f in front], np.int64)
            h = np.frombuffer(b"".join(front), np.uint64)
            slot = (h % np.uint64(slots)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            cut = np.searchsorted(slot[order], np.arange(slots + 1))
            columns = [h, *(np.repeat(table.column(c).to_numpy(), n) for c in ("cls", "size"))]
            live = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), *(
                pa.array([x[order[cut[s]:cut[s + 1]]].tobytes() for s in live], pa.binary()) for x in columns)], names=["slot", "h", "cls", "size"])

    def meet(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int64)) for c in ("h", "cls", "size")], names=["h", "cls", "size"])
                for batch in rows]
        got = grouped(iter(held))
        del held
        if got is None or not len(got[0]):
            return
        # A row stays if a neighbour by size may be similar to it; no other row of its value can be, if neither is.
        near = (got[3][1:] == got[3][:-1]) & (got[2][:-1] * t[1] >= got[2][1:] * t[0])
        h, cls, size, group = (x[np.r_[near, False] | np.r_[False, near]] for x in got)
        if not len(h):
            return
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        lead = first[np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1]
        star = (size[lead] * t[1] >= size * t[0]) & (lead != np.arange(len(cls)))
        held_by = np.diff(np.append(first, len(h)))[np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1]
        for lo in range(0, len(h), 100_000):
            at = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(cls[at]), pa.array(size[at]), pa.array(held_by[at]), pa.array(cls[lead[at]], mask=~star[at])],
                                             names=["h", "cls", "size", "held_by", "lead"])

    # Each value's classes meet in one task, held_by of them; lead is the smallest set's class where the two may be similar.
    fronts = arrow_map(signed.select("cls", "size", "front"), deal, "slot int, h binary, cls binary, size binary")
    shared = scratch.keep(arrow_map(fronts.repartitionById(slots, F.col("slot")), meet, "h bigint, cls bigint, size bigint, held_by bigint, lead bigint"))
    stars = shared.where("lead IS NOT NULL").select(F.least("lead", "cls").alias("a"), F.greatest("lead", "cls").alias("b"))

    def others(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = grouped(rows)
        if got is None or not len(got[0]):
            return
        _, cls, size, root, *short, group = got
        short = np.stack(short).view(np.uint64)
        live, step, held = np.arange(len(cls)), 0, []
        while len(live):
            step += 1
            live = live[live + step < len(cls)]
            live = live[(group[live] == group[live + step]) & (size[live] * t[1] >= size[live + step] * t[0])]
            apart = live[root[live] != root[live + step]]
            far = np.bitwise_count(short[:, apart] ^ short[:, apart + step]).sum(0, dtype=np.int64)
            # As in `bound` below.
            apart = apart[far * (t[1] + t[0]) <= (t[1] - t[0]) * (size[apart] + size[apart + step])]
            held.append(np.stack([apart, apart + step]))
            if sum(x.shape[1] for x in held) >= 1 << 18:
                a, b = np.concatenate(held, axis=1)
                yield counted(cls[a], cls[b], size[a], size[b])
                held = []
        if sum(x.shape[1] for x in held):
            a, b = np.concatenate(held, axis=1)
            yield counted(cls[a], cls[b], size[a], size[b])

    sketches = scratch.keep(signed.groupBy("cls").agg(F.min("text_hash").alias("text_hash"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("parity").alias("parity"),
                                                      *(F.first(q).alias(q) for q in SHORT)))

    def bound(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, PARITY // 64) for c in ("pa", "pb"))
            total = batch.column("sa").to_numpy() + batch.column("sb").to_numpy()
            # Similarity t means a symmetric difference of at most (1 - t) / (1 + t) of both sizes.
            may = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) * (t[1] + t[0]) <= (t[1] - t[0]) * total
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(may)) for c in ("a", "b")], names=["a", "b"])

    def spell(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches(rows, 4 << 20):
            for chunk in text_chunks(table.column("text")):
                first, h = shingle_sets(chunk, shingle, none, none)
                yield from pa.table({"cls": table.column("cls").slice(chunk.lo, chunk.hi - chunk.lo),
                                     "members": pa.array([h[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary())}).to_batches()

    def compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            same = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), t) for x, y in
                    zip(batch.column("ma").to_pylist(), batch.column("mb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(same, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    def ends(pairs: DataFrame) -> DataFrame:
        return scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())

    def chosen(rows: DataFrame, wanted: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(wanted) if small(wanted) else wanted, "cls", "left_semi")

    def verify(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose sets are similar."""
        pairs = scratch.keep(pairs.distinct())
        s = scratch.keep(chosen(sketches, ends(pairs)))
        drawn = (pairs.join(s.select(F.col("cls").alias("a"), F.col("size").alias("sa"), F.col("parity").alias("pa")), "a")
                 .join(s.select(F.col("cls").alias("b"), F.col("size").alias("sb"), F.col("parity").alias("pb")), "b"))
        close = scratch.keep(arrow_map(drawn, bound, "a bigint, b bigint"))
        wanted = scratch.keep(chosen(s, ends(close)).select("cls", "text_hash"))
        wanted = F.broadcast(wanted) if small(wanted) else wanted
        sets = scratch.keep(arrow_map(texts.select("text", "text_hash").join(wanted, "text_hash").select("cls", "text"), spell, "cls bigint, members binary"))
        # Rows of equal text spell the same set.
        sets = scratch.keep(sets.dropDuplicates(["cls"]))
        both = (close.join(sets.select(F.col("cls").alias("a"), F.col("members").alias("ma")), "a")
                .join(sets.select(F.col("cls").alias("b"), F.col("members").alias("mb")), "b"))
        return scratch.keep(arrow_map(both.select("a", "b", "ma", "mb"), compare, "a bigint, b bigint"))

    classes = scratch.keep(signed.groupBy("fp").agg(F.min("cls").alias("cls"), F.count_distinct("cls").alias("n")))
    near = close_links(classes.select("fp"), reach, scratch)
    first = classes.select(F.col("fp").alias("a"), F.col("cls").alias("x"))
    second = classes.select(F.col("fp").alias("b"), F.col("cls").alias("y"))
    alike = lookup(sketches.select("fp", "cls"), classes.where("n > 1").select("fp", F.col("cls").alias("x")), "fp").where("cls <> x")
    proposed = near.join(first, "a").join(second, "b").select("x", "y").union(alike.select("x", F.col("cls").alias("y")))
    proposed = proposed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    # Of each class the value that most classes hold: where a large group of copies meets.
    widest = scratch.keep(shared.groupBy("cls").agg(F.first("size").alias("size"), F.max(F.struct("held_by", "h")).alias("w")).select("cls", "size", "w.h", "w.held_by"))

    def under(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
        """rows with each class's root so far."""
        if roots is None:
            return rows.withColumn("root", F.col("cls"))
        return lookup(rows, roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))

    def drawn_pairs(turn: int, roots: DataFrame | None) -> DataFrame:
        """Each class with the next `draws` ones of its widest value, in an order of this turn and in lots of about 1,000 classes; pairs of one root go.

        Later turns are for values of which one root has a tenth of the classes and not all have met in turn 0.
        """
        rows = under(widest if roots is None else widest.where(F.col("held_by") > draws + 1), roots)
        if roots is not None:
            shares = rows.groupBy("h", "root").agg(F.count("*").alias("n"), F.first("held_by").alias("held_by"))
            grown = shares.groupBy("h").agg(F.max("n").alias("n"), F.first("held_by").alias("held_by")).where("n > 1 AND n * 10 >= held_by")
            rows = lookup(rows, scratch.keep(grown.select("h")), "h")
        lots = rows.withColumn("lot", F.pmod(F.xxhash64(F.lit(turn), "cls"), F.ceil(F.col("held_by") / 1000)))
        order = Window.partitionBy("h", "lot").orderBy(F.xxhash64("cls", F.lit(turn)), "cls")
        following = F.array(*(F.lead(F.struct("cls", "size", "root"), k).over(order) for k in range(1, draws + 1)))
        met = lots.select("cls", "size", "root", following.alias("o")).withColumn("o", F.explode("o")).where("o IS NOT NULL AND root <> o.root")
        fits = F.least("size", "o.size") * t[1] >= F.greatest("size", "o.size") * t[0]
        return met.where(fits).select(F.least("cls", "o.cls").alias("a"), F.greatest("cls", "o.cls").alias("b"))

    links = verify(proposed.union(stars).union(drawn_pairs(0, None)))
    roots = components(links, scratch)
    # A large group of copies grows together before all its other pairs are listed, so few of them are left to list.
    for turn in range(1, turns):
        pairs = scratch.keep(drawn_pairs(turn, roots).distinct())
        found = verify(pairs)
        n_found = found.count()
        if n_found:
            links = scratch.keep(links.union(found))
            roots = components(links, scratch)
        if n_found * 200 <= pairs.count():
            break
    rooted = scratch.keep(under(shared.select("h", "cls", "size"), roots).select("h", "cls", "size", "root"))
    # Only values that several roots hold have pairs left; their classes bring their short bitmaps along.
    several = scratch.keep(rooted.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("h"))
    open_rows = scratch.keep(rooted.join(F.broadcast(several) if small(several) else several, "h", "left_semi"))
    known = scratch.keep(sketches.select("cls", *SHORT).join(open_rows.select("cls").distinct(), "cls", "left_semi"))
    told = lookup(open_rows, known, "cls").select("h", "cls", "size", "root", *SHORT)
    pairs = arrow_map(told.repartition("h"), others, "a bigint, b bigint, sa bigint, sb bigint, n bigint")
    pairs = pairs.groupBy("a", "b").agg(F.first("sa").alias("sa"), F.first("sb").alias("sb"), F.sum("n").alias("n"))
    # The overlap must reach t / (1 + t) of both sizes; all of it but n lies behind the prefix that ends first.
    overlap = F.ceil((F.col("sa") + F.col("sb")) * t[0] / (t[0] + t[1]))
    behind = F.ceil(F.greatest("sa", "sb") * t[0] / t[1]) - 1
    more = verify(pairs.where(F.col("n") >= overlap - behind).select("a", "b"))
    roots = components(links.union(more), scratch)
    named = lookup(signed.select("doc_id", "text_hash", "cls"), roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = scratch.keep(named.select("doc_id", "text_hash", "root"))
    least = scratch.keep(named.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    out = scratch.keep(lookup(named, least, "root").select("doc_id", "text_hash", "component_id"))
    scratch.only(out)
    return out
