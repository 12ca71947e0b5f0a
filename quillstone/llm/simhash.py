"""SimHash near-duplicates by vantage-point trees.

Equal fingerprints form one class.  Two fingerprints within `reach` bits agree
wholly on one of reach + 1 blocks of the 64 bits, so there is a vantage-point tree
for each block: a node's fingerprints within its radius, by the block's Hamming
distance, go inside, the others outside.  A pair that agrees on a block takes the
same way down its tree, so every fingerprint is in one shard a tree, whatever the
corpus's size, and the trees grow with the corpus to keep shards of one size.
Shards that stay too large are cut by a second tree over the whole distance, where
a fingerprint also visits each shard that the triangle inequality can't rule out.
In a shard, a local tree prunes branches the same way and only its small leaves
are compared pair by pair; a ball of close fingerprints that no vantage point
splits is settled by looking up each one's near words (``probe``).  Shards report
spanning forests instead of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import arrow_map, batches, lower_ascii, split_words, text_chunks, xxh64
from .components import components
from .scratch import Scratch
from .skew import lookup


def fingerprints_of(column: pa.Array, shingle: int = 3) -> np.ndarray:
    """SimHash of each text: word shingles (repeats included) hashed by XXH64 with seed 42.

    A bit is 1 if it is set in over half of the shingle hashes.  Texts with fewer
    words than a shingle hash as a whole; texts without words give zero.
    """
    out = np.zeros(len(column), np.uint64)
    for chunk in text_chunks(column):
        words = split_words(lower_ascii(chunk.data), chunk.offsets)
        count = np.diff(words.first)
        grams = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
        doc = np.repeat(np.arange(len(count)), grams)
        if not len(doc):
            continue
        first = np.cumsum(grams) - grams
        head = words.first[doc] + np.arange(len(doc)) - first[doc]
        tail = np.minimum(head + shingle, words.first[doc + 1]) - 1
        start = words.start[head]
        h = xxh64(words.data, start, words.end[tail] - start)
        out[chunk.lo:chunk.hi] = majority(h, doc, grams)
    return out


def majority(h: np.ndarray, doc: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """A fingerprint for each text: the bits that over half of its hashes have; doc, ascending, is each hash's text and grams their number."""
    out = np.zeros(len(grams), np.uint64)
    have = np.flatnonzero(grams)
    ones = np.zeros((len(have), 64), np.int64)
    step = 1 << 15
    for lo in range(0, len(h), step):
        bits = np.unpackbits(h[lo:lo + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        d = doc[lo:lo + step]
        cut = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        ones[np.searchsorted(have, d[cut])] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    on = (2 * ones > grams[have][:, None]).astype(np.uint8)
    out[have] = np.packbits(on, axis=1, bitorder="little").view("<u8").ravel()
    return out


class Node(NamedTuple):
    """A tree node; children are node numbers, or -(leaf + 1)."""

    vantage: int
    radius: int
    inside: int
    outside: int


def distance(points: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage)).astype(np.int16)


def choose(points: np.ndarray, rng: np.random.Generator, reach: int) -> tuple[int, int] | None:
    """Vantage point and radius that split points evenly with few near the border; None if none helps."""
    best = None
    for v in rng.choice(points, min(8, len(points)), replace=False):
        d = distance(points, int(v))
        radius = int(np.median(d))
        for r in (radius - 1, radius):
            inside = int((d <= r).sum())
            if 0 < inside < len(d):
                near = int(((d > r - reach) & (d <= r + reach)).sum())
                cost = max(inside, len(d) - inside) + near
                if best is None or cost < best[0]:
                    best = cost, int(v), r
    return best[1:] if best and best[0] < 1.9 * len(points) else None


def fit_tree(sample: np.ndarray, leaf: int, reach: int, seed: int = 7) -> tuple[list[Node], int]:
    """Nodes in breadth order and the number of leaves; leaves hold at most `leaf` sample points if they can be split."""
    rng = np.random.default_rng(seed)
    nodes: list[Node] = []
    leaves = 0
    todo = [(sample, -1, False)]
    for points, parent, inside in todo:
        split = choose(points, rng, reach) if len(points) > leaf else None
        if split is None:
            me = -(leaves + 1)
            leaves += 1
        else:
            me = len(nodes)
            nodes.append(Node(*split, 0, 0))
            d = distance(points, split[0])
            todo += [(points[d <= split[1]], me, True), (points[d > split[1]], me, False)]
        if parent >= 0:
            nodes[parent] = nodes[parent]._replace(**{"inside" if inside else "outside": me})
    return nodes, leaves


def route(points: np.ndarray, nodes: list[Node], reach: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(leaf, indices, resident): where each point lives, and each further leaf it must visit.

    Residents near a border visit only the outer side; visitors follow both sides
    that may hold a point within reach.  Each close pair so meets at least once.
    """
    todo = [(0 if nodes else -1, np.arange(len(points)), True)]
    while todo:
        at, rows, resident = todo.pop()
        if not len(rows):
            continue
        if at < 0:
            yield -at - 1, rows, resident
            continue
        node = nodes[at]
        d = distance(points[rows], node.vantage)
        home = d <= node.radius
        if resident:
            todo += [(node.inside, rows[home], True), (node.outside, rows[~home], True),
                     (node.outside, rows[home & (d > node.radius - reach)], False)]
        else:
            todo += [(node.inside, rows[d <= node.radius + reach], False), (node.outside, rows[d > node.radius - reach], False)]


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a[i] and b[i] in a forest whose roots are the smallest members."""
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def compare(points: np.ndarray, root: np.ndarray, residents: np.ndarray, visitors: np.ndarray, reach: int) -> None:
    """Link residents with each other and with visitors; block by block."""
    queries = np.concatenate([residents, visitors])
    target = points[residents]
    step = max(1, (1 << 20) // max(1, len(residents)))
    for lo in range(0, len(queries), step):
        q = queries[lo:lo + step]
        i, j = np.nonzero(np.bitwise_count(points[q][:, None] ^ target[None, :]) <= reach)
        merge(root, q[i], residents[j])


def masks(reach: int) -> np.ndarray:
    """All 64-bit words with 1 to `reach` bits."""
    words, last = [], [0]
    for _ in range(reach):
        last = sorted({w | 1 << b for w in last for b in range(64) if not w >> b & 1})
        words += last
    return np.array(words, np.uint64)


def probe(points: np.ndarray, root: np.ndarray, residents: np.ndarray, visitors: np.ndarray, reach: int) -> None:
    """Exact links of a dense ball that no vantage point splits: look up each point's near words, linear in the points."""
    order = residents[np.argsort(points[residents], kind="stable")]
    keys = points[order]
    queries = np.concatenate([residents, visitors])
    for word in np.concatenate([np.zeros(1, np.uint64), masks(reach)]):
        want = points[queries] ^ word
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        hit = keys[at] == want
        merge(root, queries[hit], order[at[hit]])


def link_shard(points: np.ndarray, resident: np.ndarray, reach: int, leaf: int = 256, dense: int = 20000) -> np.ndarray:
    """Forest over distinct-or-equal points: root[i] is the smallest linked index found from residents."""
    root = np.arange(len(points))
    rng = np.random.default_rng(11)
    todo = [(np.flatnonzero(resident), np.flatnonzero(~resident))]
    while todo:
        live, guests = todo.pop()
        if not len(live):
            continue
        split = choose(points[live], rng, reach) if len(live) > leaf else None
        if split is None:
            (probe if len(live) > dense else compare)(points, root, live, guests, reach)
            continue
        v, r = split
        d, g = distance(points[live], v), distance(points[guests], v)
        inside = live[d <= r]
        todo += [(inside, guests[g <= r + reach]),
                 (live[d > r], np.concatenate([guests[g > r - reach], inside[d[d <= r] > r - reach]]))]
    return root


def text_hash(text_col: str = "text") -> F.Column:
    """Tells rows of equal id apart; null text as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def blocks(reach: int) -> list[int]:
    """Masks of reach + 1 runs of bits that make up the 64."""
    edges = [64 * i // (reach + 1) for i in range(reach + 2)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]


def shards_of(points: np.ndarray, trees: list[tuple[int, list[Node]]]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(tree, leaf, indices): the shard of each tree that a point is in."""
    for k, (mask, nodes) in enumerate(trees):
        for leaf, at, _ in route(points & np.uint64(mask), nodes, 0):
            yield k, leaf, at


def sampled(table: DataFrame, share: float, most: int) -> DataFrame:
    """About that share of the rows, by a hash of fp; at most `most`."""
    return table.where(F.pmod(F.hash("fp"), F.lit(1000003)) < int(1000003 * share) + 1).limit(most)


def close_links(classes: DataFrame, reach: int, scratch: Scratch, shard_size: int = 32768, sample_size: int = 1 << 20) -> DataFrame:
    """(a, b): links between the distinct fingerprints fp whose components are those of all pairs within reach."""
    n = classes.count()
    shares = max(1, -(-n // shard_size))
    trees: list[tuple[int, list[Node]]] = [((1 << 64) - 1, [])]
    if shares > 1:
        want = min(sample_size, n, 64 * shares)
        points = np.array([r["fp"] for r in sampled(classes.select("fp"), want / n, 2 * want).collect()], np.int64).view(np.uint64)
        trees = [(mask, fit_tree(points & np.uint64(mask), max(1, len(points) // shares), 0)[0]) for mask in blocks(reach)]

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches(rows, text="fp"):
            fp = table.column("fp").to_numpy()
            for k, leaf, at in shards_of(fp.view(np.uint64), trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(np.full(len(at), leaf, np.int32)), pa.array(fp[at])],
                                                 names=["tree", "leaf", "fp"])

    dealt = scratch.keep(arrow_map(classes.select("fp"), deal, "tree int, leaf int, fp bigint"))
    # Fewer than n * trees / (4 * shard_size) shards can be that large.
    large = {(r["tree"], r["leaf"]): r["n"] for r in dealt.groupBy("tree", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > 4 * shard_size).collect()}
    second: dict[tuple[int, int], list[Node]] = {}
    if large:
        held = sum(large.values())
        inside = dealt.join(F.broadcast(dealt.sparkSession.createDataFrame(list(large), "tree int, leaf int")), ["tree", "leaf"])
        want = min(sample_size, held)
        seen: dict[tuple[int, int], list[int]] = {}
        for r in sampled(inside, want / held, 2 * want).collect():
            seen.setdefault((r["tree"], r["leaf"]), []).append(r["fp"])
        for key, points in seen.items():
            second[key] = fit_tree(np.array(points, np.int64).view(np.uint64), max(8, len(points) * shard_size // large[key]), reach)[0]

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches(rows, text="fp"):
            k, leaf, fp = (table.column(c).to_numpy() for c in ("tree", "leaf", "fp"))
            shard = k.astype(np.int64) << 32 | leaf
            order = np.argsort(shard, kind="stable")
            head = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0])
            for lo, hi in zip(head.tolist(), [*head[1:].tolist(), len(order)], strict=True):
                rows_of = order[lo:hi]
                key = int(k[rows_of[0]]), int(leaf[rows_of[0]])
                for sub, at, resident in route(fp[rows_of].view(np.uint64), second.get(key, []), reach):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), v, np.int32)) for v in (*key, sub)]
                                                     + [pa.array(fp[rows_of[at]]), pa.array(np.full(len(at), resident))], names=["tree", "leaf", "sub", "fp", "resident"])

    def link(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy()
        order = np.argsort(fp, kind="stable")
        fp = np.ascontiguousarray(fp[order])
        root = link_shard(fp.view(np.uint64), table.column("resident").to_numpy(zero_copy_only=False)[order], reach)
        far = np.flatnonzero(fp[root] != fp)
        return pa.table({"a": fp[far], "b": fp[root[far]]})

    return arrow_map(dealt, cut, "tree int, leaf int, sub int, fp bigint, resident boolean").groupBy("tree", "leaf", "sub").applyInArrow(link, "a bigint, b bigint")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, reach: int = 2,
                   shard_size: int = 32768, sample_size: int = 1 << 20) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, text_hash (XXH64 of the text).

    Fingerprints link at `reach` or fewer differing bits; component_id is the
    smallest doc_id reachable.  Null, empty and blank texts have fingerprint zero
    and link like any other.  Null ids are carried and never are a component_id
    unless a component has no other; repeated rows are all returned.  The trees are
    fitted on at most `sample_size` fingerprints (twice that where a hash deals them
    unevenly), 64 for each shard of about `shard_size`; every fingerprint is then
    indexed and compared.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches(rows):
            fp = pa.array(fingerprints_of(t.column("text"), shingle).view(np.int64))
            yield from pa.table({"doc_id": t.column("doc_id"), "text_hash": t.column("text_hash"), "fp": fp}).to_batches()

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_hash(text_col).alias("text_hash"))
    signed = scratch.keep(arrow_map(texts, sign, f"doc_id {kind}, text_hash bigint, fp bigint"))
    classes = scratch.keep(signed.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(close_links(classes, reach, scratch, shard_size, sample_size), scratch)
    named = scratch.keep(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    least = scratch.keep(named.groupBy("root").agg(F.min("first_id").alias("component_id")))
    members = scratch.keep(lookup(named, least, "root").select("fp", "component_id"))
    out = scratch.keep(lookup(signed, members, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "text_hash"))
    scratch.only(out)
    return out
