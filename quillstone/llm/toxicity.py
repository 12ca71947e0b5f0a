"""Toxic spans by a linear-chain conditional random field over words.

Words are tagged clean or toxic, one chain per sentence.  A word's features are hashes
of itself and of its first 3 to 6 bytes.  Labels are of whole documents, so words
are labelled first: a word of a toxic document counts as toxic if one of its features
is significantly tied to toxic documents.  The field is fitted on a bounded sample of
such sentences; forward-backward marginals, computed for all sentences of a chunk at
once by products of 2 x 2 matrices over doubling distances, give each word's
probability, from which a document gets its score and the offsets that offend.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import Chunk, arrow_map, batches, lower_ascii, text_chunks, xxh64
from .langid import held_out
from .scratch import Scratch

#: Bytes of the prefixes that are features beside the whole word.
PREFIXES = (3, 4, 5, 6)
#: Longest chain that is learnt from, in words; longer sentences are cut for learning only.
WINDOW = 64
#: Log-odds of a word are held within this range.
REACH = 20.0


class Tokens(NamedTuple):
    """Words of a chunk: lower-cased bytes, starts and ends in it, each document's first word, and whether a word begins a sentence."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    begins: np.ndarray


def tokens(chunk: Chunk) -> Tokens:
    """Words are runs of ASCII letters and digits and of bytes beyond ASCII; sentences end at . ! ? and line feeds."""
    low = lower_ascii(chunk.data)
    # Capitals of Latin-1 (C3 80 to C3 9E but the multiplication sign) lie 0x20 below their small letters.
    second = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
    low[second] += 0x20
    solid = ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)) | (low >= 128)
    edge = np.zeros(len(low) + 1, bool)
    edge[chunk.offsets] = True
    start = np.flatnonzero(solid & (edge[:-1] | ~np.r_[False, solid[:-1]]))
    end = np.flatnonzero(solid & (edge[1:] | ~np.r_[solid[1:], False])) + 1
    first = np.searchsorted(start, chunk.offsets)
    stops = np.concatenate([[0], np.cumsum((low == 46) | (low == 33) | (low == 63) | (low == 10))])[start]
    begins = np.zeros(len(start) + 1, bool)
    begins[first] = True
    begins[1:-1] |= stops[1:] > stops[:-1]
    return Tokens(low, start, end, first, begins[:-1])


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Feature hashes of the words data[start:end], one row a word; 0 where a word is too short for a prefix."""
    size = end - start
    out = [xxh64(data, start, size, 1)]
    for k in PREFIXES:
        out.append(np.where(size > k, xxh64(data, start, np.minimum(size, k), 2), 0))
    return np.stack(out, axis=1)


def products(m: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each item the product of its chain's matrices from the chain's first item to it, each up to a factor; place counts from 0 in the chain."""
    m = m.copy()
    step, most = 1, int(place.max(initial=0))
    while step <= most:
        at = np.flatnonzero(place >= step)
        a, b = m[at - step], m[at]
        c = np.stack([a[:, 0] * b[:, 0] + a[:, 1] * b[:, 2], a[:, 0] * b[:, 1] + a[:, 1] * b[:, 3],
                      a[:, 2] * b[:, 0] + a[:, 3] * b[:, 2], a[:, 2] * b[:, 1] + a[:, 3] * b[:, 3]], axis=1)
        m[at] = c / c.sum(1, keepdims=True)
        step *= 2
    return m


class Chains(NamedTuple):
    """Marginals of a chunk's chains: log-odds of the tag toxic for each word, and for each word but the first of a chain the joint weights of its tag and the one before."""

    odds: np.ndarray
    joint: np.ndarray
    inner: np.ndarray


def forward_backward(emit: np.ndarray, begins: np.ndarray, move: np.ndarray, enter: float) -> Chains:
    """emit: log-odds a word's features give for toxic; move: 2 x 2 log weights from tag to tag; enter: log-odds of a chain's first tag."""
    n = len(emit)
    hot = np.exp(np.clip(emit, -REACH, REACH))
    go = np.exp(move)
    m = np.stack([np.full(n, go[0, 0]), go[0, 1] * hot, np.full(n, go[1, 0]), go[1, 1] * hot], axis=1)
    m[begins] = np.stack([np.ones(n), np.exp(enter) * hot] * 2, axis=1)[begins]
    head = np.flatnonzero(begins)
    place = np.arange(n) - head[np.cumsum(begins) - 1] if n else np.zeros(0, np.int64)
    last = np.append(begins[1:], True)[:n]
    tail = np.flatnonzero(last)
    rest = tail[np.cumsum(last) - last] - np.arange(n) if n else place
    alpha = products(m, place)[:, :2]
    # Products towards the end are those of the transposed matrices from the end.
    after = products(m[::-1][:, [0, 2, 1, 3]], rest[::-1])[::-1][:, [0, 2, 1, 3]]
    beta = np.ones((n, 2))
    more = np.flatnonzero(~last)
    beta[more] = np.stack([after[more + 1, 0] + after[more + 1, 1], after[more + 1, 2] + after[more + 1, 3]], axis=1)
    both = alpha * beta
    tiny = 1e-300
    odds = np.clip(np.log(np.maximum(both[:, 1], tiny)) - np.log(np.maximum(both[:, 0], tiny)), -REACH, REACH)
    inner = np.flatnonzero(~begins)
    a, b, step = alpha[inner - 1], beta[inner], m[inner]
    joint = np.stack([a[:, 0] * step[:, 0] * b[:, 0], a[:, 0] * step[:, 1] * b[:, 1], a[:, 1] * step[:, 2] * b[:, 0], a[:, 1] * step[:, 3] * b[:, 1]], axis=1)
    return Chains(odds, joint / np.maximum(joint.sum(1, keepdims=True), tiny), inner)


def share(odds: np.ndarray) -> np.ndarray:
    """The probability of log-odds."""
    return 1 / (1 + np.exp(-odds))


class Field(NamedTuple):
    """A fitted field: slots that hold a feature's hash and weight, tag weights, and the line from a document's largest log-odds to those of its label."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    move: np.ndarray
    enter: float
    slope: float
    level: float

    def emissions(self, found: np.ndarray) -> np.ndarray:
        slot = (found >> np.uint64(64 - (len(self.keys).bit_length() - 1))).astype(np.int64)
        return self.bias + np.where(self.keys[slot] == found, self.weights[slot], 0).sum(1)


#: Nothing learnt: every score is 0.
BLANK = Field(np.zeros(2, np.uint64), np.zeros(2), -REACH, np.zeros((2, 2)), 0.0, 1.0, -REACH)


def fit_field(found: np.ndarray, tags: np.ndarray, begins: np.ndarray, rounds: int = 50, pull: float = 1e-4, slots: int = 1 << 18) -> Field:
    """Maximise the tags' likelihood by gradient steps (Adam) on the weights of the features seen, the tag weights and the bias, with an L2 pull."""
    seen, at = np.unique(found, return_inverse=True)
    at = at.reshape(found.shape)
    live = seen != 0
    n = len(seen)
    x = np.zeros(n + 6)  # feature weights, bias, enter, move
    x[n] = -2.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    inner = np.flatnonzero(~begins)
    pairs = np.bincount(2 * tags[inner - 1] + tags[inner], minlength=4)
    for t in range(1, rounds + 1):
        w = np.where(live, x[:n], 0)
        chains = forward_backward(x[n] + w[at].sum(1), begins, x[n + 2:].reshape(2, 2), x[n + 1])
        miss = tags - share(chains.odds)
        g = np.zeros_like(x)
        g[:n] = np.bincount(at.ravel(), np.repeat(miss, at.shape[1]), minlength=n) * live
        g[n], g[n + 1] = miss.sum(), miss[begins].sum()
        g[n + 2:] = pairs - chains.joint.sum(0)
        g = g / max(1, len(tags)) - pull * x
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x += 0.15 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
    keys, weights = np.zeros(slots, np.uint64), np.zeros(slots, np.float32)
    slot = (seen >> np.uint64(64 - (slots.bit_length() - 1))).astype(np.int64)
    order = np.argsort(np.abs(x[:n]), kind="stable")  # of two features of one slot the heavier one stays
    order = order[live[order]]
    keys[slot[order]], weights[slot[order]] = seen[order], x[:n][order]
    return Field(keys, weights, float(x[n]), x[n + 2:].reshape(2, 2).copy(), float(x[n + 1]), 1.0, 0.0)


def fit_line(peak: np.ndarray, toxic: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(slope, level) of the logistic line from a document's largest log-odds to its label (Newton steps, pulled to slope 1 and level 0)."""
    a = np.stack([peak, np.ones(len(peak))], axis=1)
    x = np.array([1.0, 0.0])
    pull = np.array([1.0, 0.1])
    for _ in range(rounds):
        p = share(np.clip(a @ x, -30, 30))
        g = a.T @ (toxic - p) - pull * (x - [1.0, 0.0])
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pull), g)
        x = x + np.clip(step, -1, 1)
    return max(float(x[0]), 1e-3), float(x[1])


def draw(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, toxic) of at most `rows` labelled toxic documents and three times as many clean ones that aren't held out, chosen by a hash of the id."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = known.where("toxic = 1").orderBy(*order).limit(rows).union(known.where("toxic = 0").orderBy(*order).limit(3 * rows))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    met = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.struct(F.xxhash64("text"), "text").alias("t"))
    # Rows that share an id bring one text, so the bound holds for any table.
    return met.groupBy("doc_id", "toxic").agg(F.min("t").alias("t")).select("t.text", "toxic")


def tied(sample: DataFrame, weight: float = 30.0, odds: float = 3.0) -> np.ndarray:
    """Features tied to toxic documents: by the documents that hold them, a log-likelihood ratio of `weight` or more and log-odds of `odds` or more."""
    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches(rows, 2 << 20):
            toxic = table.column("toxic").to_numpy()
            for chunk in text_chunks(table.column("text")):
                t = tokens(chunk)
                found = features(t.data, t.start, t.end)
                doc = np.repeat(np.arange(chunk.lo, chunk.hi), np.diff(t.first))
                pair = np.stack([np.repeat(doc, found.shape[1]).astype(np.uint64), found.ravel()])
                order = np.lexsort(pair)
                pair = pair[:, order]
                new = np.r_[True, (pair[:, 1:] != pair[:, :-1]).any(0)][:pair.shape[1]] & (pair[1] != 0)
                feature, of = pair[1][new], toxic[pair[0][new].astype(np.int64)]
                names, at = np.unique(feature, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.bincount(at, of, minlength=len(names)).astype(np.int64)),
                                                  pa.array(np.bincount(at, 1 - of, minlength=len(names)).astype(np.int64))], names=["f", "pos", "neg"])

    totals = sample.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in totals}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos:
        return np.zeros(0, np.uint64)
    counts = arrow_map(sample, count, "f bigint, pos bigint, neg bigint").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    lift = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    held = F.col("pos") + F.col("neg")
    ratio = 2 * (F.col("pos") * F.log(F.greatest("pos", F.lit(1e-9)) / (held * pos / (pos + neg))) + F.col("neg") * F.log(F.greatest("neg", F.lit(1e-9)) / (held * max(neg, 1e-9) / (pos + neg))))
    # Each such feature is in several of the sample's toxic documents, so the sample's bound holds for them.
    return np.sort(np.array([r["f"] for r in counts.where((lift >= odds) & (ratio >= weight)).select("f").collect()], np.int64).view(np.uint64))


def sentences(sample: DataFrame, marks: np.ndarray, most: int) -> list:
    """At most `most` chains with a toxic word and as many without: words joined by a space, and a tag byte for each; chosen by a hash."""
    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches(rows, 2 << 20):
            toxic = table.column("toxic").to_numpy()
            for chunk in text_chunks(table.column("text")):
                t = tokens(chunk)
                found = features(t.data, t.start, t.end)
                doc = np.repeat(np.arange(chunk.lo, chunk.hi), np.diff(t.first))
                hit = np.isin(found, marks).any(1)
                tag = (hit & (toxic[doc] == 1)).astype(np.uint8)
                # Toxic documents in which no word is tied to the label say nothing about words.
                use = (toxic == 0) | (np.bincount(doc, tag, minlength=len(toxic)) > 0)
                head = np.flatnonzero(t.begins)
                place = np.arange(len(doc)) - head[np.cumsum(t.begins) - 1] if len(doc) else doc
                heads = np.flatnonzero(place % WINDOW == 0)
                tails = np.append(heads[1:], len(doc))
                keep = [(i, j) for i, j in zip(heads.tolist(), tails.tolist(), strict=True) if use[doc[i]]]
                raw = t.data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b" ".join(raw[t.start[k]:t.end[k]] for k in range(i, j)) for i, j in keep], pa.binary()),
                     pa.array([tag[i:j].tobytes() for i, j in keep], pa.binary()), pa.array([bool(tag[i:j].any()) for i, j in keep], pa.bool_())], names=["words", "tags", "toxic"])

    chains = arrow_map(sample, cut, "words binary, tags binary, toxic boolean")
    order = [F.xxhash64("words"), "words", "tags"]
    return [r for toxic in (True, False) for r in chains.where(F.col("toxic") == toxic).orderBy(*order).limit(most).collect()]


def chain_arrays(chains: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, tags and beginnings of the chains' words."""
    data = np.frombuffer(b"".join(r["words"] + b" " for r in chains), np.uint8)
    ends = np.flatnonzero(data == 32)
    tags = np.frombuffer(b"".join(r["tags"] for r in chains), np.uint8).astype(np.int64)
    begins = np.zeros(len(ends), bool)
    begins[np.cumsum([0, *(len(r["tags"]) for r in chains[:-1])])] = True
    return features(data, np.r_[0, ends[:-1] + 1], ends), tags, begins


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 2000, chains: int = 5_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Field:
    """Fit on at most `sample_rows` toxic and 3 * `sample_rows` clean labelled documents that aren't held out, and at most 2 * `chains` of their sentences.

    Several labels of a document count as toxic if one is; null labels and ids don't
    count.  Without a feature tied to toxic documents nothing is learnt.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.keep(draw(docs, labels, sample_rows, id_col, text_col, label_col))
    marks = tied(sample)
    held = sentences(sample, marks, chains) if len(marks) else []
    if not held:
        scratch.only()
        return BLANK
    field = fit_field(*chain_arrays(held))
    seen = np.array([(r["peak"], r["toxic"]) for r in tagged(sample, field, "toxic").select("peak", F.col("kept").alias("toxic")).collect()], float).reshape(-1, 2)
    slope, level = fit_line(seen[:, 0], seen[:, 1])
    scratch.only()
    return field._replace(slope=slope, level=level)


def tagged(docs: DataFrame, field: Field, keep: str, text_col: str = "text") -> DataFrame:
    """(kept, peak, spans) of each row: the column `keep`, the largest log-odds of a word, and the stretches of words more likely toxic than not.

    A span has start and end (characters of the text, from 0) and its words' largest probability.
    """
    kind = docs.schema[keep].dataType.simpleString()
    shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches(rows):
            for chunk in text_chunks(table.column("text")):
                t = tokens(chunk)
                # Words that occur again in the chunk have the same features.
                whole = xxh64(t.data, t.start, t.end - t.start)
                _, some, at = np.unique(whole, return_index=True, return_inverse=True)
                emit = field.emissions(features(t.data, t.start[some], t.end[some]))[at]
                odds = forward_backward(emit, t.begins, field.move, field.enter).odds
                n = chunk.hi - chunk.lo
                doc = np.repeat(np.arange(n), np.diff(t.first))
                peak = np.full(n, -REACH)
                np.maximum.at(peak, doc, odds)
                hot = odds >= 0
                head = np.flatnonzero(hot & (t.begins | ~np.r_[False, hot[:-1]]))
                tail = np.flatnonzero(hot & np.r_[t.begins[1:] | ~hot[1:], np.ones(min(1, len(hot)), bool)])
                chars = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
                base = chars[chunk.offsets[doc[head]]]
                most = np.maximum.reduceat(share(odds), np.stack([head, np.minimum(tail + 1, len(odds) - 1)], axis=1).ravel())[::2] if len(head) else np.zeros(0)
                # reduceat ends before the second index, which falls short for a span at the very end.
                most = np.maximum(most, share(odds[tail])) if len(head) else most
                items = pa.StructArray.from_arrays([pa.array(chars[t.start[head]] - base), pa.array(chars[t.end[tail]] - base), pa.array(most)],
                                                   names=["start", "end", "probability"])
                cut = np.searchsorted(doc[head], np.arange(n + 1)).astype(np.int32)
                kept = table.column("kept").slice(chunk.lo, n)
                yield from pa.table({"kept": kept, "peak": peak, "spans": pa.ListArray.from_arrays(pa.array(cut), items).cast(shape)}).to_batches()

    sent = docs.select(F.col(keep).alias("kept"), F.col(text_col).alias("text"))
    return arrow_map(sent, run, f"kept {kind}, peak double, spans array<struct<start: bigint, end: bigint, probability: double>>")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from `threshold` on), spans (start, end, probability; characters).

    Whole texts are read and only the text is an input of a score.  Null texts and texts
    without words score like the cleanest ones and have no spans, as does every
    text if nothing was learnt.  Null ids and repeated rows are scored like any other
    row and null ids are never learnt from; equal texts have equal scores.
    """
    field = train(docs, labels, sample_rows, id_col=id_col, text_col=text_col, label_col=label_col)
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.lit(field.level) + F.lit(field.slope) * F.col("peak")))))
    scored = tagged(docs, field, id_col, text_col).select(F.col("kept").alias("doc_id"), score.alias("score"), "spans")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
