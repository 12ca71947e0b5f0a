"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a linear classifier over hashed byte
n-grams says how much a text speaks for 1 against 0.  Decoding adds the loss of
every bit's margin against a codeword and takes the language of least loss; a
text whose two least losses are close is flagged ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import P1, arrow_map, lower_ascii, text_chunks, words8

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
BUCKETS = 4096
ORDERS = (2, 4)


def histograms(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of each text's hashed byte n-grams (A-Z lower-cased; white space, digits and ASCII signs alike), one row per text."""
    low = lower_ascii(data)
    low[(low < 65) | ((low > 90) & (low < 97))] = 32
    n = len(offsets) - 1
    w8 = words8(low)
    base = np.repeat(np.arange(n, dtype=np.int64) * buckets, np.diff(offsets))
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    out = np.zeros(n * buckets, np.float32)
    for order in ORDERS:
        with np.errstate(over="ignore"):
            slot = ((w8[:len(low)] << np.uint64(64 - 8 * order)) * P1 >> shift).astype(np.int64)
        slot += base
        # The last order - 1 positions of a text would read into the next one.
        lasts = (offsets[1:, None] - np.arange(1, order)).ravel()
        whole = np.ones(len(low), bool)
        whole[lasts[(lasts >= np.repeat(offsets[:-1], order - 1))]] = False
        out += np.bincount(slot[whole], minlength=n * buckets)
    return out.reshape(n, buckets)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    seen = np.concatenate([[0], np.cumsum(ascii_letter)])
    found = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = LETTER.search(data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace")) is not None
    return found


def codewords(n: int, rng: np.random.Generator) -> np.ndarray:
    """±1 codewords, one row per language: all splits up to 5 languages, else random ones with the widest least distance found."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        splits = [[1 if s >> k & 1 else -1 for k in range(n - 1)] + [-1] for s in range(1, 2 ** (n - 1))]
        return np.array(splits, np.int8).T.copy()
    bits = max(15, int(10 * np.log2(n)))
    best, gap = None, -1
    for _ in range(200):
        words = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        far = (words[:, None, :] != words[None, :, :]).sum(2) + np.eye(n, dtype=int) * bits
        if far.min() > gap and (np.abs(words.sum(0)) < n).all():
            best, gap = words, far.min()
    return best if best is not None else words


class Model(NamedTuple):
    """Languages, their codewords, a weight per bucket and bit, and each bit's scale."""

    langs: list[str]
    words: np.ndarray
    weights: np.ndarray
    scale: np.ndarray


def profile(counts: np.ndarray) -> np.ndarray:
    """Each text's share of n-grams per bucket."""
    return counts / np.maximum(np.float32(1), counts.sum(1, keepdims=True))


def fit(counts: np.ndarray, labels: list[str], seed: int = 5) -> Model:
    """Fit one log-odds classifier per bit from labelled histograms; languages weigh equally within a side."""
    langs = sorted(set(labels))
    words = codewords(len(langs), np.random.default_rng(seed))
    share = profile(counts)
    at = np.array([langs.index(x) for x in labels], np.int64)
    centre = np.stack([share[at == k].mean(0) for k in range(len(langs))]) if langs else np.zeros((0, BUCKETS))
    weights = np.zeros((BUCKETS, words.shape[1] if langs else 1))
    smooth = 0.5 / BUCKETS
    for b in range(weights.shape[1] if len(langs) > 1 else 0):
        one, zero = centre[words[:, b] > 0].mean(0), centre[words[:, b] < 0].mean(0)
        weights[:, b] = np.log(one + smooth) - np.log(zero + smooth)
    margin = share @ weights
    scale = np.maximum(1e-9, np.abs(margin).mean(0)) if len(margin) else np.ones(weights.shape[1])
    return Model(langs, words, weights.astype(np.float32), scale)


def predict(model: Model, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, score 0 to 1, ambiguous) of each histogram by loss-weighted decoding."""
    if not model.langs:
        n = len(counts)
        return np.full(n, -1), np.zeros(n), np.ones(n, bool)
    margin = np.clip(profile(counts) @ model.weights / model.scale, -4, 4)
    loss = np.log1p(np.exp(-margin[:, None, :] * model.words[None, :, :])).sum(2)
    least = loss.min(1, keepdims=True)
    belief = np.exp(-(loss - least))
    score = 1 / belief.sum(1)
    ordered = np.sort(loss, 1)
    near = ordered[:, 1] - ordered[:, 0] < 0.5 if loss.shape[1] > 1 else np.zeros(len(loss), bool)
    return loss.argmin(1), score, near


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text leaves remainder 1 by 3; such documents are never learnt from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame, sample_rows: int = 2400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on labelled documents that aren't held out; about `sample_rows` of them if there are more, chosen by a hash of id and text."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    n = labelled.select(lang_col).count()
    few = labelled.groupBy(lang_col).count().collect()
    per = max(1, sample_rows // max(1, len(few)))
    chance = F.lit(1.0)
    for r in few:
        chance = F.when(F.col(lang_col) == r[0], min(1.0, per / r["count"])).otherwise(chance)
    drawn = labelled if n <= sample_rows else labelled.where(F.pmod(F.xxhash64(id_col, F.length(text_col)), F.lit(1 << 20)) < chance * (1 << 20))

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for chunk in text_chunks(batch.column("text")):
                hist = histograms(chunk.data, chunk.offsets)
                sparse = [np.flatnonzero(h) for h in hist]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang").slice(chunk.lo, chunk.hi - chunk.lo),
                     pa.array([s.astype("<i4").tobytes() for s in sparse], pa.binary()),
                     pa.array([h[s].astype("<i4").tobytes() for h, s in zip(hist, sparse, strict=True)], pa.binary())],
                    names=["lang", "slots", "counts"])

    got = arrow_map(drawn.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), count, "lang string, slots binary, counts binary").toArrow()
    langs = got.column("lang").to_pylist()
    sparse = [(np.frombuffer(s.as_buffer(), "<i4"), np.frombuffer(c.as_buffer(), "<i4")) for s, c in zip(got.column("slots"), got.column("counts"), strict=True)]
    order = np.lexsort((np.array([c.sum() for _, c in sparse], np.float32), langs)) if langs else np.zeros(0, int)
    # The dense histograms are the sample's only copy on the driver.
    counts = np.zeros((len(langs), BUCKETS), np.float32)
    for row, i in enumerate(order):
        slots, n = sparse[i]
        counts[row, slots] = n
    return fit(counts, [langs[i] for i in order])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, ambiguous, and the `keep` columns as kept_0, kept_1, ...

    Whole texts are read.  Null texts and texts without a letter get ``und`` with
    score 0, as does every text if no language was learnt.  Only text is an input.
    Of languages of equal loss the first by name is taken; null ids and repeated rows
    are judged like any other row.
    """
    sent = list(dict.fromkeys([id_col, text_col, *keep]))
    kinds = {c: docs.schema[c].dataType.simpleString() for c in sent}
    schema = f"doc_id {kinds[id_col]}, lang_pred string, score double, ambiguous boolean" + "".join(f", kept_{i} {kinds[c]}" for i, c in enumerate(keep))
    names = ["doc_id", "lang_pred", "score", "ambiguous", *(f"kept_{i}" for i in range(len(keep)))]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for chunk in text_chunks(batch.column(sent.index(text_col)), 1 << 18, 512):
                which, score, near = predict(model, histograms(chunk.data, chunk.offsets))
                known = has_letter(chunk.data, chunk.offsets) & (which >= 0)
                found = [model.langs[k] if ok else UNKNOWN for k, ok in zip(which.tolist(), known.tolist(), strict=True)]
                part = batch.slice(chunk.lo, chunk.hi - chunk.lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column(sent.index(id_col)), pa.array(found, pa.string()), pa.array(np.where(known, score, 0.0).astype(np.float64)),
                     pa.array(near | ~known), *(part.column(sent.index(c)) for c in keep)], names=names)

    return arrow_map(docs.select(*(F.col(c).alias(f"sent_{i}") for i, c in enumerate(sent))), run, schema)


def languages(docs: DataFrame, sample_rows: int = 2400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, ambiguous; see train and identify."""
    model = train(docs, sample_rows, id_col, text_col, lang_col)
    return identify(docs, model, id_col, text_col).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")
