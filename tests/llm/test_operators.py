"""Corpus operators against brute force, round trips and held-out accuracy, with awkward rows."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillstone.llm import bpe, bytesops, langid, media, packing, passages, queries, sharding, simhash, substring_dedup, suffix_dedup, url_filter
from quillstone.llm.components import components
from quillstone.llm.exact_dedup import distinct_texts, exact_dedup
from quillstone.llm.scratch import Scratch

from . import brute
from ..oracle import check, connect

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def passage(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghé中") for _ in range(rng.randrange(1, 7))) for _ in range(n))


def awkward() -> list[tuple[int, str | None]]:
    """Copies, near copies, shared and self-repeating passages, blanks, nulls, a long text, several scripts."""
    rng = random.Random(4)
    base = [passage(rng, rng.randrange(1, 150)) for _ in range(30)]
    shared = passage(rng, 45)
    rows = [*base, *base[:6], None, "", "  \t\n", "one", "one two", *(b.replace(" ", "  ", 3) for b in base[6:9]), *(f"{b} extra" for b in base[9:15]),
            *(f"{b} {shared} {passage(rng, 20)}" for b in base[15:22]), f"{shared} middle {shared}", shared, passage(rng, 9000), "x" * 3000, "x" * 700, "ab" * 400, "。" * 200]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(3 * d, rows[i]) for d, i in enumerate(order)]


ROWS = awkward()


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(d, t, "en", "s", None) for d, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, sf, name):
    check(spark, connect(sf), sf, queries.QUERIES[name], queries.SQL[name])


@given(st.lists(st.binary(max_size=100), min_size=1, max_size=20))
@settings(max_examples=50, deadline=None)
def test_xxh64(blobs):
    import xxhash

    size = np.array([len(b) for b in blobs])
    got = bytesops.xxh64(np.frombuffer(b"".join(blobs), np.uint8), np.cumsum(size) - size, size)
    assert got.tolist() == [xxhash.xxh64_intdigest(b, seed=42) for b in blobs]


def test_exact(spark):
    got = {r["doc_id"]: r for r in exact_dedup(frame(spark)).collect()}
    want = brute.exact(ROWS)
    assert {d: r["keep_id"] for d, r in got.items()} == want
    assert all(r["kept"] == (d == want[d]) for d, r in got.items())


def test_exact_repeated_rows_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, "c"), (2, "d")]
    got = exact_dedup(frame(spark, rows)).collect()
    assert len(got) == 7 and sum(r["kept"] for r in got) == 4
    assert sorted((r["doc_id"] or 0, r["text"]) for r in distinct_texts(frame(spark, rows)).collect()) == [(0, "b"), (1, "a"), (2, "c"), (2, "d")]


@pytest.mark.parametrize("share", [2, 64])
def test_exact_heavy_split_agrees(spark, share):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 40}") for i in range(400)]
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup(frame(spark, rows), share=share).collect()}
    assert got == brute.exact(rows)


def test_simhash(spark):
    got = {r["doc_id"]: r for r in simhash.simhash_groups(frame(spark)).collect()}
    assert {d: int(r["fingerprint"], 16) for d, r in got.items()} == {d: brute.simhash(t) for d, t in ROWS}
    assert {d: r["component_id"] for d, r in got.items()} == brute.near_groups(ROWS)


def test_vantage_tree_loses_no_pair():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 300).astype(np.uint64)
    points = np.unique(np.concatenate([centres, *(centres ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) for _ in range(4))]))
    nodes, leaves = simhash.fit_tree(points[::3], 20, 2)
    assert leaves > 10
    root = np.arange(len(points))
    held: dict[int, list] = {}
    for leaf, at, resident in simhash.route(points, nodes, 2):
        held.setdefault(leaf, []).append((at, resident))
    for parts in held.values():
        at = np.concatenate([a for a, _ in parts])
        resident = np.concatenate([np.full(len(a), r) for a, r in parts])
        order = np.argsort(at)
        at, resident = at[order], resident[order]
        local = simhash.link_shard(points[at], resident, 2, leaf=8)
        simhash.merge(root, at, at[local])
    i, j = np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2, 1))
    want = np.arange(len(points))
    simhash.merge(want, i, j)
    assert np.array_equal(root, want)


def test_dense_ball_is_probed_exactly():
    points = np.concatenate([np.zeros(1, np.uint64), simhash.masks(3)])[:3000]
    a, b = np.arange(len(points)), np.arange(len(points))
    simhash.probe(points, a, np.arange(len(points)), np.zeros(0, np.int64), 2)
    simhash.compare(points, b, np.arange(len(points)), np.zeros(0, np.int64), 2)
    assert np.array_equal(a, b)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


@pytest.mark.parametrize("frequent", [passages.FREQUENT, 0])
def test_substring(spark, monkeypatch, frequent):
    monkeypatch.setattr(passages, "FREQUENT", frequent)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(frame(spark)).collect()}
    assert got == brute.substring(ROWS)


@pytest.mark.parametrize("frequent", [passages.FREQUENT, 0])
def test_suffix(spark, monkeypatch, frequent):
    monkeypatch.setattr(passages, "FREQUENT", frequent)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.suffix_dedup(frame(spark)).collect()}
    assert got == brute.suffix(ROWS)


def test_passages_of_repeated_rows_and_null_ids(spark):
    rng = random.Random(9)
    p = passage(rng, 60)
    rows = [(5, p), (5, p), (None, p), (None, f"{p} and more"), (9, p)]
    got = [(r["doc_id"], r["n_removed"] > 0) for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(5, False), (5, False), (None, True), (None, True), (9, True)], key=str)
    assert all(r["n_removed"] >= 60 for r in substring_dedup.substring_dedup(frame(spark, rows)).collect())


@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=12), min_size=1, max_size=5))
@settings(max_examples=80, deadline=None)
def test_automaton_counts(sequences):
    automaton = substring_dedup.SuffixAutomaton(sequences, [1] * len(sequences))
    for s in sequences:
        for end, (matched, times) in enumerate(automaton.statistics(s, 3)):
            part = s[max(0, end + 1 - 3):end + 1]
            assert matched == len(part)
            assert times == sum(t[i:i + len(part)] == part for t in sequences for i in range(len(t)))


@given(st.binary(min_size=16, max_size=80).map(lambda b: bytes(x % 3 for x in b)))
@settings(max_examples=50, deadline=None)
def test_suffix_order(text):
    start = np.arange(len(text) - 15)
    for length in (9, 12, 16):
        heads = [text[i:i + length] for i in suffix_dedup.suffix_order(np.frombuffer(text, np.uint8), start, length)]
        assert heads == sorted(heads)


@given(st.lists(st.integers(0, 5), max_size=30))
@settings(max_examples=80, deadline=None)
def test_previous_smaller(values):
    got = suffix_dedup.previous_smaller(np.array(values, np.int64)).tolist()
    assert got == [max((j for j in range(i) if values[j] < v), default=-1) for i, v in enumerate(values)]


def test_shards(spark):
    got = sharding.byte_shards(frame(spark), 4).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, _ in ROWS)
    sizes = {d: len((t or "").encode()) + 1 for d, t in ROWS}
    assert all(r["size"] == sizes[r["doc_id"]] and r["text_crc32"] == zlib.crc32((dict(ROWS)[r["doc_id"]] or "").encode()) for r in got)
    at, largest = {}, max(sizes.values())
    for r in sorted(got, key=lambda r: r["doc_id"]):
        assert r["slot"] == at.get(r["shard"], 0)
        at[r["shard"]] = r["slot"] + 1
    order = [r["shard"] for r in sorted(got, key=lambda r: r["doc_id"])]
    assert order == sorted(order)
    total = [sum(sizes[r["doc_id"]] for r in got if r["shard"] == s) for s in range(4)]
    assert max(total) - min(total) <= 2 * largest


def test_urls(spark):
    urls = ["http://a.org/x", "https://EXAMPLE.org/es/1", "x://example.org/en/12", "x://example.org/en/2", "x://b.com/fr/", "x://b.com/de/x", "x://b.com/de", "x://org", "x://org/", "nohost", None,
            "x://notexample.org/es/", "x://c.net/?a://b", "x://a.example.org#/es/", "x://u:p@b.com/de/?q", "://", "a://b://c/d"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.url_verdicts(rows).collect()}
    for i, u in enumerate(urls):
        host, path = url_filter.host_and_path(u)
        fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.host + r.path), default=None)
        assert (got[i]["host"], got[i]["path"]) == (host, path), u
        assert (got[i]["rule"], got[i]["verdict"]) == ((best.host + best.path, best.verdict) if best else (None, "allow")), u


def test_cascade_is_exact_over_its_universe():
    listed, others = [f"y{i}" for i in range(50)], [f"n{i}" for i in range(5000)]
    yes, no = url_filter.key_hashes(listed), url_filter.key_hashes(others)
    first = url_filter.Bloom(yes, 0.3, 0)
    cascade = url_filter.cascade_over(first, listed, [k for k, x in zip(others, first.has(no), strict=True) if x])
    assert len(cascade.levels) > 2 and cascade.has(yes).all() and not cascade.has(no).any() and not cascade.clashing


def test_cascade_ends_where_an_unlisted_key_has_a_listed_hash(monkeypatch):
    plain = url_filter.key_hashes
    monkeypatch.setattr(url_filter, "key_hashes", lambda keys: plain([k.removesuffix("twin") for k in keys]))
    listed = ["a", "b"]
    first = url_filter.Bloom(url_filter.key_hashes(listed), 0.5, 0)
    cascade = url_filter.cascade_over(first, listed, ["atwin", "c"])
    assert cascade.clashing == {"atwin"} and cascade.has(url_filter.key_hashes(listed)).all()


@given(st.lists(st.binary(min_size=1, max_size=400), min_size=1, max_size=5))
@settings(max_examples=40, deadline=None)
def test_jpeg_round_trip(blobs):
    padded = [b + b" " * (-len(b) % 192) for b in blobs] + [bytes([128]) * 192, bytes([0, 255]) * 96]
    images = [media.parse(m) for m in media.encode_payloads(padded, [len(b) for b in padded])]
    for p, image, c in zip(padded, images, media.decode_scans(images), strict=True):
        assert (c[:image.payload_mcus] + 128).astype(np.uint8).tobytes() == p
        assert media.thumbnail(image, c).ravel()[0] == p[0]


def test_media(spark):
    got = {r["doc_id"]: r for r in media.features(media.store(frame(spark))).collect()}
    for d, t in ROWS:
        raw = (t or "").encode()
        p = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), brute.sha(p), zlib.crc32(p[-16:]))
    assert len({(r["media_sha256"], r["feature"]) for d, r in got.items() if (dict(ROWS)[d] or "") == ""}) == 1


def test_bpe(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.RANKS, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode(frame(spark), offsets=True)
    ids = {r["doc_id"]: r for r in encoded.collect()}
    back = {r["doc_id"]: r for r in bpe.decode(encoded).collect()}
    sums = {r["doc_id"]: r for r in bpe.digests(encoded).collect()}
    for d, t in ROWS:
        want = reference.encode_ordinary(t or "")
        assert ids[d]["ids"] == want
        assert bytes(back[d]["decoded"]) == (t or "").encode() and back[d]["text"] == (t or "")
        ends = np.cumsum([0, *(len(reference.decode_single_token_bytes(i)) for i in want)])
        assert ids[d]["starts"] == ends[:-1].tolist()
        assert sums[d]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()


def test_bpe_shows_split_characters(spark):
    whole = bpe.encode(spark.createDataFrame([(1, "日本🙂")], "doc_id long, text string")).first()["ids"]
    cut = spark.createDataFrame([(1, whole[:-1])], "doc_id long, ids array<int>")
    row = bpe.decode(cut).first()
    assert "日本🙂".encode().startswith(bytes(row["decoded"]))


@given(st.text(st.sampled_from("aA 1é中\n\t'.s²½ª　\u0085\x1c🙂"), max_size=40))
@settings(max_examples=200, deadline=None)
def test_splitting_agrees_with_both_libraries(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.RANKS, "rb"))} if not hasattr(bpe, "_ranks") else bpe._ranks
    bpe._ranks = ranks
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if not hasattr(bpe, "_reference") else bpe._reference
    bpe._reference = reference
    assert bpe.codec(bpe.RANKS, bpe.PATTERN).ids(text).tolist() == reference.encode_ordinary(text)
    assert packing.codec(packing.TOKENIZER, packing.PATTERN).ids(text).tolist() == Tokenizer.from_file(packing.TOKENIZER).encode(text, add_special_tokens=False).ids


def test_languages(spark, sf):
    docs = queries.documents(spark, sf.replace("sf0.001", "sf0.01"))
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = langid.languages(docs).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_languages_of_awkward_rows(spark):
    got = {r["doc_id"]: r for r in langid.languages(frame(spark, [(0, "some words"), (3, None), (6, ""), (9, "123 !?"), (12, "中文"), (15, "more words here")])).collect()}
    assert {d for d, r in got.items() if r["lang_pred"] == "und"} == {3, 6, 9}
    nothing = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid.languages(nothing).first()["lang_pred"] == "und"


@pytest.mark.parametrize("n", [2, 4, 5, 9])
def test_codewords_differ(n):
    words = langid.codewords(n, np.random.default_rng(1))
    assert len({tuple(w) for w in words.tolist()}) == n


def test_packing(spark):
    got = packing.pack_documents(frame(spark), shard_docs=20).collect()
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in ROWS}
    pieces, sequences = {}, {}
    for r in got:
        part = np.array(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] > 0 and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, x in ids.items():
        at = 0
        for start, n in sorted(pieces[d]):
            assert start == at
            at += n
        assert at == len(x)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024


def bm25(each: list[list[int]], seed: int) -> list[float]:
    """Plain BM25 (k1 1.2, b 0.75) of every document for the seed's distinct tokens."""
    n, mean = len(each), sum(map(len, each)) / len(each)
    df = {t: sum(t in x for x in each) for t in set(each[seed])}
    return [sum(np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * x.count(t) * 2.2 / (x.count(t) + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t in df if t in x) for x in each]


def test_packing_ranks_neighbours_as_plain_bm25():
    rng = np.random.default_rng(0)
    topics = [np.arange(100 * k, 100 * k + 60) for k in range(1, 5)]
    each = [rng.choice(topics[i % 4], 50 + 10 * (i % 7)).astype(np.uint32) for i in range(40)]
    df = np.bincount(packing.frequencies(each)[1], minlength=1000)
    index = packing.Index(each, packing.Statistics(40, float(np.mean([len(x) for x in each])), df), None)
    for seed in (0, 7):
        want = bm25([x.tolist() for x in each], seed)
        assert index.scores(index.heaviest(seed)) == pytest.approx(want)
        near = index.neighbours(seed, np.arange(40) != seed)
        assert near.tolist() == sorted((i for i in range(40) if want[i] and i != seed), key=lambda i: (-round(want[i], 9), i))
        assert all(i % 4 == seed % 4 for i in near)


def test_packing_over_several_shards(spark):
    rng = random.Random(2)
    topics = [[passage(rng, 1) + str(k) for _ in range(50)] for k in range(6)]
    rows = [(i, " ".join(rng.choice(topics[i % 6]) for _ in range(60))) for i in range(240)] + [(900, None), (None, "x"), (None, "x"), (901, topics[0][0] * 9000)]
    got = packing.pack_documents(frame(spark, rows), shard_docs=30, centroids=8).collect()
    assert sum(r["length"] for r in got) == sum({(r["doc_id"], r["doc_tokens"]): r["doc_tokens"] * (2 if r["doc_id"] is None else 1) for r in got}.values())
    together = {}
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 240:
            together.setdefault(r["sequence_id"], []).append(r["doc_id"] % 6)
    same = sum(x.count(max(set(x), key=x.count)) for x in together.values()) / sum(map(len, together.values()))
    assert same > 0.6  # by chance it would be about a third


def test_empty_tables(spark):
    none = frame(spark, [])
    for f in (exact_dedup, simhash.simhash_groups, substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, sharding.byte_shards, langid.languages, packing.pack_documents, distinct_texts,
              suffix_dedup.without_repeats, lambda d: media.features(media.store(d)), lambda d: bpe.digests(bpe.encode(d))):
        assert f(none).collect() == []
    assert url_filter.url_verdicts(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_clashing_columns(spark):
    names = ["text_sha256", "row_id", "fp", "rank", "th", "data", "kept", "slot", "part", "root", "ids", "media", "size", "kept_0", "gone_id", "n_removed", "text_hash"]
    docs = frame(spark, ROWS[:20]).selectExpr("*", *(f"'x' AS {n}" for n in names))
    for f in (exact_dedup, simhash.simhash_groups, substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, sharding.byte_shards, langid.languages, packing.pack_documents):
        assert f(docs).count() >= 20
    assert distinct_texts(docs).columns == docs.columns == suffix_dedup.without_repeats(docs, length_col="n_chars").columns
    assert {r["fp"] for r in suffix_dedup.without_repeats(docs).collect()} == {"x"}


def test_null_texts_in_arrow_chunks():
    chunks = list(bytesops.text_chunks(pa.array(["a", None, "é" * 5, ""]), 3))
    assert [(c.lo, c.hi) for c in chunks][-1][1] == 4
    assert b"".join(c.data.tobytes() for c in chunks).decode() == "a" + "é" * 5
