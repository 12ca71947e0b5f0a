"""Null ids, repeated rows and clashing columns of the operators that take rows one by one."""

from __future__ import annotations

from quillstone.llm import bpe, langid, media, url_filter

from . import brute

DOCS = [(1, "plain words"), (1, "plain words"), (None, "plain words"), (None, None), (2, ""), (3, "中文 é")]
COLUMNS = "doc_id long, text string, ids int, media string, n_bytes string, feature int, lang string, score string, sent_0 int, kept int, data int"


def docs(spark):
    return spark.createDataFrame([(d, t, 1, "x", "x", 1, "en", "x", 1, 1, 1) for d, t in DOCS], COLUMNS).repartition(2)


def ids(df) -> list[int]:
    return sorted(r["doc_id"] or 0 for r in df.select("doc_id").collect())


def test_media(spark):
    got = media.features(media.store(docs(spark))).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"]) for r in got) == [(0, 0), (0, 11), (1, 11), (1, 11), (2, 0), (3, 10)]
    assert len({r["payload_sha256"] for r in got if r["n_bytes"] == 11}) == len({r["media_sha256"] for r in got if r["n_bytes"] == 11}) == 1


def test_encoding(spark):
    got = bpe.digests(bpe.encode(docs(spark))).collect()
    want = sorted((d or 0, brute.sha((t or "").encode())) for d, t in DOCS)
    assert sorted((r["doc_id"] or 0, r["decoded_sha256"]) for r in got) == want


def test_languages(spark):
    got = langid.languages(docs(spark))
    assert ids(got) == [0, 0, 1, 1, 2, 3]
    assert {r["doc_id"]: r["lang_pred"] for r in got.where("doc_id = 2").collect()} == {2: "und"}


def test_urls(spark):
    rows = [(1, "http://a.example.org/es/x"), (1, "http://a.example.org/es/x"), (None, "http://a.example.org/es/x"), (None, None), (2, ""), (3, "https://WWW.B.COM/de/")]
    pages = spark.createDataFrame([(i, u, 1, "x", "x", 1) for i, u in rows], "page_id long, url string, host int, path string, rule string, verdict int")
    got = sorted((r["page_id"] or 0, r["host"], r["rule"] or "", r["verdict"]) for r in url_filter.url_verdicts(pages).collect())
    listed = ("a.example.org", "example.org/es/", "block")
    assert got == [(0, "", "", "allow"), (0, *listed), (1, *listed), (1, *listed), (2, "", "", "allow"), (3, "www.b.com", "com/de/", "block")]
