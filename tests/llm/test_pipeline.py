"""The pipeline's stages, each on its own input, against brute force."""

from __future__ import annotations

import zlib

import corpus_pipeline as cp
import numpy as np
from quillstone.llm import packing
from quillstone.llm.suffix_dedup import remaining_text
from tokenizers import Tokenizer

from . import brute
from .test_near_copies import copies as near_texts
from .test_near_copies import groups as near_groups
from .test_operators import ROWS, SCHEMA, frame


def pairs(df) -> list[tuple]:
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["language ID", "exact dedup", "near dedup", "passage dedup", "packing"]
    assert cp.ORACLE_SQL is None


def test_language_stage_drops_only_texts_without_letters(spark):
    docs = frame(spark)
    kept = cp.language(spark, docs, "")
    assert kept.columns == docs.columns
    assert pairs(kept) == sorted(((d, t) for d, t in ROWS if any(c.isalpha() for c in t or "")), key=str)


def test_exact_stage(spark):
    keep = brute.exact(ROWS)
    assert pairs(cp.exact(spark, frame(spark), "")) == sorted(((d, t) for d, t in ROWS if keep[d] == d), key=str)


def test_near_stage(spark):
    root = brute.near_groups(ROWS)
    assert pairs(cp.near(spark, frame(spark), "")) == sorted(((d, t) for d, t in ROWS if root[d] == d), key=str)


def test_passage_stage(spark):
    cut = brute.suffix(ROWS)
    want = [(d, t if not cut[d][1] else remaining_text(cut[d][3])) for d, t in ROWS]
    want = [(d, t) for d, t in want if brute.WORD.search((t or "").encode())]
    got = cp.passages(spark, frame(spark), "")
    assert pairs(got) == sorted(want, key=str)
    assert all(r["n_chars"] is None or r["n_chars"] == len(r["text"]) for r in got.collect())


def test_run(spark, sf):
    out = cp.run(spark, sf)
    rows = out.collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_run_equals_the_stages_by_brute_force(spark, tmp_path):
    """Every stage of one run, up to the kept texts, which packing must hold in full."""
    rows = [*ROWS, *((9000 + i, t) for i, t in enumerate(near_texts(4, 11, 80)))]
    spark.createDataFrame([(d, t, "en", "s", None) for d, t in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    left = [(d, t) for d, t in rows if any(c.isalpha() for c in t or "")]
    keep = brute.exact(left)
    left = [(d, t) for d, t in left if keep[d] == d]
    root = near_groups(left)
    left = [(d, t) for d, t in left if root[d] == d]
    cut = brute.suffix(left)
    left = [(d, t if not cut[d][1] else remaining_text(cut[d][3])) for d, t in left]
    left = [(d, t) for d, t in left if brute.WORD.search((t or "").encode())]
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    want = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for d, t in left}
    pieces = cp.run(spark, str(tmp_path)).collect()
    got = {d: sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces if r["doc_id"] == d) for d in {r["doc_id"] for r in pieces}}
    assert got.keys() == want.keys()
    for d, ids in want.items():
        assert [s for s, *_ in got[d]] == [sum(n for _, n, *_ in got[d][:i]) for i in range(len(got[d]))]
        assert sum(n for _, n, *_ in got[d]) == len(ids) == got[d][0][3]
        assert all(zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes()) == crc for s, n, crc, _ in got[d])


def test_run_reads_each_text_once_a_stage(spark, sf, monkeypatch):
    """What a stage leaves is written: the language model decodes the documents in one pass."""
    seen = spark.sparkContext.accumulator(0)
    plain = cp.identify

    def counted(docs, *args, **options):
        def count(rows):
            for batch in rows:
                seen.add(batch.num_rows)
                yield batch

        return plain(docs.mapInArrow(count, docs.schema), *args, **options)

    monkeypatch.setattr(cp, "identify", counted)
    cp.run(spark, sf).collect()
    assert seen.value == spark.read.parquet(f"{sf}/documents.parquet").count()
