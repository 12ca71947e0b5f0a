"""The language stage where no language can be learnt."""

from __future__ import annotations

import corpus_pipeline as cp


def test_texts_with_letters_stay_without_labels(spark):
    rows = [(1, "plain words", None), (2, "中文", None), (3, "12 + 3", None), (4, None, None), (5, "été", None)]
    docs = spark.createDataFrame([(d, t, lang, "s", None) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.language(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5]
