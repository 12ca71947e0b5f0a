"""Scalar functions against values worked out by hand."""

from __future__ import annotations

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillstone.functions import extract, ids, text
from quillstone.functions.similarity import similarity


def value(spark, column, **inputs):
    row = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} string" for k in inputs)) if inputs else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("given", "expected"), [("  a　 b\n\tc ", "a b c"), (None, ""), ("\x1c x", "x"), ("", "")])
def test_normalize_space(spark, given, expected):
    assert value(spark, text.normalize_space(F.col("a")), a=given) == expected


@pytest.mark.parametrize(("given", "limit", "expected"), [("abcdef", 5, "ab..."), ("abcde", 5, "abcde"), ("a\nb", 9, "a b"), (None, 3, "")])
def test_truncate(spark, given, limit, expected):
    assert value(spark, text.truncate(F.col("a"), limit), a=given) == expected


def test_keys(spark):
    assert value(spark, text.match_key(F.col("a")), a="酱香·Ab-1（礼盒）(x)") == "酱香ab1"
    assert value(spark, text.name_key(F.col("a")), a="A·b •c") == "abc"
    assert value(spark, text.first_nonblank(F.col("a"), F.col("b"), placeholders=text.SHEET_PLACEHOLDERS), a=" - ", b=" x ") == "x"
    assert value(spark, text.clean_cell(F.col("a")), a="12.0") == "12"
    assert value(spark, text.clean_cell(F.col("a")), a="暂无") is None
    assert value(spark, text.truthy(F.col("a")), a="是") is True
    assert value(spark, text.escape_query("t", F.col("a")), a="a'\\") == "t:'a\\'\\\\'"


def test_lists(spark):
    assert value(spark, text.tags(F.col("a"), 8), a="a, b，a、；c") == ["a", "b", "c"]
    assert value(spark, text.tokens(F.col("a")), a="Ab 中国人 1") == ["ab", "中国人", "1", "中国", "国人"]
    lines = text.labelled([("x", F.col("a"), 20), ("y", F.col("b"), 20), ("z", F.lit("12345678"), 5)])
    assert value(spark, lines, a="Same", b=" same ") == "x：Same\nz：12..."


def test_ids(spark):
    assert value(spark, ids.valid_sha1(F.col("a")), a=" " + "A" * 40) == "a" * 40
    assert value(spark, ids.valid_sha1(F.col("a")), a="zz") == ""
    assert value(spark, ids.whole_number(F.col("a")), a="12.7") == 12
    assert value(spark, ids.row_number_of(F.col("a")), a="x_r12") == 12
    assert value(spark, ids.posix_path(F.col("a")), a=r".\a\b") == "a/b"
    assert value(spark, ids.field_doc_id(F.lit("p"), F.lit("f"), F.lit(3))) == "p__field__f__003"
    assert value(spark, ids.sniff_media(F.unhex(F.lit("FFD8FFE000")))) == "image/jpeg"


def test_extract(spark):
    assert value(spark, extract.label(F.col("a"), "brand"), a="品牌: 甲乙，x") == "甲乙"
    assert value(spark, extract.product_name(F.col("a")), a="first line\nsecond") == "first line"
    assert value(spark, extract.json_in_prose(F.col("a")), a='so {"a": 1} it is') == '{"a": 1}'
    assert value(spark, extract.json_in_prose(F.col("a")), a="none") is None
    assert value(spark, extract.json_map(F.col("a")), a='{"k": "v"}') == {"k": "v"}
    assert value(spark, extract.json_map(F.col("a")), a="bad") == {}
    assert value(spark, extract.brand_and_series(F.col("a")), a="甲·乙").asDict() == {"brand": "甲", "series": "乙"}
    assert value(spark, extract.text_quality(F.col("a")), a="中" * 200) is True
    assert value(spark, extract.text_quality(F.col("a")), a="a" * 300) is False
    assert value(spark, extract.brand_and_series(F.col("a")), a="甲（乙）").asDict() == {"brand": "甲", "series": ""}
    assert value(spark, extract.brand_and_series(F.col("a")), a="字" * 21 + "·乙").asDict() == {"brand": "", "series": "乙"}
    assert value(spark, extract.gift_attributes(F.col("a")), a="适合聚会、礼赠，节庆礼盒") == "礼赠、聚会、节庆"


def test_version_signals_and_search_terms(spark):
    signals = value(spark, extract.version_signals(F.col("a")), a="茅台（珍品） V30 精品 3号 藏10 端午纪念（珍 品）丙午马年 500ml")
    assert signals == ["珍品", "V30", "精品 3号", "藏10", "丙午马年", "端午纪念"]
    terms = value(spark, extract.search_terms(F.col("a"), F.col("b")), a="大民族酒·陈任远 精品3号", b="大民族")
    assert terms == ["大民族酒·陈任远 精品3号", "陈任远 精品3号", "陈任远精品3号", "大民族 陈任远 精品3号", "精品3号",
                     "大民族酒·陈仁远 精品3号", "陈仁远 精品3号", "陈仁远精品3号", "大民族 陈仁远 精品3号"]
    assert value(spark, extract.search_terms(F.col("a"), F.col("b")), a=None, b=None) == []


def test_reference_values(spark):
    assert value(spark, text.header_key(F.col("a")), a=" 产品；名称|（必填）*·1、2_\n") == "产品名称必填*12"
    assert [value(spark, text.clean_cell(F.col("a")), a=x) for x in ("未标注", "———", "/", "null", "3.0")] == [None, None, "/", "null", "3"]
    assert value(spark, text.plain_key(F.col("a")), a=" A·b（C） d_e") == "abcde"
    assert value(spark, text.spaced_words(F.col("a")), a="甲·乙（丙）-丁") == "甲 乙 丙 -丁"


@pytest.mark.parametrize(("a", "b"), [("tide", "diet"), ("diet", "tide"), ("abc", "abc"), ("abc", "xabcx"), ("", "a")])
def test_similarity(spark, a, b):
    got = value(spark, similarity(F.col("a"), F.col("b")), a=a, b=b)
    expected = 0.0 if not a or not b else 1.0 if a == b else 0.88 if a in b or b in a else SequenceMatcher(None, a, b).ratio()
    assert got == pytest.approx(expected)


def test_ocr_noise_lines(spark):
    text = "净含量  500ml\n——\n12\nabc\nabcd\n中\n★\n----\n净含量 500ml\n12345\n酒精度\n"
    got = spark.createDataFrame([(text,), ("",), (None,), ("ab" * 10,)], "t string").select(extract.clean_ocr(F.col("t")).alias("c"), extract.clean_ocr(F.col("t"), 5).alias("s")).collect()
    assert got[0]["c"].split("\n") == ["净含量 500ml", "abcd", "中", "----", "12345", "酒精度"]
    assert [r["c"] for r in got[1:3]] == ["", ""] and got[3]["s"] == "ababa..."
