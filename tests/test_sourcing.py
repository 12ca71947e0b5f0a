"""Source ladders, gates and the remaining text readers on small rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillstone.functions import extract
from quillstone.operators import answer, profile, search, sourcing
from quillstone.operators.providers import HashProvider
from quillstone.sources import readers, sinks


def test_write_gate():
    sourcing.write_gate("a", "a", 3, {3})
    for args in (("a", "b", 3, {3}), ("a", "a", None, {3}), ("a", "a", 3, {3, 4}), ("a", "a", 3, set())):
        with pytest.raises(PermissionError):
            sourcing.write_gate(*args)


def test_source_ladder(spark):
    rows = [("s", "", "d", "x", "p", "f"), ("", "a" * 40, "d", "quality_report", "p", ""), ("", "", "supp__p__quality_report__0123456789ab__c001", "x", "p", ""), ("", "", "d", "product_field", "p", ""), ("", "", "d", "x", "", "")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string")
    got = [r[0] for r in df.select(sourcing.text_source_id(*(F.col(c) for c in "abcdef"))).collect()]
    assert got == ["s", "pdf__" + "a" * 40, "pdf__0123456789ab", "product__p__field", ""]
    assert [r[0] for r in spark.createDataFrame([("x_1",), ("y",), ("",)], "v string").select(sourcing.source_matches("x", F.col("v"))).collect()] == [True, False, False]
    assert [r[0] for r in spark.createDataFrame([("0",), ("3",), ("z",)], "v string").select(sourcing.chunk_number(F.col("v"))).collect()] == [1, 3, 1]


@pytest.mark.parametrize(("given", "expected"), [('x {"a": {"b": "}"}} y {"c": 1}', '{"a": {"b": "}"}}'), ("no object", None), ("{broken", None), ("{a: {b}} tail", "{a: {b}}"), (None, None)])
def test_balanced_json(spark, given, expected):
    assert spark.createDataFrame([(given,)], "t string").select(extract.balanced_json("t")).first()[0] == expected


def test_ocr(spark):
    df = spark.createDataFrame([("净含量：500ml 规格：6瓶/箱，酒精度 52%vol", "500ml装"), ("短\n第一行\n第二行\n第三行\n第四行", "")], "o string, s string")
    got = [r[0] for r in df.select(extract.ocr_clues(F.col("o"), {"净含量": F.col("s")})).collect()]
    assert got == [["酒精度：52%vol", "规格：6瓶/箱"], []]
    assert [r[0] for r in df.select(extract.ocr_summary(F.col("o"), {})).collect()][1] == "第一行；第二行；第三行"
    tags = spark.createDataFrame([(["红色", "送礼", "商务宴请"],)], "t array<string>")
    assert tags.select(extract.gift_tags(F.col("t"))).first()[0] == ["送礼", "商务宴请"]
    assert tags.select(extract.image_section("T", F.lit("cap"), F.col("t"), F.lit(""), 2, ("a", "b", "c"))).first()[0] == "T\na：ca...\nb：红色、送礼、商务宴请"


def test_ocr_pages_only_for_poor_files(spark):
    pages = spark.createDataFrame([("good", 1, "中" * 250), ("bad", 1, "x"), ("bad", 2, None)], "path string, page int, text string")
    got = {(r["path"], r["page"]): r["text"] for r in readers.ocr_pages(pages, lambda p, n: f"ocr {p} {n}").collect()}
    assert got == {("good", 1): "中" * 250, ("bad", 1): "ocr bad 1", ("bad", 2): "ocr bad 2"}


def test_needs_mapping_and_images(spark):
    cells = spark.createDataFrame([("f", "s", r, c, f"{r}.{c}") for r in range(1, 9) for c in (1, 2)], "path string, sheet string, row int, column int, value string")
    row = readers.needs_mapping(cells).first()
    assert row["row_count"] == 8 and len(row["preview"]) == 5 and row["source_doc_id"].startswith("product_excel__")
    images = spark.createDataFrame([("f", "s", 2, 1, b"\x89PNG\r\n\x1a\n"), ("f", "s", 9, 1, b"?")], "path string, sheet string, row int, column int, image binary")
    products = spark.createDataFrame([("f", "s", "2", "p1")], "source_file string, source_sheet string, source_row string, product_id string")
    got = {r["row"]: (r["status"], r["media_type"]) for r in readers.bound_images(images, products).collect()}
    assert got == {2: ("matched", "image/png"), 9: ("unmatched", "application/octet-stream")}


def test_urls_and_lookups(spark):
    got = sinks.object_urls(spark.createDataFrame([("./素材/a b.png",)], "path string"), "http://h/", "k/").first()
    assert got["url"] == "http://h/k/%E7%B4%A0%E6%9D%90/a%20b.png"
    records = spark.createDataFrame([("p1", "l", "f", 1), ("p2", "l", "f", 2)], "product_id string, locator string, fingerprint string, seq int")
    maps = profile.lookups(records)
    assert maps["by_locator"].first()["product_id"] == "p2" and maps["by_fingerprint"].first()["product_ids"] == ["p1", "p2"]


@pytest.mark.parametrize(("n", "letters"), [(1, "A"), (26, "Z"), (27, "AA"), (52, "AZ"), (53, "BA"), (702, "ZZ"), (703, "AAA"), (16384, "XFD")])
def test_column_letters(spark, n, letters):
    assert spark.range(1).select(profile.column_letters(F.lit(n))).first()[0] == letters


def test_structured_products_and_scores(spark):
    ranked = spark.createDataFrame([(1, "p", "名称：甲酒。 text", 0.5), (2, "q", "line", 0.4)], "product_rank int, product_id string, best_text string, score double")
    told = spark.createDataFrame([("p", "told", "because"), ("zz", "made up", "x")], "product_id string, product_name string, reason string")
    got = {r["product_id"]: (r["product_name"], r["reason"]) for r in answer.structured_products(ranked, told).collect()}
    assert got == {"p": ("told", "because"), "q": ("line", "line")}
    scored = answer.rerank_scores(ranked.withColumnRenamed("best_text", "rerank_text"), "line", HashProvider()).collect()
    assert {r["product_id"]: r["rerank_score"] for r in scored} == {"p": 0.0, "q": 1.0}


def test_probes_and_flattening(spark):
    rows = spark.createDataFrame([("d1", "p1", "", "alpha beta"), ("d2", "p2", "b9", "gamma"), ("d3", "p3", "", "alpha delta")], "doc_id string, product_id string, barcode string, source_text string")
    wanted = spark.createDataFrame([("k", "p1", "b9", "alpha")], "key string, product_id string, barcode string, words string")
    assert {(r["doc_id"], r["way"]) for r in search.probes(rows, wanted).collect()} == {("d1", 1), ("d2", 2), ("d3", 3)}
    nested = spark.createDataFrame([("outer", {"id": "1", "name": "inner"}, 0.0, 0.7)], "name string, fields struct<id string, name string>, __score__ double, _score double")
    flat = search.flatten_result(nested).first()
    assert flat["name"] == "inner" and flat["score"] == 0.7


def test_roots_and_first_plan(spark):
    plan = spark.createDataFrame([("quality_report_pdf", "质检报告/a/b.pdf", "x", 2), ("product_excel", "素材/c.xlsx", "y", 1)], "source_type string, source_path string, source_sha1 string, line int")
    assert {r["root"] for r in sourcing.source_roots(plan).collect()} == {"质检报告/a", "素材/c.xlsx"}
    assert sourcing.first_plan_sha1(plan, plan).first()["source_sha1"] == "y"
    rolled = plan.withColumns({"suggested_action": F.lit("new"), "impact_types": F.array(F.lit("t")), "vector_tables": F.array(F.lit("v"))})
    assert {(r["what"], r["value"]): r["n"] for r in sourcing.plan_rollup(rolled).collect()}[("impact_types", "t")] == 2
