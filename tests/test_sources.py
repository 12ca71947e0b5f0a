"""Readers, sinks, streaming and the engine on small files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillstone.api import Engine, StagedIngest, confirm
from quillstone.operators import manifest
from quillstone.operators.providers import HashProvider, embed_documents
from quillstone.sources import readers, sinks
from quillstone.streaming import ingest


def write(path, text: str) -> str:
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json_readers(spark, tmp_path):
    listed = write(tmp_path / "a.json", json.dumps([{"a": "x", "n": 1}, {"a": "y", "n": 2}]))
    assert readers.json_list(spark, listed, "a string, n int").count() == 2
    lines = write(tmp_path / "b.jsonl", '{"a": "x"}\n\n{"a": "y"}\n')
    assert [r["a"] for r in readers.json_lines(spark, lines, "a string").collect()] == ["x", "y"]
    bad = write(tmp_path / "c.jsonl", '{"a": "x"}\nnot json\n[1]\n')
    assert sorted(r["text"] for r in readers.bad_lines(spark, bad).collect()) == ["[1]", "not json"]
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        readers.json_lines(spark, bad, "a string").collect()


def test_csv_bom_and_missing(spark, tmp_path):
    path = write(tmp_path / "m.csv", "﻿product_id,notes\np1,\np2,x\n")
    got = readers.csv(spark, path)
    assert got.columns == ["product_id", "notes"]
    assert [(r["product_id"], r["notes"]) for r in got.collect()] == [("p1", ""), ("p2", "x")]
    assert readers.optional(readers.csv, spark, str(tmp_path / "none.csv"), "a string").count() == 0


def test_files_maps_and_manifests(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("a.pdf", "~$b.pdf", "c.txt", "D.PDF"):
        write(tmp_path / "d" / name, name)
    assert sorted(r["name"] for r in readers.files(spark, str(tmp_path / "d"), ["pdf"]).collect()) == ["D.PDF", "a.pdf"]
    assert all(len(r["source_sha1"]) == 40 for r in readers.hashed_files(spark, str(tmp_path / "d"), ["pdf"]).collect())
    urls = write(tmp_path / "u.json", json.dumps({"./a\\b.png": "http://x", "k": {"image_path": "c.png", "image_url": "http://y"}}))
    assert {(r["path"], r["url"]) for r in readers.url_map(spark, urls).collect()} == {("a/b.png", "http://x"), ("c.png", "http://y")}
    old = write(tmp_path / "o.json", json.dumps([{"relative_path": "b", "s": "1"}, {"relative_path": "b", "s": "2"}]))
    assert [r["s"] for r in readers.legacy_manifest(spark, old, "relative_path string, s string").collect()] == ["2"]
    payload = write(tmp_path / "p.json", json.dumps({"rows": [{"id": "1"}, {"id": "2"}]}))
    assert readers.payload_rows(spark, payload, "rows", "id string").count() == 2


def test_workbook_cells_to_records(spark):
    rows = [("f", "s", 1, 1, "品名"), ("f", "s", 1, 2, "规格"), ("f", "s", 1, 3, "备注"), ("f", "s", 2, 1, "甲"), ("f", "s", 2, 2, "500ml"), ("f", "s", 2, 3, "z"), ("f", "s", 3, 2, "no name")]
    cells = spark.createDataFrame(rows, "path string, sheet string, row int, column int, value string")
    got = readers.sheet_records(cells, {"品名": "product_name", "规格": "spec"}).collect()
    assert [(r["row"], r["fields"], r["extra"]) for r in got] == [(2, {"product_name": "甲", "spec": "500ml"}, {"备注": "z"})]


def test_preview_router(spark):
    rows = spark.createDataFrame([("text", " a "), ("json", '[{"a": 1}, {"b": 2}]'), ("csv", "h1,h2\nx,y\n,z\n"), ("text", " ")], "kind string, raw string")
    got = [[d["text"] for d in r["d"]] for r in rows.select(readers.preview(F.col("kind"), F.col("raw"), F.lit("t"), F.lit("s")).alias("d")).collect()]
    assert got[0] == ["a"] and len(got[1]) == 2 and got[2] == ["h1：x\nh2：y", "h2：z"] and got[3] == []


def test_preview_of_quoted_cells(spark):
    raw = 'name,"note, long"\r\n"Tea ""A""", plain \r\n"two\nlines",\r\n\r\nlast,"x"'
    got = spark.createDataFrame([(raw,)], "raw string").select(readers.csv_records(F.col("raw")).alias("r"), readers.preview(F.lit("csv"), F.col("raw"), F.lit("t"), F.lit("s")).alias("d")).first()
    assert got["r"] == [["name", "note, long"], ['Tea "A"', " plain "], ["two\nlines", ""], ["last", "x"]]
    assert [d["text"] for d in got["d"]] == ['name：Tea "A"\nnote, long：plain', "name：two\nlines", "name：last\nnote, long：x"]


def test_header_rows_by_their_points(spark):
    def found(*rows: list[str]) -> int | None:
        cells = [("f", "s", i, j, v) for i, row in enumerate(rows, 1) for j, v in enumerate(row, 1)]
        got = readers.header_rows(spark.createDataFrame(cells, "path string, sheet string, row int, column int, value string"), {"品名": "product_name", "规格": "spec", "价格": "price"}).collect()
        return got[0]["header_row"] if got else None

    assert found(["基础资料", "x"], ["品名", "规格"], ["品名", "规格", "价格"]) == 3
    assert found(["品名", "规格"], ["品名", "规格"]) == 1  # the first of equals
    assert found(["品名", "a", "b"]) is None  # one mapped cell
    assert found(["品名", "规格", "品名", "规格"], ["品名", "规格", "故事"]) == 2  # two texts in four cells: 2 + 32 - 20 against 3 + 16 + 2
    assert found(["品名"] * 6) is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", ["a", "b"])], "id string, tags array<string>")
    sinks.csv(df, str(tmp_path / "csv"))
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "csv").glob("part-*")))
    assert text.startswith("﻿id") and '["a","b"]'.replace('"', '""') in text
    sinks.append_manifest(spark.createDataFrame([(" d ", "x")], "source_doc_id string, other string"), str(tmp_path / "log"))
    row = spark.read.json(str(tmp_path / "log")).first()
    assert row["source_doc_id"] == "d" and row["status"] == "planned" and row["product_id"] == "unknown"
    with pytest.raises(ValueError):
        sinks.artifact(df, str(tmp_path), "..", "x")
    assert "| id |" in sinks.report("t", df, ["id"])


def test_upsert_and_delete(spark):
    for t in ("tst_docs", "tst_docs__next", "tst_docs__status"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    sinks.upsert_table(spark, spark.createDataFrame([("1", "a"), ("2", "b")], "id string, v string"), "tst_docs")
    sinks.upsert_table(spark, spark.createDataFrame([("2", "B"), ("3", "c")], "id string, v string"), "tst_docs")
    assert {(r["id"], r["v"]) for r in spark.table("tst_docs").collect()} == {("1", "a"), ("2", "B"), ("3", "c")}
    got = sinks.delete_and_verify(spark, spark.createDataFrame([("1",), ("9",)], "id string"), "tst_docs")
    assert {(r["id"], r["status"]) for r in got.collect()} == {("1", "deleted"), ("9", "already_missing")}
    assert spark.table("tst_docs").count() == 2
    for t in ("tst_docs", "tst_docs__status"):
        spark.sql(f"DROP TABLE {t}")


def test_streams(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS tst_store")
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], "doc_id long, text string").withColumn("ts", F.timestamp_seconds(F.col("doc_id")))
    docs.write.parquet(str(tmp_path / "in"))
    stream = ingest.once_per_content(ingest.read_log(spark, str(tmp_path / "in"), docs.schema))
    ingest.embed_new(stream, "tst_store", "m", f"file:{tmp_path}/cp1").awaitTermination()
    spark.createDataFrame([(2, "B"), (3, "c")], "doc_id long, text string").withColumn("ts", F.timestamp_seconds(F.col("doc_id"))).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.embed_new(ingest.once_per_content(ingest.read_log(spark, str(tmp_path / "in"), docs.schema)), "tst_store", "m", f"file:{tmp_path}/cp1").awaitTermination()
    got = sorted((r["doc_id"], r["embedding_plan_status"]) for r in spark.table("tst_store").collect())
    assert got == [(1, "new"), (2, "changed"), (2, "new"), (3, "new")]
    spark.sql("DROP TABLE tst_store")


def test_stream_windows(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "ev"))
    schema = spark.read.parquet(str(tmp_path / "ev")).schema
    ingest.run_to_table(ingest.windowed_counts(ingest.read_log(spark, str(tmp_path / "ev"), schema)), "tst_windows", f"file:{tmp_path}/cp2", "complete").awaitTermination()
    assert spark.table("tst_windows").agg(F.sum("n")).first()[0] == spark.read.parquet(str(tmp_path / "ev")).count()


def engine(spark) -> Engine:
    rows = [(f"d{i}", f"p{i % 3}", "product_full", "basic_info", "", f"名称：酒{i % 3}号。 word{i} shared text") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id string, product_id string, doc_type string, field_name string, status string, source_text string")
    vectors = embed_documents(docs, HashProvider(), "doc_id", "source_text").select("doc_id", "embedding")
    images = spark.createDataFrame([("i1", "p1", "a.png", "", "word1 picture")], "image_id string, product_id string, image_path string, image_url string, source_text string")
    pictures = embed_documents(images, HashProvider(space="image"), "image_id", "source_text").select("image_id", "embedding")
    return Engine(spark, docs.join(vectors, "doc_id"), images.join(pictures, "image_id"))


def test_engine(spark):
    e = engine(spark)
    assert e.health()["ok"] and not e.search_by_image()["ok"]
    found = e.search("word4", 3).orderBy("product_rank").collect()
    assert [r["product_rank"] for r in found] == list(range(1, len(found) + 1))
    assert "p1" in {r["product_id"] for r in found}
    assert "酒" in e.answer("word4").first()["answer"]
    assert e.rerank("word4", fallback=True).count() == 3
    assert e.bundles(e.retrieve("word4")).where("section = 'basic_info'").count() == 3
    for bad in (0, 31):
        with pytest.raises(ValueError):
            e.search("x", bad)
    with pytest.raises(PermissionError):
        confirm("push", "yes")


def test_staged_ingest(spark):
    docs = spark.createDataFrame([("a", "s", " ".join(map(str, range(600)))[:2000]), ("b", "s", "short")], "document_id string, source_id string, text string")
    stage = StagedIngest(spark)
    assert stage.preflight(docs, "index").first()["status"] == "pass"
    assert stage.preflight(docs, "", "run").first()["status"] == "blocked"
    assert stage.preflight(docs.limit(0), "index").first()["status"] == "blocked"
    assert stage.chunks(docs).where("document_id = 'a'").count() == 3


def test_manifest_normalisation_types(spark):
    rows = spark.createDataFrame([("d", "7x", [" a ", "", None])], "source_doc_id string, warning_count string, pushed_doc_ids array<string>")
    got = manifest.normalize(rows).first()
    assert got["warning_count"] == 0 and got["pushed_doc_ids"] == ["a"] and got["vector_tables"] == []
