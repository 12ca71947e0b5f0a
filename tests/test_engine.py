"""The engine over stored indexes, and answers by a confirmed model."""

from __future__ import annotations

import dataclasses

import pytest

from quillstone.api import RUN_MESSAGES, StagedIngest
from quillstone.operators import keyword_index, vector_index
from quillstone.operators.durable import new_folder
from quillstone.operators.providers import HashProvider, Refused

from .test_sources import engine


def test_routes_from_indexes_find_the_same(spark):
    plain = engine(spark)
    vectors = vector_index.build_index(plain.text_docs, new_folder(spark, "vectors"), "doc_id", "embedding")
    words = keyword_index.build_keyword_index(plain.text_docs, new_folder(spark, "words"), "doc_id", "source_text")
    indexed = dataclasses.replace(plain, text_vectors=vectors, text_words=words)
    for query in ("word4 shared", "名称 酒2号"):
        assert sorted(map(str, indexed.hits(query).collect())) == sorted(map(str, plain.hits(query).collect()))


class Writer(HashProvider):
    def __init__(self, says: str | Exception) -> None:
        super().__init__()
        self.says, self.asked = says, []

    def answer(self, query: str, context: str) -> str:
        self.asked.append((query, context))
        if isinstance(self.says, Exception):
            raise self.says
        return self.says


def test_a_model_answers_if_the_caller_confirms(spark):
    plain = engine(spark)
    offline = plain.answer("word4").first()["answer"]
    e = dataclasses.replace(plain, answer_model=Writer(" By the model. "))
    assert e.answer("word4").first()["answer"] == offline and not e.answer_model.asked
    with pytest.raises(PermissionError):
        e.answer("word4", token="yes")
    assert e.answer("word4", token="YES_ANSWER").first()["answer"] == "By the model."
    query, context = e.answer_model.asked[0]
    assert query == "word4" and context.startswith("[产品 1]") and context.count("[产品 ") == 3
    for says in (Refused("no"), RuntimeError("lost"), "  "):
        assert dataclasses.replace(plain, answer_model=Writer(says)).answer("word4", token="YES_ANSWER").first()["answer"] == offline


def test_staged_runs(spark, tmp_path):
    columns = "kind string, raw string, title string, source_id string"
    good = spark.createDataFrame([("text", " plain ", "t", "s1"), ("csv", 'a,b\n"x, y",2', "t", "s2"), ("json", '[{"k": 1}, {"k": 2}]', "t", "s3")], columns)
    bad = spark.createDataFrame([("text", " ", "t", "s4"), ("json", "{", "t", "s5"), ("pdf", "x", "t", "s6"), ("csv", "only,header", "t", "s7"), ("text", None, "t", "s8")], columns)
    stage = StagedIngest(spark)
    assert {r["document_id"]: r["text"] for r in stage.parse(good).collect()} == {
        "s1__doc_0001": "plain", "s2__doc_0001": "a：x, y\nb：2", "s3__doc_0001": '{"k": 1}'.replace(" ", ""), "s3__doc_0002": '{"k":2}'}
    assert {r["source_id"]: r["problem"] for r in stage.problems(good.union(bad)).collect()} == {"s4": "empty", "s5": "malformed", "s6": "unsupported", "s7": "empty", "s8": "empty"}
    first = stage.run(str(tmp_path), "b1", good.union(bad), "index", "2024-01-01").first()
    assert (first["status"], first["message"], first["documents"], first["problems"], first["chunks"]) == ("success", RUN_MESSAGES["done"], 4, 5, 4)
    assert stage.run(str(tmp_path), "b2", good, "index", "2024-01-03", "run").first()["message"] == RUN_MESSAGES["mode"]
    assert stage.run(str(tmp_path), "b3", bad.where("kind = 'text'"), "index", "2024-01-02").first()["message"] == RUN_MESSAGES["preflight"]
    assert [r["batch_id"] for r in stage.runs(str(tmp_path), 2).collect()] == ["b2", "b3"]
    assert spark.read.json(f"{tmp_path}/b1/chunks").count() == 4
