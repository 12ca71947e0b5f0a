"""The texts for reranking and answering, and the offline answer, put together row by row."""

from __future__ import annotations

import re

from quillstone.operators import answer
from quillstone.plans import retrieval

LABELS = (("产品ID", 120), ("召回来源", 120), ("核心文本", 700), ("文本命中", 420), ("文本命中", 420), ("文本命中", 420))


def flat(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


def short(s: str, n: int) -> str:
    return s if len(s) <= n else s[:n - 3] + "..."


def lines(parts: list[tuple[str, str, int]]) -> str:
    """label：text of each text that isn't blank and didn't occur before, case aside."""
    out, seen = [], set()
    for label, text, n in parts:
        text = flat(text)
        if text and text.lower() not in seen:
            out.append(f"{label}：{short(text, n)}")
        seen.add(text.lower())
    return "\n".join(out)


def ranked(spark, sf) -> list[dict]:
    hits = sorted(retrieval.hits(spark, sf).collect(), key=lambda h: (h["route"] != "dense", h["rank"]))
    products: dict[str, dict] = {}
    for at, h in enumerate(hits):
        p = products.setdefault(h["product_id"], {"id": h["product_id"], "score": 0.0, "routes": set(), "seen": at, "texts": []})
        p["score"] += 1 / (60 + h["rank"])
        p["routes"].add(h["route"])
        if h["source_text"]:
            p["texts"].append(h["source_text"])
    return sorted(products.values(), key=lambda p: (-round(p["score"], 12), p["seen"], p["id"]))[:5]


def wanted(spark, sf) -> list[tuple]:
    out = []
    for n, p in enumerate(ranked(spark, sf), 1):
        routes = sorted(p["routes"])
        best = short(p["texts"][0].replace("\n", " ").strip(), 600) if p["texts"] else ""
        texts = [p["id"], "、".join(routes), best, *[*p["texts"][:3], "", "", ""][:3]]
        rerank = lines([(label, text, limit) for (label, limit), text in zip(LABELS, texts, strict=True)])
        name = short(best, 60)
        head = "\n".join([f"[产品 {n}]", f"product_id：{p['id']}", f"产品名称：{name}", f"routes：{', '.join(routes)}", f"rerank_score：{p['score']:.6f}", lines([("核心资料", best, 520)])])
        out.append((n, p["id"], name, *(short(x.replace("\n", " "), most) for x, most in ((rerank, 1800), (head, 1200)))))
    return out


def test_answer_context(spark, sf):
    want = wanted(spark, sf)
    got = [tuple(r) for r in retrieval.answer_context(spark, sf).orderBy("product_rank").collect()]
    assert got == want and len(want) == 5


def test_extractive_answer(spark, sf):
    rows = spark.createDataFrame([(2, "b", "Second  thing\nmore"), (1, "a", "产品名称：First\n" + "x" * 300), (3, "c", "")], "product_rank int, product_id string, best_text string")
    got = answer.extractive_answer(rows).first()["answer"].split("\n")
    assert got[0].startswith("根据当前资料") and got[1] == "1. First：" + ("产品名称：First " + "x" * 300)[:117] + "..."
    assert got[2:] == ["2. Second  thing：Second thing more", "3. c："]
    assert answer.extractive_answer(rows.limit(0)).first()["answer"] == answer.NOTHING_FOUND
    assert retrieval.extractive_answer(spark, sf).first()["answer"].count("\n") == 5
