"""The push source: batches, growing pauses, refusals, the breaker, commit and abort."""

from __future__ import annotations

import json
import os

import pyarrow as pa
import pytest

from quillstone.sources import push

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def batches(n: int) -> list[pa.RecordBatch]:
    return [pa.RecordBatch.from_pylist([{"id": f"d{i}", "n": i} for i in range(n)])]


def test_batches_and_pauses():
    sent, waits, fails = [], [], iter([True, True, False] + [False] * 9)

    def client(rows):
        if next(fails):
            raise RuntimeError("429 too many requests")
        sent.append([r["n"] for r in rows])

    out = push.push_rows(iter(batches(45)), client, "id", batch_rows=20, pause=0.5, wait=waits.append)
    assert sent == [list(range(20)), list(range(20, 40)), list(range(40, 45))]
    assert waits == [0.5, 1.0] and (out.pushed, out.failed, out.tries) == (45, 0, 5)


def test_failed_batches_are_told_and_refused_ones_not_repeated():
    def client(rows):
        raise RuntimeError("timeout" if rows[0]["n"] == 0 else "401 Unauthorized")

    waits = []
    out = push.push_rows(iter(batches(40)), client, "id", wait=waits.append)
    assert (out.pushed, out.failed, out.tries) == (0, 40, 4) and len(waits) == 2
    assert out.told[0] == ("d0", "timeout") and out.told[-1] == ("d39", "401 Unauthorized")


def test_breaker_opens_after_three_refusals_in_a_row():
    seen = []

    def client(rows):
        seen.append(rows[0]["n"])
        if len(seen) != 3:
            raise RuntimeError("access denied")

    with pytest.raises(push.BreakerOpen):
        push.push_rows(iter(batches(400)), client, "id", batch_rows=10)
    assert len(seen) == 6  # two, one that went through, then three in a row


@pytest.fixture
def source(spark, monkeypatch):
    monkeypatch.setenv("PYTHONPATH", HERE)
    push.register(spark)
    return spark.range(100).selectExpr("concat('d', id) AS id", "CAST(id AS INT) AS n").repartition(3)


def write(df, folder, client, **options):
    df.write.format("quillstone_push").mode("append").options(client=f"tests.push_clients:{client}", done="tests.push_clients:told", folder=str(folder), pause="0", batch="7", **options).save()


def pushed(folder) -> list[str]:
    return sorted(r["id"] for p in folder.iterdir() if p.name[0] != "_" for r in json.loads(p.read_text()))


def test_write_and_commit(source, tmp_path):
    write(source, tmp_path, "working")
    assert pushed(tmp_path) == sorted(f"d{i}" for i in range(100))
    assert json.loads((tmp_path / "_committed").read_text())[:2] == [100, 0]


def test_failed_rows_and_strict_writes(source, tmp_path):
    write(source, tmp_path, "choosy")
    total = json.loads((tmp_path / "_committed").read_text())
    assert total[0] + total[1] == 100 and total[0] == len(pushed(tmp_path)) and total[1] >= 10
    with pytest.raises(Exception, match="weren't pushed"):
        write(source, tmp_path, "choosy", strict="true")


def test_abort_when_the_service_refuses(source, tmp_path):
    with pytest.raises(Exception, match="in a row were refused"):
        write(source, tmp_path, "forbidding")
    assert (tmp_path / "_aborted").exists() and not (tmp_path / "_committed").exists()
