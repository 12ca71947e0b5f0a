"""Upserts and deletes that rewrite only the buckets they touch and show either the old or the new table."""

from __future__ import annotations

import pytest
from pyspark.sql.types import StructType

from quillstone.operators.durable import new_folder
from quillstone.sources import keyed_table as kt

SCHEMA = "id string, text string, n int"


@pytest.fixture
def table(spark):
    t = kt.create(spark, new_folder(spark, "keyed"), StructType.fromDDL(SCHEMA), buckets=8)
    kt.upsert(t, spark.createDataFrame([(f"d{i}", "old", i) for i in range(100)], SCHEMA))
    return t


def rows(spark, table) -> dict[str, tuple]:
    return {r["id"]: (r["text"], r["n"]) for r in kt.read(spark, table).collect()}


def test_upsert_rewrites_touched_buckets_only(spark, table):
    before = kt.current(spark, table)
    kt.upsert(table, spark.createDataFrame([("d5", "new", 1), ("d5", "newer", 0), ("e1", "added", 2)], SCHEMA))
    after = kt.current(spark, table)
    assert after.number == before.number + 1
    changed = {b for b in after.folders if after.folders[b] != before.folders.get(b)}
    assert 1 <= len(changed) <= 2 and len(before.folders) == 8
    got = rows(spark, table)
    assert len(got) == 101 and got["d5"] == ("newer", 0) and got["e1"] == ("added", 2) and got["d6"] == ("old", 6)


def test_delete_verifies(spark, table):
    status = kt.delete(table, spark.createDataFrame([("d1",), ("d2",), ("d2",), ("zz",), (None,)], "id string"))
    assert {r["id"]: r["status"] for r in status.collect()} == {"d1": "deleted", "d2": "deleted", "zz": "already_missing"}
    assert set(rows(spark, table)) == {f"d{i}" for i in range(100)} - {"d1", "d2"}
    # Whole buckets may go too.
    kt.delete(table, spark.createDataFrame([(f"d{i}",) for i in range(100)], "id string"))
    assert rows(spark, table) == {}


def test_a_write_that_dies_between_its_phases_leaves_the_old_table_whole(spark, table, monkeypatch):
    want = rows(spark, table)

    def die(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(kt, "put_version", die)
        for write in (lambda: kt.upsert(table, spark.createDataFrame([("d5", "new", 1)], SCHEMA)), lambda: kt.delete(table, spark.createDataFrame([("d5",)], "id string"))):
            with pytest.raises(OSError, match="lost"):
                write()
    assert rows(spark, table) == want
    assert kt.vacuum(spark, table) > 0
    assert rows(spark, table) == want


def test_two_writers_do_not_overwrite_each_other(spark, table, monkeypatch):
    stale = kt.current(spark, table)
    kt.upsert(table, spark.createDataFrame([("d1", "first", 1)], SCHEMA))
    with monkeypatch.context() as m:
        m.setattr(kt, "current", lambda *_: stale)
        with pytest.raises(kt.Conflict):
            kt.upsert(table, spark.createDataFrame([("d1", "second", 1)], SCHEMA))
    assert rows(spark, table)["d1"] == ("first", 1)


def test_reads_of_an_old_version_and_empty_writes(spark, table):
    old = kt.read(spark, table)
    number = kt.upsert(table, spark.createDataFrame([], SCHEMA))
    assert number == kt.current(spark, table).number
    kt.upsert(table, spark.createDataFrame([("d1", "new", 1)], SCHEMA))
    assert old.where("text = 'new'").count() == 0 and kt.read(spark, table).where("text = 'new'").count() == 1
    with pytest.raises(ValueError, match="without an id"):
        kt.upsert(table, spark.createDataFrame([(None, "x", 1)], SCHEMA))
    with pytest.raises(FileNotFoundError):
        kt.read(spark, kt.KeyedTable(new_folder(spark, "none"), "id", 8))
