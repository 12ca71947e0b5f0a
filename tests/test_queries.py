"""Every registered query of the library against its SQL; those without SQL run and keep their schema."""

from __future__ import annotations

from pathlib import Path

import pytest

from quillstone.catalogue import QUERIES, SQL

from .oracle import check, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, con, name):
    check(spark, con, sf, QUERIES[name], SQL[name])


#: Queries that SQL can't express, and the tests that hold them to another account of their rows.
WITHOUT_SQL = {
    "answer_context": "test_answer_texts.py", "extractive_answer": "test_answer_texts.py", "identity_map_blocks": "test_name_join.py", "overlap_classify_blocks": "test_name_join.py",
    "vector_index_probe": "test_vector_index.py",
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows_and_a_test(spark, sf, name):
    assert name in (Path(__file__).parent / WITHOUT_SQL[name]).read_text()
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
