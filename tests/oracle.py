"""Compare a DataFrame with DuckDB's answer, as sets of rows."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def shown(v: object) -> str:
        if v is None or v != v:
            return "∅"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted("|".join(shown(r[i]) for i in order) for r in rows)


def check(spark, con, sf: str, query, sql: str) -> None:
    df = query(spark, sf)
    answer = con.execute(sql)
    names = [c[0] for c in answer.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(names, answer.fetchall())
