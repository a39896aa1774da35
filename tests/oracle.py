"""Runs a query's SQL in DuckDB over the same tables and compares the rows."""

import os
from pathlib import Path

import duckdb

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
THERE = Path(FOLDER).is_dir()


def rows(table: list[dict]) -> list[tuple]:
    return sorted(tuple(str(r[c]) for c in sorted(r)) for r in table)


def same(spark, query, sql: str) -> None:
    connection = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    told = connection.sql(sql)
    expected = [dict(zip(told.columns, r, strict=True)) for r in told.fetchall()]
    got = query(spark, FOLDER)
    assert set(told.columns) <= set(got.columns)
    assert rows([r.asDict() for r in got.select(*told.columns).collect()]) == rows(expected)
