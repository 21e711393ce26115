"""Holds a query's rows against its oracle's in DuckDB."""

from __future__ import annotations

import glob
import os
from decimal import Decimal

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
        return round(float(value), 9) + 0.0
    return value


def rows(columns: list[str], found: list[tuple]) -> list[str]:
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(repr([plain(r[k]) for k in order]) for r in found)


def assert_same(df, sql: str, sf_dir: str) -> None:
    got = connect(sf_dir).execute(sql)
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, got.fetchall())
