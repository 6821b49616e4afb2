"""Compares a Spark result with the result of its SQL twin in DuckDB."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _rows(names: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(str(r[i]) for i in order) for r in rows)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else a description of the difference."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    expected = _rows(names, cursor.fetchall())
    actual = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if expected == actual:
        return None
    extra, lacking = actual - expected, expected - actual
    return (f"{sum(actual.values())} rows against {sum(expected.values())}; only in Spark {sum(extra.values())}: "
            f"{list(extra)[:3]}; only in SQL {sum(lacking.values())}: {list(lacking)[:3]}")
