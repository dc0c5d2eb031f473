"""Comparison of a query's rows with those of its SQL, on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def _cell(x) -> str:
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    if isinstance(x, float):
        return f"{x:.6g}"
    return str(x)


def rows(names: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(_cell(r[i]) for i in order) for r in data)


def difference(got, con, sql: str) -> str:
    """Empty if the DataFrame ``got`` and the SQL have the same columns and rows."""
    rel = con.sql(sql)
    if sorted(got.columns) != sorted(rel.columns):
        return f"columns {sorted(got.columns)} and {sorted(rel.columns)}"
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(rel.columns, rel.fetchall())
    if a == b:
        return ""
    only_a, only_b = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
    return f"{len(a)} and {len(b)} rows; only in Spark {only_a}; only in SQL {only_b}"
