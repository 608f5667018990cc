"""Compare a registered query with its SQL in DuckDB, value by value."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


def _cell(v):
    if v is None:
        return ("null", "")
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, int):
        return ("int", v)
    if isinstance(v, float):
        return ("float", "nan" if math.isnan(v) else f"{v:.9g}")
    if isinstance(v, str):
        return ("str", v)
    return (type(v).__name__, repr(v))


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = sorted(tuple(_cell(r[i]) for i in order) for r in rows)
    return [columns[i] for i in order], out


def compare(spark, con, fn, sql: str | None, sf_dir: str) -> tuple[int, list[str]]:
    """Row count of the Spark result and a list of differences (empty when equal)."""
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(rows), []
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    cols_s, got = _table(df.columns, rows)
    cols_d, want = _table(names, cur.fetchall())
    problems = []
    if cols_s != cols_d:
        problems.append(f"columns {cols_s} != {cols_d}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        only_s = sorted(set(got) - set(want))[:2]
        only_d = sorted(set(want) - set(got))[:2]
        problems.append(f"spark only {only_s}")
        problems.append(f"duck only {only_d}")
    return len(rows), problems
