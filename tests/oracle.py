"""Compares a query's rows with its DuckDB twin: same columns, same multiset of values."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (int, str, bytes)):
        return v
    return str(v) if not hasattr(v, "__float__") else round(float(v), 6)


def differences(df, con, sql: str, limit: int = 5) -> list:
    names = sorted(df.columns)
    mine = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    cur = con.execute(sql)
    theirs_names = [c[0] for c in cur.description]
    if sorted(theirs_names) != names:
        return [("columns", names, sorted(theirs_names))]
    at = [theirs_names.index(c) for c in names]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    if mine == theirs:
        return []
    return [("spark only", x) for x in list((mine - theirs).elements())[:limit]] + [("sql only", x) for x in list((theirs - mine).elements())[:limit]]
