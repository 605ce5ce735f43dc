"""Compares a query's rows with DuckDB's for its SQL."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at if os.path.isfile(at) else at + '/*.parquet'}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if type(v).__name__ == "Decimal":
        return float(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v


def differences(df, sql: str, connection) -> tuple[list, list]:
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    order = sorted(names)
    want = Counter(repr([plain(dict(zip(names, r))[n]) for n in order]) for r in cursor.fetchall())
    got = Counter(repr([plain(r[n]) for n in order]) for r in df.collect())
    return list((got - want).elements()), list((want - got).elements())
