"""Runs queries and their SQL side by side; a small stand-in for the driver's check."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def tables(d: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{d}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{src}'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.9e}" if float(v) else "0"
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return str(v)


def compare(spark, con, name: str, query, sql: str, d: str) -> str:
    """'' when equal, else what differs."""
    df = query(spark, d)
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} against {sorted(rel.columns)}"
    cols = sorted(df.columns)
    at = [rel.columns.index(c) for c in cols]
    want = Counter(tuple(_norm(r[i]) for i in at) for r in rel.fetchall())
    got = Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    if want == got:
        return ""
    return f"{sum(got.values())} rows against {sum(want.values())}; only in ours {list((got - want).elements())[:3]}, missing {list((want - got).elements())[:3]}"
