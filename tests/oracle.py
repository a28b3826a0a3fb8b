"""Run a query and its SQL on the same tables and compare whole results."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, int):
        return value
    return str(value) if not isinstance(value, (list, tuple)) else tuple(_plain(v) for v in value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str | None:
    """None where both agree, else a short account of the difference."""
    ours = df.collect()
    answer = con.execute(sql)
    columns = [d[0] for d in answer.description]
    theirs = answer.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    if len(ours) != len(theirs):
        note = f"{len(ours)} rows against {len(theirs)}; "
    else:
        note = ""
    a, b = rows_of(df.columns, ours), rows_of(columns, theirs)
    if a == b:
        return None
    left, right = set(map(repr, a)), set(map(repr, b))
    missing, extra = sorted(right - left)[:3], sorted(left - right)[:3]
    return f"{note}only in SQL ({len(right - left)}): {[m[:400] for m in missing]}; only in Spark ({len(left - right)}): {[e[:400] for e in extra]}"
