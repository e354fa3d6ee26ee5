"""Side-by-side comparison of a registered query with its SQL on DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return repr(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """None when equal, else a short text."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(cols):
        return f"{name}: columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = normal(df.columns, got), normal(cols, want)
    if a == b:
        return None
    only_a, only_b = set(a) - set(b), set(b) - set(a)
    extra, missing = sorted(only_a)[:3], sorted(only_b)[:3]
    return f"{name}: {len(a)} rows, want {len(b)}\n  columns {sorted(cols)}\n  only ours {extra}\n  only SQL {missing}"
