"""Runs queries beside their SQL and compares rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            pattern = f"{path}/*.parquet" if os.path.isdir(path) and glob.glob(f"{path}/*") else path
            con.execute(f"create view {t} as select * from read_parquet('{pattern}')")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if hasattr(x, "asDict"):
        return tuple(_plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(_plain(v) for v in x.values())
    if isinstance(x, list | tuple):
        return tuple(_plain(v) for v in x)
    return x


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def compare(df, con, sql: str) -> str:
    """Empty if equal, else what differs first."""
    mine = rows(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows and {len(theirs)}"
    for a, b in zip(mine, theirs, strict=True):
        if a != b:
            return f"{a} and {b}"
    return ""
