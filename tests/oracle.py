"""Runs a query and its SQL side by side: same columns, same rows in any order."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str | None:
    """None if they agree, else what differs."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.sql(sql)
    want = rows_of(res.columns, res.fetchall())
    if sorted(df.columns) != sorted(res.columns):
        return f"columns {sorted(df.columns)} against {sorted(res.columns)}"
    if got != want:
        first = next(((g, w) for g, w in zip(got, want) if g != w), None)
        return f"{len(got)} rows against {len(want)}; first difference {first}"[:600]
    return None
