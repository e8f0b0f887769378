"""Rows of a registered query against those of its DuckDB SQL."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, float) and math.isnan(x):
        return "nan"
    return float(x) if x.__class__.__name__ == "Decimal" else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, query, sql: str, sf: str) -> str:
    """Empty if both sides agree, else what differs."""
    df = query(spark, sf)
    a = rows(df.columns, df.collect())
    found = con.execute(sql)
    b = rows([d[0] for d in found.description], found.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows"
    off = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x != y]
    return f"{len(off)} of {len(a[1])} rows, as {off[0]}" if off else ""
