"""Runs a registered query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str):
    """(columns equal, rows here, rows there, rows only here, rows only there)"""
    rel = con.sql(sql)
    theirs = _rows(rel.columns, rel.fetchall())
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    a, b = {}, {}
    for r in ours:
        a[r] = a.get(r, 0) + 1
    for r in theirs:
        b[r] = b.get(r, 0) + 1
    only_a = [r for r in a if a[r] != b.get(r, 0)]
    only_b = [r for r in b if b[r] != a.get(r, 0)]
    return sorted(df.columns) == sorted(rel.columns), len(ours), len(theirs), only_a, only_b
