"""Rows of a query and of its SQL twin, made comparable."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def in_order(rows, columns):
    order = sorted(columns)
    rows = [tuple(plain(r[columns.index(c)]) for c in order) for r in rows]
    return order, sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def duck(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def same(df, con, sql: str) -> None:
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    want = in_order(found.fetchall(), columns)
    got = in_order([tuple(r) for r in df.collect()], df.columns)
    assert got[0] == want[0]
    assert got[1] == want[1]
