"""Runs a query in Spark and its SQL in DuckDB and compares them value by value."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, bool):
        return str(v)
    return repr(int(v)) if isinstance(v, int) else str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda t: tuple((x is None, x or "") for x in t))


def difference(spark, con, query, sql: str, folder: str) -> str | None:
    """None when both agree exactly, otherwise what differs first."""
    df = query(spark, folder)
    left = _rows(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    right = _rows(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns: {sorted(set(df.columns) ^ set(names))}"
    if len(left) != len(right):
        return f"rows: {len(left)} in Spark, {len(right)} in SQL"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        a, b = bad[0]
        where = [(n, x, y) for n, x, y in zip(sorted(names), a, b) if x != y]
        return f"{len(bad)} of {len(left)} rows, first {where[:6]}"
    return None
