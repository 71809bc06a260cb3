"""Compare a query with its SQL twin."""

from __future__ import annotations

import datetime
import decimal
import os
from collections import Counter

import duckdb


def connect(d: str):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(d):
        p = f"{d}/{f}"
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def norm(x):
    if isinstance(x, float):
        return round(x, 6) if x == x else "nan"
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return tuple(map(norm, x)) if isinstance(x, (list, tuple)) else x


def differences(con, sql: str, df) -> tuple[Counter, Counter]:
    r = con.execute(sql)
    names, rows = [c[0] for c in r.description], r.fetchall()
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    a = Counter(tuple(map(norm, x)) for x in df.collect())
    b = Counter(tuple(norm(x[i]) for i in at) for x in rows)
    return a - b, b - a
