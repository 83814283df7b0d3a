"""Side-by-side comparison of a Spark result and its DuckDB oracle:
column names, row count and an order-insensitive multiset of values."""

from __future__ import annotations

import datetime as dt
import math
import os

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return norm(v.item())
    return str(v)


def canonical(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> tuple[bool, str]:
    scols, srows = canonical(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    dcols, drows = canonical([c[0] for c in res.description], res.fetchall())
    if scols != dcols:
        return False, f"columns differ: {scols} vs {dcols}"
    if srows != drows:
        a, b = set(srows), set(drows)
        return False, (f"rows differ: spark={len(srows)} duck={len(drows)}; "
                       f"only spark {sorted(a - b)[:2]}; only duck {sorted(b - a)[:2]}")
    return True, f"{len(srows)} rows"
