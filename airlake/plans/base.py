"""Shared pieces for query plans: output rounding that both engines compute
bit for bit the same way.

``round(x, 6)`` differs between engines on exact decimal ties (Spark rounds
the decimal expansion half-up; DuckDB works on the binary value). Outputs are
therefore rounded as ``floor(x * 1e6 + 0.5) / 1e6``: the same three IEEE
operations in Spark and in the oracle SQL. They are taken to nine places the
same way first: a parallel sum is not reproducible to the last bit, and a mean
that ends on a tie of the sixth place must not fall on either side of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 1_000_000.0
FINE = 1_000_000_000.0


def r6(c: Column) -> Column:
    c = F.floor(c * F.lit(FINE) + F.lit(0.5)) / F.lit(FINE)
    return F.floor(c * F.lit(SCALE) + F.lit(0.5)) / F.lit(SCALE)


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column to 6 places (see module note)."""
    return df.select([
        r6(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def sql_round6(sql: str) -> str:
    """Rewrite every ``round(<expr>, 6)`` of an oracle query into the same
    floor form (balanced-parenthesis scan)."""
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k, comma = 1, j + len(key), -1
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner, digits = sql[j + len(key):comma], sql[comma + 1:k - 1].strip()
        out.append(sql[i:j])
        if digits == "6":
            fine = (f"(floor(({sql_round6(inner)}) * CAST({FINE!r} AS DOUBLE) + CAST(0.5 AS DOUBLE))"
                    f" / CAST({FINE!r} AS DOUBLE))")
            out.append(f"(floor({fine} * CAST({SCALE!r} AS DOUBLE) + CAST(0.5 AS DOUBLE))"
                       f" / CAST({SCALE!r} AS DOUBLE))")
        else:
            out.append(f"round({sql_round6(inner)}, {digits})")
        i = k


def sql_count_if(sql: str) -> str:
    """Rewrite ``count_if(<cond>)`` as ``count(CASE WHEN <cond> THEN 1 END)``:
    DuckDB types count_if as HUGEINT, count as BIGINT (Spark's type). Works
    unchanged before an OVER clause."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j])
        out.append(f"count(CASE WHEN ({sql_count_if(sql[j + len(key):k - 1])}) THEN 1 END)")
        i = k
