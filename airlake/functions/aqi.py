"""Index expressions: sub-index, AQI, responsible pollutant, bucket.

Each helper returns a native Column built from one SQL expression (CASE /
greatest / coalesce), so it stays inside whole-stage codegen and costs a
single call to build. Arguments are column names or SQL expressions. NULL
means missing; NaN must be turned into NULL at ingest
(``airlake.schema.nan_to_null``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from airlake.reference import (
    AQI_BUCKETS,
    AQI_TOP_BUCKET,
    BREAKPOINTS,
    MIN_SUB_INDICES,
    col_of,
)


def _d(x: float) -> str:
    return f"{float(x)!r}D"


def q(name: str) -> str:
    """Quote a column name for use inside an expression string."""
    return name if name.startswith("(") else f"`{name}`"


def sub_index_sql(conc: str, pollutant: str,
                  breakpoints: Mapping[str, Sequence[tuple]] = BREAKPOINTS) -> str:
    """First band whose upper edge is >= the value applies (edges belong to the
    lower band); above the table the last band's line continues; below zero the
    first band's line. Missing stays missing."""
    x = q(conc)
    bands = breakpoints[pollutant]

    def line(b):
        lo, hi, ilo, ihi = b
        return f"{_d(ilo)} + {_d(ihi - ilo)} * ({x} - {_d(lo)}) / {_d(hi - lo)}"

    whens = " ".join(f"WHEN {x} <= {_d(b[1])} THEN {line(b)}" for b in bands)
    return f"(CASE {whens} ELSE {line(bands[-1])} END)"


def sub_index(conc: str, pollutant: str) -> Column:
    return F.expr(sub_index_sql(conc, pollutant))


def si_name(label: str) -> str:
    return f"si_{col_of(label)}"


def n_available_sql(exprs: Sequence[str]) -> str:
    return " + ".join(f"CAST({q(e)} IS NOT NULL AS INT)" for e in exprs) or "0"


def n_available(exprs: Sequence[str]) -> Column:
    return F.expr(n_available_sql(exprs))


def largest_sql(exprs: Sequence[str]) -> str:
    """Largest of any number of expressions (none: missing); ``greatest``
    itself needs two."""
    names = [q(e) for e in exprs]
    return f"greatest({', '.join(names)})" if len(names) > 1 else (names or ["CAST(NULL AS DOUBLE)"])[0]


def largest(exprs: Sequence[str]) -> Column:
    return F.expr(largest_sql(exprs))


def aqi_of(exprs: Sequence[str], min_count: int = MIN_SUB_INDICES) -> Column:
    """Maximum available sub-index, missing unless ``min_count`` are present."""
    return F.expr(f"(CASE WHEN {n_available_sql(exprs)} >= {min_count} THEN {largest_sql(exprs)} END)")


def responsible_of(labels: Sequence[str], max_col: str) -> Column:
    """Label of the first sub-index (in ``labels`` order) equal to the max."""
    whens = " ".join(f"WHEN {q(si_name(lab))} = {q(max_col)} THEN '{lab}'" for lab in labels)
    return F.expr(f"(CASE {whens} END)" if whens else "CAST(NULL AS STRING)")


def aqi_bucket_sql(aqi: str) -> str:
    a = q(aqi)
    whens = " ".join(f"WHEN {a} <= {_d(e)} THEN '{n}'" for e, n in AQI_BUCKETS)
    return f"(CASE WHEN {a} IS NULL THEN NULL {whens} ELSE '{AQI_TOP_BUCKET}' END)"


def aqi_bucket(aqi: str) -> Column:
    return F.expr(aqi_bucket_sql(aqi))


def aqi_from_concentrations(labels: Sequence[str], source: Mapping[str, str] | None = None,
                            min_count: int = MIN_SUB_INDICES) -> Column:
    """AQI straight from concentration columns: the largest sub-index, missing
    unless ``min_count`` are present. A sub-index is missing exactly when its
    concentration is, so the concentrations are counted and each sub-index is
    evaluated once."""
    cols = [(source or {}).get(lab, col_of(lab)) for lab in labels]
    sis = [sub_index_sql(c, lab) for c, lab in zip(cols, labels)]
    return F.expr(f"(CASE WHEN {n_available_sql(cols)} >= {min_count} THEN {largest_sql(sis)} END)")
