"""Calendar parts: season, season order, month name, month start."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airlake.reference import MONTH_NAMES, SEASON_MONTHS, SEASON_ORDER


def _as_sql(c: str) -> str:
    return c if c.startswith("(") else f"`{c}`"


def season_sql(month: str) -> str:
    whens = " ".join(f"WHEN {month} IN ({', '.join(map(str, ms))}) THEN '{n}'"
                     for n, ms in SEASON_MONTHS.items())
    return f"(CASE {whens} END)"


def season_of(month: Column | str) -> Column:
    """Season of a month number (column name or Column)."""
    if isinstance(month, str):
        return F.expr(season_sql(_as_sql(month)))
    return _season_col(month)


def _season_col(m: Column) -> Column:
    expr = None
    for name, months in SEASON_MONTHS.items():
        cond = m.isin(*months)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def season_of_date(date_col: str = "date") -> Column:
    return F.expr(season_sql(f"month({_as_sql(date_col)})"))


def season_rank(season: str = "season") -> Column:
    whens = " ".join(f"WHEN {_as_sql(season)} = '{n}' THEN {i}" for i, n in enumerate(SEASON_ORDER, 1))
    return F.expr(f"(CASE {whens} END)")


def month_name(month: str) -> Column:
    arr = ", ".join(f"'{n}'" for n in MONTH_NAMES)
    return F.expr(f"element_at(array({arr}), CAST({_as_sql(month)} AS INT))")


def month_start(date: Column | str) -> Column:
    return F.trunc(F.col(date) if isinstance(date, str) else date, "MM")
