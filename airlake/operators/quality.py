"""Data quality: P1 region filter, A20 null rates, A21 profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY_COLUMNS: tuple[str, ...] = ("pm25", "pm10", "no2", "nox", "nh3", "co", "so2", "o3", "aqi")


def filter_cities(df: DataFrame, cities: Sequence[str], strict: bool = True,
                  known: DataFrame | None = None) -> DataFrame:
    """Keep the listed cities. With ``strict``, fail when none is present in
    ``known``, a small table with a ``city`` column (a region dimension, a
    station registry). Without it ``df`` itself is probed for one row, which is
    cheap on a plain scan but runs the whole plan of an aggregated frame."""
    wanted = F.col("city").isin(list(cities))
    if strict and (df if known is None else known).where(wanted).select("city").isEmpty():
        raise ValueError(f"None of the cities {list(cities)} are present in the data.")
    return df.where(wanted)


def require_city(df: DataFrame, city: str) -> DataFrame:
    """Rows of one city; fails listing the available cities when absent
    (the listing is a distinct over the city column: one row per city)."""
    out = df.where(F.col("city") == city)
    if not out.select("city").limit(1).collect():
        have = sorted(r.city for r in df.select("city").distinct().collect())
        raise ValueError(f"No rows for city {city!r}. Available: {have}")
    return out


def null_rates(df: DataFrame, columns: Sequence[str] = KEY_COLUMNS, by_city: bool = True,
               order: bool = False) -> DataFrame:
    """Missing count and share per column (one pass, then unpivot); with
    ``order``, worst first (ties by column name).
    ``pct_missing`` is rounded to one place, ``pct_missing_exact`` is not."""
    keys = ["city"] if by_city else []
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"),
                              *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = g.unpivot(keys + ["_n"], list(columns), "column", "n_missing")
    exact = F.when(F.col("_n") > 0, F.col("n_missing") * 100.0 / F.col("_n")).otherwise(F.lit(0.0))
    out = long.select(*keys, "column", "n_missing",
                      F.round(exact, 1).alias("pct_missing"), exact.alias("pct_missing_exact"))
    return out.orderBy(*keys, F.desc("pct_missing_exact"), "column") if order else out


def dataset_profile(df: DataFrame, value_col: str = "aqi") -> DataFrame:
    """Per city: rows, date span, and how many rows carry ``value_col``."""
    return df.groupBy("city").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"),
        F.max("date").alias("last_date"), F.count(value_col).alias("n_with_value"),
        (F.count(value_col) * 100.0 / F.count(F.lit(1))).alias("pct_with_value"))
