"""Long-run trend and seasonal cycle: A1-A3, W2, A24, A25.

The city-day table has one row per (city, day), so every group here is
bounded by the calendar (days or months per city), not by raw data volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlake.functions.calendar import month_name
from airlake.operators.common import observed
from airlake.operators.quantiles import quantile, sketch


def monthly_trend(df: DataFrame, col: str = "aqi", cities: Sequence[str] | None = None,
                  sketch_k: int | None = None) -> DataFrame:
    """(city, month start) -> mean, median, n_days; months without data omitted.
    For frames with many rows per day (raw readings) ``sketch_k`` takes the
    median from a sketch of bounded size (``quantiles``); exact by default."""
    v = F.col("value")
    median = F.median(v) if sketch_k is None else quantile(sketch(v, sketch_k), F.count(v), 0.5)
    return (observed(df, col, cities).groupBy("city", F.trunc("date", "MM").alias("month"))
            .agg(F.avg("value").alias("mean"), median.alias("median"),
                 F.count("value").alias("n_days")))


def monthly_rolling(monthly: DataFrame, rows: int = 12, min_rows: int = 6, frame: str = "rows") -> DataFrame:
    """Trailing mean over the last ``rows`` monthly rows (row-based: missing
    months widen the window), NULL unless ``min_rows`` are present. With
    ``frame="months"`` over the last ``rows`` calendar months instead: missing
    months leave fewer values."""
    by_city = Window.partitionBy("city")
    if frame == "rows":
        w = by_city.orderBy("month").rowsBetween(-(rows - 1), 0)
    elif frame == "months":
        w = by_city.orderBy(F.year("month") * 12 + F.month("month")).rangeBetween(-(rows - 1), 0)
    else:
        raise ValueError(f"frame must be 'rows' or 'months', not {frame!r}")
    return monthly.select(
        "city", "month", "mean",
        F.when(F.count("mean").over(w) >= min_rows, F.avg("mean").over(w)).alias("rolling_mean"))


def yearly_trend(df: DataFrame, col: str = "aqi", cities: Sequence[str] | None = None) -> DataFrame:
    return (observed(df, col, cities).groupBy("city", F.year("date").alias("year"))
            .agg(F.avg("value").alias("mean"), F.median("value").alias("median"),
                 F.count("value").alias("n_days")))


def monthly_climatology(df: DataFrame, col: str = "pm25",
                        cities: Sequence[str] | None = None) -> DataFrame:
    """Mean per calendar month over all years: month_num, month, mean, n_days."""
    out = (observed(df, col, cities).groupBy("city", F.month("date").alias("month_num"))
           .agg(F.avg("value").alias("mean"), F.count("value").alias("n_days")))
    return out.select("city", "month_num", month_name("month_num").alias("month"), "mean", "n_days")


def trend_headline(yearly: DataFrame, full_year_days: int = 350) -> DataFrame:
    """First and last full year (n_days >= threshold), change, worst year.
    Cities with fewer than two full years are omitted."""
    full = F.col("n_days") >= full_year_days
    yr = F.col("year")
    g = yearly.groupBy("city").agg(
        F.count(F.when(full, 1)).alias("n_full_years"),
        F.min(F.when(full, F.struct(yr, F.col("mean")))).alias("first"),
        F.max(F.when(full, F.struct(yr, F.col("mean")))).alias("last"),
        # highest mean, earliest year on ties
        F.max(F.struct(F.col("mean").alias("m"), (-yr).alias("ny"))).alias("worst"),
    )
    delta = F.col("last.mean") - F.col("first.mean")
    return g.where(F.col("n_full_years") >= 2).select(
        "city",
        F.col("first.year").alias("first_year"), F.col("first.mean").alias("first_mean"),
        F.col("last.year").alias("last_year"), F.col("last.mean").alias("last_mean"),
        delta.alias("delta"),
        F.try_divide(F.lit(100.0) * delta, F.col("first.mean")).alias("pct_change"),
        (-F.col("worst.ny")).alias("worst_year"),
    )


def season_headline(clim: DataFrame) -> DataFrame:
    """Peak and trough calendar month (first on ties) and their ratio."""
    g = clim.groupBy("city").agg(
        F.max(F.struct(F.col("mean"), (-F.col("month_num")).alias("nm"), F.col("month"))).alias("peak"),
        F.min(F.struct(F.col("mean"), F.col("month_num"), F.col("month"))).alias("trough"),
    )
    return g.select(
        "city",
        F.col("peak.month").alias("peak_month"), F.col("peak.mean").alias("peak_mean"),
        F.col("trough.month").alias("trough_month"), F.col("trough.mean").alias("trough_mean"),
        F.try_divide(F.col("peak.mean"), F.col("trough.mean")).alias("peak_trough_ratio"),
    )
