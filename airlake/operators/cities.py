"""Multi-city comparison: A15-A17, A27."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlake.functions.calendar import season_of_date
from airlake.operators.common import observed
from airlake.operators.quantiles import quantile, sketch


def city_summary(df: DataFrame, cities: Sequence[str] | None = None, col: str = "aqi",
                 bad_threshold: float = 200.0, order: bool = True, sketch_k: int | None = None) -> DataFrame:
    """Per city: n_days, mean, median, p95 (exact, linear), % days above the
    threshold; worst first. No matching city gives an empty frame. With
    ``sketch_k`` median and p95 come from a sketch of bounded size."""
    v = F.col("value")
    at = lambda p: F.percentile(v, p) if sketch_k is None else quantile(sketch(v, sketch_k), F.count(v), p)
    out = observed(df, col, cities).groupBy("city").agg(
        F.count(v).alias("n_days"), F.avg(v).alias("mean"), at(0.5).alias("median"),
        at(0.95).alias("p95"),
        (F.avg((v > F.lit(float(bad_threshold))).cast("double")) * 100.0).alias("pct_bad"))
    return out.orderBy(F.desc("mean"), "city") if order else out


def seasonal_city_means(df: DataFrame, cities: Sequence[str] | None = None,
                        col: str = "pm25") -> DataFrame:
    o = observed(df, col, cities)
    return (o.groupBy("city", season_of_date("date").alias("season"))
            .agg(F.avg("value").alias("mean")))


def seasonality_index(df: DataFrame, cities: Sequence[str] | None = None, col: str = "pm25",
                      order: bool = True) -> DataFrame:
    """Winter mean / monsoon mean per city, in one conditional aggregate (no
    pivot); incomplete cities dropped; most seasonal first."""
    o = observed(df, col, cities).withColumn("season", season_of_date("date"))
    v = F.col("value")
    g = o.groupBy("city").agg(
        F.avg(F.when(F.col("season") == "Winter", v)).alias("winter"),
        F.avg(F.when(F.col("season") == "Monsoon", v)).alias("monsoon"))
    out = (g.withColumn("winter_monsoon_ratio", F.try_divide("winter", "monsoon"))
           .na.drop(subset=["winter", "monsoon", "winter_monsoon_ratio"]))
    return out.orderBy(F.desc("winter_monsoon_ratio"), "city") if order else out


def city_headline(df: DataFrame, focus: str, col: str = "aqi", seasonal_col: str = "pm25",
                  bad_threshold: float = 200.0) -> DataFrame:
    """Focus city against the unweighted mean of the others, its share of bad
    days, its seasonal ratio, and the most seasonal city (first on ties).
    The city-day table is read once: one aggregate per city with conditional
    means, then one over the cities."""
    v, s, season = F.col(col), F.col(seasonal_col), season_of_date("date")
    j = df.groupBy("city").agg(
        F.avg(v).alias("mean"),
        (F.avg((v > F.lit(float(bad_threshold))).cast("double")) * 100.0).alias("pct_bad"),
        F.avg(F.when(season == "Winter", s)).alias("winter"),
        F.avg(F.when(season == "Monsoon", s)).alias("monsoon"))
    is_f, r = F.col("city") == focus, F.try_divide("winter", "monsoon")
    g = j.agg(
        F.max(F.when(is_f, F.col("mean"))).alias("focus_mean"),
        F.avg(F.when(~is_f, F.col("mean"))).alias("others_mean"),
        F.max(F.when(is_f, F.col("pct_bad"))).alias("focus_pct_bad"),
        F.count(F.when(is_f & F.col("mean").isNotNull(), 1)).alias("_present"),
        F.max(F.when(is_f, r)).alias("focus_seasonal_ratio"),
        F.min(F.when(r.isNotNull(), F.struct((-r).alias("nr"), F.col("city")))).alias("_top"),
    )
    return g.where(F.col("_present") > 0).select(
        F.lit(focus).alias("city"), "focus_mean", "others_mean",
        F.try_divide("focus_mean", "others_mean").alias("ratio_to_others"),
        "focus_pct_bad", "focus_seasonal_ratio", F.col("_top.city").alias("most_seasonal_city"),
        (-F.col("_top.nr")).alias("most_seasonal_ratio"))
