"""Health exceedance: P14, A18, A19, A28."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlake.operators.common import observed
from airlake.reference import (
    INDIA_PM25_24H, INDIA_PM25_ANNUAL, PM25_PER_CIGARETTE, WHO_PM25_24H, WHO_PM25_ANNUAL,
)


def cigarettes_per_day(pm25: Column) -> Column:
    return pm25 / F.lit(PM25_PER_CIGARETTE)


def _share(cond: Column) -> Column:
    return F.avg(cond.cast("double")) * 100.0


def health_exceedance(df: DataFrame, col: str = "pm25",
                      cities: Sequence[str] | None = None) -> DataFrame:
    """Per city and year: mean, days and % over the WHO and national 24h
    limits, clean days, cigarette equivalent."""
    v = F.col("value")
    over_who, over_in = v > F.lit(WHO_PM25_24H), v > F.lit(INDIA_PM25_24H)
    g = observed(df, col, cities).groupBy("city", F.year("date").alias("year")).agg(
        F.count(v).alias("n_days"), F.avg(v).alias("mean_pm25"),
        F.count_if(over_who).alias("days_over_who"), F.count_if(over_in).alias("days_over_india"),
        F.count_if(v <= F.lit(WHO_PM25_24H)).alias("clean_days"),
        _share(over_who).alias("pct_over_who"), _share(over_in).alias("pct_over_india"))
    return g.withColumn("avg_cigarettes_day", cigarettes_per_day(F.col("mean_pm25")))


def health_summary(df: DataFrame, col: str = "pm25",
                   cities: Sequence[str] | None = None) -> DataFrame:
    v = F.col("value")
    g = observed(df, col, cities).groupBy("city").agg(
        F.count(v).alias("n_days"), F.avg(v).alias("mean_pm25"),
        _share(v > F.lit(WHO_PM25_24H)).alias("pct_over_who"),
        _share(v > F.lit(INDIA_PM25_24H)).alias("pct_over_india"),
        _share(v <= F.lit(WHO_PM25_24H)).alias("pct_clean"))
    m = F.col("mean_pm25")
    return g.select("city", "n_days", "mean_pm25", "pct_over_who", "pct_over_india", "pct_clean",
                    (m / F.lit(WHO_PM25_ANNUAL)).alias("x_who_annual"),
                    (m / F.lit(INDIA_PM25_ANNUAL)).alias("x_india_annual"),
                    cigarettes_per_day(m).alias("avg_cigarettes_day"),
                    (cigarettes_per_day(m) * 365).alias("cigarettes_year"))


def health_day_classes(exceedance: DataFrame) -> DataFrame:
    """Per city-year day categories: clean, over WHO only, over the national limit."""
    return exceedance.select(
        "city", "year", "clean_days",
        (F.col("days_over_who") - F.col("days_over_india")).alias("over_who_only"),
        "days_over_india")
