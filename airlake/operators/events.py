"""Event impact against explicit baselines: J4, A8-A11, A26."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlake.operators.common import broadcast_if_small, observed
from airlake.reference import LOCKDOWN_MONTHS, LOCKDOWN_YEAR, STUBBLE_MONTHS


def event_windows(calendar: DataFrame, days_after: int = 2, baseline_days: int = 14) -> DataFrame:
    """Expand an event calendar (year, event_date) into one row per day of the
    treatment window [d, d+days_after] and the baseline [d-baseline_days, d-1].
    The result has (#events x window length) rows, independent of the data, so
    it is broadcast (behind the size check); the join to the data is then an
    equi-join on date."""
    off = F.explode(F.sequence(F.lit(-baseline_days), F.lit(days_after))).alias("offset")
    win = (calendar.select("year", "event_date", off)
           .select("year", "event_date", F.date_add("event_date", F.col("offset")).alias("date"),
                   (F.col("offset") >= 0).alias("in_event")))
    return broadcast_if_small(win)


def festival_effect(df: DataFrame, calendar: DataFrame, col: str = "pm25", days_after: int = 2,
                    baseline_days: int = 14, cities: Sequence[str] | None = None) -> DataFrame:
    """Per city and event year: festival vs preceding-fortnight means, changes
    and day counts. Years lacking either side are skipped."""
    win = event_windows(calendar, days_after, baseline_days)
    j = observed(df, col, cities).join(win, "date")
    ev, v = F.col("in_event"), F.col("value")
    g = j.groupBy("city", "year", "event_date").agg(
        F.avg(F.when(ev, v)).alias("festival_mean"),
        F.avg(F.when(~ev, v)).alias("baseline_mean"),
        F.count(F.when(ev, v)).alias("n_festival"),
        F.count(F.when(~ev, v)).alias("n_baseline"),
    )
    g = g.where((F.col("n_festival") > 0) & (F.col("n_baseline") > 0))
    diff = F.col("festival_mean") - F.col("baseline_mean")
    return g.select("city", "year", "event_date", "festival_mean", "baseline_mean",
                    diff.alias("abs_change"),
                    F.try_divide(F.lit(100.0) * diff, F.col("baseline_mean")).alias("pct_change"),
                    "n_festival", "n_baseline")


def season_effect(df: DataFrame, col: str = "pm25", season_months: Sequence[int] = STUBBLE_MONTHS,
                  cities: Sequence[str] | None = None) -> DataFrame:
    """Per city and year: season months vs the rest of that same year."""
    o = observed(df, col, cities)
    ins = F.month("date").isin(list(season_months))
    v = F.col("value")
    g = o.groupBy("city", F.year("date").alias("year")).agg(
        F.avg(F.when(ins, v)).alias("season_mean"),
        F.avg(F.when(~ins, v)).alias("rest_mean"),
        F.count(F.when(ins, v)).alias("n_season"),
        F.count(F.when(~ins, v)).alias("n_rest"),
    ).where((F.col("n_season") > 0) & (F.col("n_rest") > 0))
    s, r = F.col("season_mean"), F.col("rest_mean")
    return g.select("city", "year", "season_mean", "rest_mean",
                    F.try_divide(s, r).alias("multiplier"),
                    F.try_divide(F.lit(100.0) * (s - r), r).alias("pct_change"),
                    "n_season", "n_rest")


def lockdown_effect(df: DataFrame, col: str = "pm25", months: Sequence[int] = LOCKDOWN_MONTHS,
                    lockdown_year: int = LOCKDOWN_YEAR,
                    cities: Sequence[str] | None = None) -> DataFrame:
    """Per city and year: mean over the lockdown calendar months."""
    o = observed(df, col, cities).where(F.month("date").isin(list(months)))
    g = o.groupBy("city", F.year("date").alias("year")).agg(
        F.avg("value").alias("mean"), F.count("value").alias("n_days"))
    return g.withColumn("is_lockdown", F.col("year") == lockdown_year)


def lockdown_summary(table: DataFrame, baseline_years: Sequence[int] | None = None) -> DataFrame:
    """Lockdown-year mean vs the unweighted mean of the other years' means
    (every other year by default, or ``baseline_years``). Cities lacking
    either side are omitted."""
    lk = F.col("is_lockdown")
    base = ~lk if baseline_years is None else (~lk & F.col("year").isin(list(baseline_years)))
    g = table.groupBy("city").agg(
        F.max(F.when(lk, F.col("mean"))).alias("lockdown_mean"),
        F.avg(F.when(base, F.col("mean"))).alias("baseline_mean"),
        F.count(F.when(base, 1)).alias("n_baseline_years"),
        F.count(F.when(lk, 1)).alias("n_lockdown"),
    ).where((F.col("n_lockdown") > 0) & (F.col("n_baseline_years") > 0))
    diff = F.col("lockdown_mean") - F.col("baseline_mean")
    return g.select("city", "lockdown_mean", "baseline_mean", diff.alias("abs_change"),
                    F.try_divide(F.lit(100.0) * diff, F.col("baseline_mean")).alias("pct_change"),
                    "n_baseline_years")


def event_headline(festival: DataFrame, season: DataFrame) -> DataFrame:
    """Per city: mean festival change, worst festival year (first on ties), and
    the mean season multiplier and change."""
    f = festival.groupBy("city").agg(
        F.count(F.lit(1)).alias("n_festivals"),
        F.avg("pct_change").alias("festival_avg_pct"),
        F.max(F.when(F.col("pct_change").isNotNull(),
                     F.struct(F.col("pct_change"), (-F.col("year")).alias("ny")))).alias("_w"),
    ).select("city", "n_festivals", "festival_avg_pct",
             (-F.col("_w.ny")).alias("festival_worst_year"),
             F.col("_w.pct_change").alias("festival_worst_pct"))
    s = season.groupBy("city").agg(
        F.count(F.lit(1)).alias("n_season_years"),
        F.avg("multiplier").alias("season_avg_multiplier"),
        F.avg("pct_change").alias("season_avg_pct"))
    return f.join(s, "city", "full")
