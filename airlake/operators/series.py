"""Regular series: grids, bounded interpolation, longest run, classical
decomposition, daily series (T1-T5, W3-W6, A22).

All windows here are partitioned by city and ordered by a calendar step
(month or day), so a partition holds one row per step of the city's span:
bounded by the calendar, whatever the raw volume behind each step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlake.functions.calendar import month_name


def fill_grid(obs: DataFrame, keys: Sequence[str], t: str, step: str) -> DataFrame:
    """Dense calendar between each key's first and last observation, in one
    pass: every observation is expanded to the steps up to (not including)
    the next one, the value kept on its own step only. No self-join (which
    would read the input twice), no global bounds job."""
    w = Window.partitionBy(*keys).orderBy(t)
    nxt = F.lead(t).over(w)
    if step == "MONTH":
        last = F.add_months(nxt, -1)
    elif step == "DAY":
        last = F.date_sub(nxt, 1)
    else:
        raise ValueError(step)
    others = [c for c in obs.columns if c not in (*keys, t)]
    x = obs.withColumn("_last", F.coalesce(last, F.col(t)))
    seq = F.sequence(F.col(t), F.col("_last"), F.expr(f"INTERVAL 1 {step}"))
    x = x.select(*keys, t, *others, F.posexplode(seq).alias("_i", "_t"))
    return x.select(*keys, F.col("_t").alias(t),
                    *[F.when(F.col("_i") == 0, F.col(c)).alias(c) for c in others])


def regular(obs: DataFrame, t: str, step: str) -> DataFrame:
    """(city, t, value) observations -> dense grid from the first to the last
    observed step per city (trimmed to valid ends), gaps as NULL, with a
    0-based position ``pos``."""
    g = fill_grid(obs, ["city"], t, step)
    return g.withColumn("pos", F.row_number().over(Window.partitionBy("city").orderBy(t)) - 1)


def interpolate_bounded(g: DataFrame, t: str, limit: int) -> DataFrame:
    """Linear interpolation of inside gaps on grid positions, filling at most
    ``limit`` steps of each gap, counted from its start (so a longer gap is
    partly filled). Adds ``filled`` and ``was_missing``."""
    w = Window.partitionBy("city").orderBy(t)
    known = F.when(F.col("value").isNotNull(), F.struct(F.col("pos").alias("p"), F.col("value").alias("v")))
    g = g.withColumn("_prev", F.last(known, ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    # next known value: a running frame in reverse order (linear, unlike a
    # current-to-unbounded-following frame, which re-aggregates per row)
    back = Window.partitionBy("city").orderBy(F.desc(t)).rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("_next", F.last(known, ignorenulls=True).over(back))
    k = F.col("pos") - F.col("_prev.p")
    interp = ((F.col("_next.v") - F.col("_prev.v")) / (F.col("_next.p") - F.col("_prev.p")) * k
              + F.col("_prev.v"))
    ok = F.col("_prev").isNotNull() & F.col("_next").isNotNull() & (k <= limit)
    return (g.withColumn("was_missing", F.col("value").isNull())
            .withColumn("filled", F.when(F.col("value").isNotNull(), F.col("value")).when(ok, interp))
            .drop("_prev", "_next"))


def longest_run(g: DataFrame, t: str) -> DataFrame:
    """Keep each city's longest run of present ``filled`` values (earliest on
    ties); the whole series when nothing is missing."""
    w = Window.partitionBy("city").orderBy(t)
    valid = F.col("filled").isNotNull()
    chg = F.when(F.lag(valid).over(w).isNull() | (F.lag(valid).over(w) != valid), 1).otherwise(0)
    g = g.withColumn("_chg", chg).withColumn(
        "_run", F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = (g.where(valid).groupBy("city", "_run")
            .agg(F.count(F.lit(1)).alias("_len"), F.min(t).alias("_start")))
    best = (runs.withColumn("_rk", F.row_number().over(
        Window.partitionBy("city").orderBy(F.desc("_len"), F.col("_start"))))
        .where(F.col("_rk") == 1).select("city", "_run"))
    return g.join(best, ["city", "_run"]).drop("_chg", "_run")


def monthly_series(df: DataFrame, col: str, max_gap: int = 2,
                   cities: Sequence[str] | None = None) -> DataFrame:
    """Monthly-mean series for decomposition (T3): monthly grid, bounded
    interpolation (``max_gap``), longest run. Output: city, month, value
    (filled), interpolated, n_interpolated, n_months, pos (0-based in run)."""
    src = df if cities is None else df.where(F.col("city").isin(list(cities)))
    obs = (src.where(F.col(col).isNotNull())
           .groupBy("city", F.trunc("date", "MM").alias("month")).agg(F.avg(col).alias("value")))
    g = longest_run(interpolate_bounded(regular(obs, "month", "MONTH"), "month", max_gap), "month")
    wc = Window.partitionBy("city")
    return g.select(
        "city", "month", F.col("filled").alias("value"), F.col("was_missing").alias("interpolated"),
        F.count_if("was_missing").over(wc).alias("n_interpolated"),
        F.count(F.lit(1)).over(wc).alias("n_months"),
        (F.row_number().over(Window.partitionBy("city").orderBy("month")) - 1).alias("pos"))


def seasonal_decompose(series: DataFrame, period: int = 12, model: str = "additive") -> DataFrame:
    """Classical decomposition of a regular series (city, month, value, pos,
    n_months): centred moving average (2 x period for even periods), phase
    means of the detrended values, centred; cities with fewer than two full
    periods, or for the multiplicative model with values that are not positive,
    are left out (see ``decomposition_status``)."""
    mult = model.startswith("m")
    s = series.where(F.col("n_months") >= 2 * period)
    if mult:
        s = s.withColumn("_low", F.min("value").over(Window.partitionBy("city"))).where("_low > 0")
    w = Window.partitionBy("city").orderBy("month")
    h = period // 2
    frame = w.rowsBetween(-h, h)
    x = F.col("value")
    if period % 2 == 0:
        raw = (F.sum(x).over(frame) - F.lit(0.5) * (F.lag(x, h).over(w) + F.lead(x, h).over(w))) / F.lit(
            float(period))
    else:
        raw = F.sum(x).over(frame) / F.lit(float(period))
    s = s.withColumn("trend", F.when(F.count(x).over(frame) == 2 * h + 1, raw))
    s = s.withColumn("_d", F.try_divide(x, F.col("trend")) if mult else (x - F.col("trend")))
    s = s.withColumn("_phase", F.col("pos") % period)
    ph = s.groupBy("city", "_phase").agg(F.avg("_d").alias("_s"))
    ph = ph.withColumn("_m", F.avg("_s").over(Window.partitionBy("city")))
    ph = ph.select("city", "_phase", (F.try_divide("_s", "_m") if mult
                                      else (F.col("_s") - F.col("_m"))).alias("seasonal"))
    out = s.join(ph, ["city", "_phase"])
    resid = F.try_divide(x, F.col("trend") * F.col("seasonal")) if mult else (x - F.col("trend") - F.col("seasonal"))
    return out.select("city", "month", x.alias("observed"), "trend", "seasonal", resid.alias("resid"))


def decomposition_status(series: DataFrame, period: int = 12, model: str = "additive") -> DataFrame:
    """Per city: months available and whether a decomposition was possible
    (a status row instead of an exception): ok, too_short or, for the
    multiplicative model, not_positive."""
    status = F.when(F.col("n_months") < 2 * period, "too_short")
    if model.startswith("m"):
        status = status.when(F.col("_low") <= 0, "not_positive")
    return (series.groupBy("city").agg(F.max("n_months").alias("n_months"),
                                        F.max("n_interpolated").alias("n_interpolated"),
                                        F.min("value").alias("_low"))
            .withColumn("status", status.otherwise("ok")).drop("_low"))


def seasonal_cycle(decomposed: DataFrame) -> DataFrame:
    """Mean seasonal component per calendar month."""
    g = decomposed.groupBy("city", F.month("month").alias("month_num")).agg(
        F.avg("seasonal").alias("effect"))
    return g.select("city", "month_num", month_name("month_num").alias("month"), "effect")


def daily_series(df: DataFrame, col: str = "aqi", max_gap: int = 7,
                 cities: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Continuous daily series per city (T1, T5): daily grid between the first
    and last valid day, gaps interpolated up to ``max_gap`` days. Returns
    (series, status): cities with days still missing get status
    'gaps_remaining' and no series rows, instead of failing the whole job."""
    src = df if cities is None else df.where(F.col("city").isin(list(cities)))
    obs = src.where(F.col(col).isNotNull()).groupBy("city", "date").agg(F.avg(col).alias("value"))
    g = interpolate_bounded(regular(obs, "date", "DAY"), "date", max_gap)
    wc = Window.partitionBy("city")
    g = (g.withColumn("n_interpolated", F.count_if("was_missing").over(wc))
         .withColumn("n_remaining", F.count_if(F.col("filled").isNull()).over(wc)))
    status = (g.groupBy("city").agg(F.count(F.lit(1)).alias("n_days"),
                                    F.max("n_interpolated").alias("n_interpolated"),
                                    F.max("n_remaining").alias("n_remaining"))
              .withColumn("status", F.when(F.col("n_remaining") == 0, "ok").otherwise("gaps_remaining")))
    series = g.where(F.col("n_remaining") == 0).select(
        "city", "date", F.col("filled").alias("value"), F.col("was_missing").alias("interpolated"),
        "n_interpolated", "pos")
    return series, status
