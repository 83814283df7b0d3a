"""Forecast intervals that were tried (T13): every city's series is forecast
from many origins, and the intervals are held against what came.

Fitting each origin anew would read a series once per origin. Both stages of
the fit (``forecast``) are least squares on the differenced value w and its
lags, and the innovations of stage 1 are linear in them too, so one matrix per
origin decides everything: the sums of products of (w, w1 .. w28) over the days
before it. Days are cut into segments at the origins; one aggregate gives the
sums of every segment, and a running sum over the segments those of every
origin. The sums of stage 2 then follow for each candidate by multiplication
with the coefficients of stage 1, on a 29 x 29 matrix, whatever the length of
the series. The last origin gives exactly the fit of ``model_backtest``.

Origins are ``step`` days apart, the last one ``horizon`` days before the end,
none with fewer than ``min_train`` days before it; shorter series yield no
rows. ``series``: city, pos (0, 1, ..), date, value, regular and without gaps.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlake.operators import forecast as FC
from airlake.reference import CANDIDATE_ORDERS
from airlake.session import cut_lineage, ship_package


def _numbered(series: DataFrame, horizon: int, min_train: int) -> DataFrame:
    """Adds ``_cut``, the position of the last origin (origin 0)."""
    n = F.count(F.lit(1)).over(Window.partitionBy("city"))
    return series.withColumn("_cut", (n - horizon).cast("int")).where(F.col("_cut") >= min_train)


def _each_origin(rows: DataFrame, step: int, min_train: int, before: int, after: int) -> DataFrame:
    """One row per origin (``origin``: 0 is the last) that lies at most
    ``before`` days after the day and less than ``after`` days at or before it.
    Counted from positions; no join."""
    ahead = F.col("_cut") - F.col("pos")
    first = F.greatest(F.ceil((ahead - before) / step), F.lit(0))
    last = F.least(F.floor((ahead + after - 1) / step), F.floor((F.col("_cut") - min_train) / step))
    # sequence() counts down where last < first
    return rows.withColumn("origin", F.explode(F.when(first <= last, F.sequence(first.cast("int"), last.cast("int")))))


def origin_sums(series: DataFrame, horizon: int, step: int, min_train: int, orders=CANDIDATE_ORDERS) -> DataFrame:
    """(city, origin, cfg, head) -> n, sums: the upper triangle, row by row, of
    the sums of products of (w, w1, ..) over the days before the origin.
    ``head`` marks the days that only stage 1 uses (lags they lack are 0)."""
    cands = FC.candidate_set(orders)
    t_min, width = _shape(cands)
    feats = FC.features(series.select("city", "pos", "date", "value"), cands, width - 1)
    cut = series.groupBy("city").agg(F.max("_cut").alias("_cut"))
    feats = feats.join(cut, "city").where((F.col("pos") >= F.col("dlen") + FC.LONG_AR) & (F.col("pos") < F.col("_cut")))
    segment = F.least(F.floor((F.col("_cut") - F.col("pos") - 1) / step), F.floor((F.col("_cut") - min_train) / step))
    x = [F.col("w"), *[F.coalesce(f"w{lag}", F.lit(0.0)) for lag in range(1, width)]]
    sums = feats.groupBy("city", "cfg", (F.col("pos") < t_min).alias("head"), segment.cast("int").alias("origin")).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(x[i] * x[j]) for i, j in FC._tri(width)]).alias("sums"))
    sums = cut_lineage(sums)  # one row per segment, read three times
    # head days lie before every origin; other segments count for all origins behind them
    until = Window.partitionBy("city", "cfg", "head", "place").orderBy(F.desc("origin"))
    run = sums.where("not head").select("city", "cfg", "head", "origin", "n", F.posexplode("sums").alias("place", "v"))
    run = run.select("city", "cfg", "head", "origin", "place", F.sum("n").over(until).alias("n"), F.sum("v").over(until).alias("v"))
    run = run.groupBy("city", "cfg", "head", "origin").agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "v")))["v"].alias("sums"))
    heads = sums.where("head").drop("origin").join(run.select("city", "cfg", "origin"), ["city", "cfg"])
    return run.unionByName(heads)


def _shape(cands: list[FC.Candidate]) -> tuple[int, int]:
    """First position that all candidates can use, and the number of lags of
    both stages together, w itself included."""
    max_ma = max((max(c.ma) for c in cands if c.ma), default=0)
    return max(len(c.diff) - 1 for c in cands) + FC.LONG_AR + max_ma, 1 + FC.LONG_AR + max_ma


def _systems(c: FC.Candidate, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Normal equations of stage 2: the columns of ``t`` write w, its lags and
    the lagged innovations as sums of (w, w1, ..)."""
    t = np.zeros((len(z), 1 + len(c.ar) + len(c.ma)))
    t[0, 0] = 1.0
    for k, lag in enumerate(c.ar):
        t[lag, 1 + k] = 1.0
    for k, lag in enumerate(c.ma):
        t[lag, 1 + len(c.ar) + k] = 1.0
        t[lag + 1:lag + 1 + len(a), 1 + len(c.ar) + k] = -a
    m = t.T @ z @ t
    return m[1:, 1:], m[1:, 0], float(m[0, 0])


def _trier(cands: list[FC.Candidate], width: int, horizon: int, z95: float):
    ids, by_id = FC.cfg_ids(cands), {c.cid: c for c in cands}
    slots = max(len(c.ar) + len(c.ma) for c in cands)
    solve, walk = FC._stage2_solver(by_id, slots), FC._forecast_runner(by_id, horizon, z95)

    def tail(c: FC.Candidate, a: np.ndarray, days) -> list[dict]:
        x = np.array([d["value"] for d in sorted(days, key=lambda d: d["pos"])])
        w = np.convolve(x, c.diff)[len(c.diff) - 1:len(x)]
        e = np.array([w[i] - a @ w[i - len(a):i][::-1] for i in range(len(a), len(w))])
        x, w = x[-len(e):], w[-len(e):]
        return [{"pos": i, "value": x[i], "w": w[i], "e": e[i]} for i in range(len(e))]

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            rows, first = [], {}
            for i, r in enumerate(pdf.itertuples(index=False)):
                mats = {(p["cfg"], p["head"]): (p["n"], FC._unpack(p["sums"], width)) for p in r.parts}
                for cfg in set(ids.values()):
                    n, z = mats[cfg, False]
                    both = z + (mats[cfg, True][1] if (cfg, True) in mats else 0.0)
                    first[i, cfg] = a = FC._solve(both[1:FC.LONG_AR + 1, 1:FC.LONG_AR + 1], both[1:FC.LONG_AR + 1, 0])
                    for c in (c for c in cands if ids[c.cfg] == cfg):
                        xx, xy, yy = _systems(c, a, z)
                        pad = np.zeros((slots, slots))
                        pad[:len(xy), :len(xy)] = xx
                        rows.append((i, c.cid, [pad[j, k] for j, k in FC._tri(slots)], xy, yy, n))
            fits = next(solve([pd.DataFrame(rows, columns=["city", "cand_id", "xx", "xy", "yy", "n"])]))
            best = fits[fits["ok"]].sort_values(["aic", "cand_id"]).groupby("city", as_index=False).first()
            if best.empty:
                continue
            best["tail"] = [tail(by_id[k], first[i, ids[by_id[k].cfg]], pdf["days"].iloc[i])
                            for i, k in zip(best["city"], best["cand_id"])]
            out = next(walk([best])).merge(best[["city", "cand_id"]], on="city")
            at = out["city"].to_numpy()
            yield pd.DataFrame({"city": pdf["city"].to_numpy()[at], "origin": pdf["origin"].to_numpy()[at],
                                "cand_id": out["cand_id"], "step": out["step"], "forecast": out["forecast"],
                                "lower": out["lower"], "upper": out["upper"]})
    return run


def interval_trials(series: DataFrame, horizon: int = 30, step: int = 240, min_train: int = 730,
                    orders: Sequence = CANDIDATE_ORDERS, z: float = FC.Z95) -> DataFrame:
    """One row per city, origin (0 is the last) and day ahead: the chosen
    candidate, forecast, interval and what was observed. Only small matrices
    and the days just before each origin reach the solves in Python."""
    cands = FC.candidate_set(orders)
    t_min, width = _shape(cands)
    span = width + max(len(c.diff) for c in cands) + max(max(c.ar or [0]) for c in cands)
    if min_train <= t_min + span:
        raise ValueError(f"min_train must be over {t_min + span} days")
    ship_package(series.sparkSession)
    s = cut_lineage(_numbered(series.select("city", "pos", "date", "value"), horizon, min_train))  # read four times
    sums = origin_sums(s, horizon, step, min_train, orders).groupBy("city", "origin").agg(
        F.collect_list(F.struct("cfg", "head", "n", "sums")).alias("parts"))
    days = _each_origin(s, step, min_train, span, 0).groupBy("city", "origin").agg(
        F.collect_list(F.struct("pos", "value")).alias("days"))
    tried = sums.join(days, ["city", "origin"]).mapInPandas(
        _trier(cands, width, horizon, z),
        "city string, origin int, cand_id int, step int, forecast double, lower double, upper double")
    came = _each_origin(s, step, min_train, 0, horizon).select(
        "city", "origin", (F.col("pos") - F.col("_cut") + F.col("origin") * step + 1).cast("int").alias("step"),
        "date", F.col("value").alias("actual"))
    return tried.join(came, ["city", "origin", "step"])


def interval_coverage(trials: DataFrame, level: float = 0.95, keys: Sequence[str] = ("city",)) -> DataFrame:
    """Per key: share of days inside the interval, its mean width, and the
    factor on its width that would have held the share ``level`` (exact
    quantile of the errors in half widths; trials are bounded by the calendar)."""
    half = (F.col("upper") - F.col("lower")) / 2
    miss = F.abs(F.col("actual") - F.col("forecast"))
    return trials.groupBy(*keys).agg(
        F.count_distinct("origin").alias("n_origins"), F.count(F.lit(1)).alias("n_forecasts"),
        (F.avg(F.col("actual").between(F.col("lower"), F.col("upper")).cast("double")) * 100.0).alias("pct_covered"),
        F.avg(half * 2).alias("mean_width"), F.avg(miss).alias("mae"),
        F.percentile(F.try_divide(miss, half), level).alias("width_factor"))


def widen(forecast: DataFrame, coverage: DataFrame) -> DataFrame:
    """The forecast with intervals as wide as the trials ask for; cities
    without trials keep theirs (``width_factor`` is NULL)."""
    f = forecast.join(coverage.select("city", "width_factor"), "city", "left")
    by = F.coalesce("width_factor", F.lit(1.0))
    return (f.withColumn("lower", F.col("forecast") - (F.col("forecast") - F.col("lower")) * by)
            .withColumn("upper", F.col("forecast") + (F.col("upper") - F.col("forecast")) * by))
