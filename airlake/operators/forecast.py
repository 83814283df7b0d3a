"""Forecast backtest.

Naive baselines and metrics are plain DataFrame operations. The seasonal
ARIMA search is re-aimed as Hannan-Rissanen two-stage least squares, so the
heavy part is Spark work for all cities and candidates at once:

* differencing ``(1-B)^d (1-B^m)^D`` and lag features are ``lag`` windows
  partitioned by city (a city's daily series is bounded by the calendar);
* normal-equation sums (Gram matrices) are one ``groupBy`` per stage;
* only the k-by-k solves (k <= 20) and the h-step recursion run in pandas,
  via ``mapInPandas`` over rows that each hold one small matrix or a
  bounded tail of one series.

Stage 1 fits a long autoregression and keeps its residuals as innovation
proxies; stage 2 regresses the differenced value on the AR lags of the value
and the MA lags of those residuals named by the expanded seasonal
polynomials. Coefficients at product lags are free (a linear fit), unlike the
multiplicative likelihood model. AIC = n ln(RSS/n) + 2(k+1) over rows common
to all candidates; one-step errors are on the original scale whatever the
differencing, so candidates compare. Lowest AIC wins, first candidate on
ties; non-finite or non-stationary fits are skipped.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlake.reference import CANDIDATE_ORDERS
from airlake.session import cut_lineage, ship_package

LONG_AR = 20
Z95 = 1.959963984540054


# --------------------------------------------------------------------------- split and naive


def split_train_test(series: DataFrame, horizon: int) -> DataFrame:
    """Adds ``is_test`` (last ``horizon`` steps) and ``n``; cities whose
    series is not longer than ``2 * horizon`` are dropped."""
    n = F.count(F.lit(1)).over(Window.partitionBy("city"))
    s = series.withColumn("n", n).where(F.col("n") > 2 * horizon)
    return s.withColumn("is_test", F.col("pos") >= F.col("n") - horizon)


def naive_forecasts(split: DataFrame, horizon: int, m: int = 7) -> DataFrame:
    """Persistence (last training value held) and seasonal naive (last ``m``
    training values tiled) for each test step: city, model, date, step,
    actual, predicted. Equi-joins on (city) and (city, phase)."""
    cut = F.col("n") - horizon
    test = split.where("is_test").select(
        "city", "date", (F.col("pos") - cut + 1).alias("step"), F.col("value").alias("actual"))
    last = split.where(F.col("pos") == cut - 1).select("city", F.col("value").alias("predicted"))
    tail = split.where((F.col("pos") >= cut - m) & (F.col("pos") < cut)).select(
        "city", (F.col("pos") - (cut - m)).alias("_k"), F.col("value").alias("predicted"))
    pers = test.join(last, "city").withColumn("model", F.lit("persistence"))
    seas = (test.withColumn("_k", (F.col("step") - 1) % m).join(tail, ["city", "_k"])
            .drop("_k").withColumn("model", F.lit("seasonal_naive")))
    cols = ["city", "model", "date", "step", "actual", "predicted"]
    return pers.select(cols).unionByName(seas.select(cols))


def forecast_metrics(pred: DataFrame, keys: Sequence[str] = ("city", "model")) -> DataFrame:
    """MAE, RMSE and MAPE per key. MAPE skips rows with a zero actual and
    reports how many were skipped (instead of an infinite value)."""
    err = F.col("actual") - F.col("predicted")
    return pred.groupBy(*keys).agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.abs(F.try_divide(err, F.col("actual")))) * 100.0).alias("mape"),
        F.count(F.lit(1)).alias("n_test"),
        F.count_if(F.col("actual") == 0).alias("n_mape_skipped"))


# --------------------------------------------------------------------------- candidates


def _diff_poly(d: int, sd: int, m: int) -> list[float]:
    poly = np.array([1.0])
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    for _ in range(sd):
        seas = np.zeros(m + 1)
        seas[0], seas[m] = 1.0, -1.0
        poly = np.convolve(poly, seas)
    return [float(x) for x in poly]


def _lags(p: int, sp: int, m: int) -> list[int]:
    return sorted({i + j * m for i in range(p + 1) for j in range(sp + 1)} - {0})


class Candidate:
    def __init__(self, cid: int, order, seasonal):
        self.cid = cid
        self.p, self.d, self.q = order
        self.sp, self.sd, self.sq, self.m = seasonal
        m = self.m or 1
        self.cfg = (self.d, self.sd, m if self.sd else 0)
        self.diff = _diff_poly(self.d, self.sd, m)
        self.ar = _lags(self.p, self.sp, m)
        self.ma = _lags(self.q, self.sq, m)

    @property
    def label(self) -> str:
        return f"({self.p},{self.d},{self.q})x({self.sp},{self.sd},{self.sq},{self.m})"


def candidate_set(orders=CANDIDATE_ORDERS) -> list[Candidate]:
    return [Candidate(i, o, s) for i, (o, s) in enumerate(orders)]


def candidates_frame(spark: SparkSession, orders=CANDIDATE_ORDERS) -> DataFrame:
    rows = [(c.cid, c.label, c.p, c.d, c.q, c.sp, c.sd, c.sq, c.m) for c in candidate_set(orders)]
    return spark.createDataFrame(rows, "cand_id int, label string, p int, d int, q int, "
                                       "sp int, sd int, sq int, m int")


# --------------------------------------------------------------------------- small solves


def _tri(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _unpack(xx, k: int) -> np.ndarray:
    a = np.zeros((k, k))
    for v, (i, j) in zip(xx, _tri(k)):
        a[i, j] = a[j, i] = v
    return a


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


def _stage1_solver(k: int):
    def run(batches):
        for pdf in batches:
            coef = [(_solve(_unpack(xx, k), np.asarray(xy))).tolist()
                    for xx, xy in zip(pdf["xx"], pdf["xy"])]
            yield pd.DataFrame({"city": pdf["city"], "cfg": pdf["cfg"], "a": coef})
    return run


def _stationary(lags: Sequence[int], coef: Sequence[float]) -> bool:
    if not lags:
        return True
    poly = np.zeros(max(lags) + 1)
    poly[0] = 1.0
    for l, c in zip(lags, coef):
        poly[l] -= c
    roots = np.roots(poly[::-1])
    return bool(np.all(np.abs(roots) > 1.0 + 1e-8))


def _stage2_solver(cands: dict[int, Candidate], slots: int):
    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                c = cands[int(row.cand_id)]
                used = len(c.ar) + len(c.ma)
                a = _unpack(row.xx, slots)[:used, :used]
                b = np.asarray(row.xy)[:used]
                beta = _solve(a, b)
                rss = float(row.yy - 2 * beta @ b + beta @ a @ beta)
                n = int(row.n)
                ok = (n > used + 1 and rss > 0 and math.isfinite(rss)
                      and bool(np.all(np.isfinite(beta))) and _stationary(c.ar, beta[:len(c.ar)]))
                aic = n * math.log(rss / n) + 2 * (used + 1) if ok else float("nan")
                out.append((row.city, int(row.cand_id), beta[:len(c.ar)].tolist(),
                            beta[len(c.ar):].tolist(), rss / n if n else float("nan"), aic, n, ok))
            yield pd.DataFrame(out, columns=["city", "cand_id", "ar_coef", "ma_coef", "sigma2",
                                             "aic", "n_fit", "ok"])
    return run


# --------------------------------------------------------------------------- features


def features(series: DataFrame, cands: list[Candidate], long_ar: int = LONG_AR) -> DataFrame:
    """Per differencing configuration: w (differenced value) and its lags
    1..long_ar, for every (city, pos). Rows are duplicated once per distinct
    configuration (two for the default candidates)."""
    w = Window.partitionBy("city").orderBy("pos")
    parts = []
    for cfg_id, cfg in enumerate(sorted({c.cfg for c in cands})):
        diff = next(c.diff for c in cands if c.cfg == cfg)
        wexpr = sum((F.lit(cf) * F.lag("value", k).over(w) for k, cf in enumerate(diff) if cf and k),
                    F.lit(diff[0]) * F.col("value"))
        f = series.select("city", "pos", "date", "value").withColumn("w", wexpr)
        f = f.select("*", *[F.lag("w", l).over(w).alias(f"w{l}") for l in range(1, long_ar + 1)])
        parts.append(f.withColumn("cfg", F.lit(cfg_id)).withColumn("dlen", F.lit(len(diff) - 1)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cfg_ids(cands: list[Candidate]) -> dict[tuple, int]:
    return {cfg: i for i, cfg in enumerate(sorted({c.cfg for c in cands}))}


def fit_candidates(series: DataFrame, orders=CANDIDATE_ORDERS, long_ar: int = LONG_AR) -> tuple[DataFrame, DataFrame]:
    """Fit every candidate for every city. ``series``: city, pos, date, value
    (regular, gap-free). Returns (fits, residual frame); fits has city,
    cand_id, ar_coef, ma_coef, sigma2, aic, n_fit, ok."""
    spark = series.sparkSession
    ship_package(spark)  # the solves run in Python workers
    cands = candidate_set(orders)
    ids = cfg_ids(cands)
    feats = features(series, cands, long_ar)
    # stage 1: long autoregression per (city, cfg)
    xs = [F.col(f"w{l}") for l in range(1, long_ar + 1)]
    s1 = feats.where(F.col("pos") >= F.col("dlen") + long_ar)
    g1 = s1.groupBy("city", "cfg").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(xs[i] * F.col("w")) for i in range(long_ar)]).alias("xy"),
        F.array(*[F.sum(xs[i] * xs[j]) for i, j in _tri(long_ar)]).alias("xx"))
    a = g1.mapInPandas(_stage1_solver(long_ar), "city string, cfg int, a array<double>")
    # stage-1 residuals as innovation proxies, and their lags
    fit1 = sum((F.element_at("a", l) * xs[l - 1] for l in range(2, long_ar + 1)),
               F.element_at("a", 1) * xs[0])
    res = feats.join(a, ["city", "cfg"]).withColumn(
        "e", F.when(F.col("pos") >= F.col("dlen") + long_ar, F.col("w") - fit1))
    max_ma = max((max(c.ma) for c in cands if c.ma), default=0)
    wcfg = Window.partitionBy("city", "cfg").orderBy("pos")
    res = res.select("city", "cfg", "pos", "date", "value", "w", "e",
                     *[f"w{l}" for l in range(1, long_ar + 1)],
                     *[F.lag("e", l).over(wcfg).alias(f"e{l}") for l in range(1, max_ma + 1)])
    # reused by stage 2 and by the forecast tail: cut the lineage once
    # (reliable checkpoint in spark.checkpoint.dir; survives executor loss)
    res = cut_lineage(res)
    # stage 2: per candidate, on rows common to all candidates
    slots = max(len(c.ar) + len(c.ma) for c in cands)
    t_min = max(len(c.diff) - 1 for c in cands) + long_ar + max_ma
    cand_df = F.broadcast(spark.createDataFrame([(c.cid, ids[c.cfg]) for c in cands], "cand_id int, cfg int"))
    x2 = res.where(F.col("pos") >= t_min).join(cand_df, "cfg")

    def slot(j: int):
        expr = None
        for c in cands:
            names = [f"w{l}" for l in c.ar] + [f"e{l}" for l in c.ma]
            val = F.col(names[j]) if j < len(names) else F.lit(0.0)
            cond = F.col("cand_id") == c.cid
            expr = F.when(cond, val) if expr is None else expr.when(cond, val)
        return expr

    x2 = x2.select("city", "cand_id", "w", *[slot(j).alias(f"s{j}") for j in range(slots)])
    ss = [F.col(f"s{j}") for j in range(slots)]
    g2 = x2.groupBy("city", "cand_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("w") * F.col("w")).alias("yy"),
        F.array(*[F.sum(ss[j] * F.col("w")) for j in range(slots)]).alias("xy"),
        F.array(*[F.sum(ss[i] * ss[j]) for i, j in _tri(slots)]).alias("xx"))
    fits = g2.mapInPandas(
        _stage2_solver({c.cid: c for c in cands}, slots),
        "city string, cand_id int, ar_coef array<double>, ma_coef array<double>, sigma2 double, "
        "aic double, n_fit long, ok boolean")
    # one row per (city, candidate), read by selection, forecast and reports:
    # solve once
    return cut_lineage(fits), res


def stage1_sums(feats: DataFrame, long_ar: int = LONG_AR) -> DataFrame:
    """Means of the products that stage 1 solves, one row per element: city,
    cfg, i, j (1-based lags; j = 0 is the value itself), n, mean."""
    used = feats.where(F.col("pos") >= F.col("dlen") + long_ar)
    x = [F.col("w"), *[F.col(f"w{lag}") for lag in range(1, long_ar + 1)]]
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (x[i] * x[j]).alias("p"))
                      for i in range(1, long_ar + 1) for j in range(i + 1)])
    return (used.select("city", "cfg", F.explode(pairs).alias("e"))
            .groupBy("city", "cfg", "e.i", "e.j").agg(F.count(F.lit(1)).alias("n"), F.avg("e.p").alias("mean")))


def forecast_status(daily_status: DataFrame, horizon: int, fits: DataFrame) -> DataFrame:
    """One row per city: ``ok``, or why there is no model forecast for it:
    ``gaps_remaining`` (the daily series has gaps), ``too_short`` (not longer
    than two horizons), ``no_usable_fit`` (no candidate fits)."""
    usable = fits.groupBy("city").agg(F.count_if("ok").alias("n_usable"))
    status = (F.when(F.col("status") != "ok", F.col("status"))
              .when(F.col("n_days") <= 2 * horizon, "too_short")
              .when(F.coalesce("n_usable", F.lit(0)) == 0, "no_usable_fit").otherwise("ok"))
    return daily_status.join(usable, "city", "left").select("city", "n_days", status.alias("status"))


def select_order(fits: DataFrame) -> DataFrame:
    """Lowest AIC per city among usable fits; first candidate on ties."""
    w = Window.partitionBy("city").orderBy("aic", "cand_id")
    return (fits.where("ok").withColumn("_rk", F.row_number().over(w))
            .where(F.col("_rk") == 1).drop("_rk"))


# --------------------------------------------------------------------------- recursion


def _forecast_runner(cands: dict[int, Candidate], horizon: int, z: float):
    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                c = cands[int(r.cand_id)]
                tail = sorted(r.tail, key=lambda t: t["pos"])
                x = [t["value"] for t in tail]
                w = [t["w"] for t in tail]
                e = [(t["e"] if t["e"] is not None and not pd.isna(t["e"]) else 0.0) for t in tail]
                phi, theta = list(r.ar_coef), list(r.ma_coef)
                diff = c.diff
                for s in range(1, horizon + 1):
                    wn = sum(ph * w[-l] for ph, l in zip(phi, c.ar))
                    wn += sum(th * e[-l] for th, l in zip(theta, c.ma))
                    xn = wn - sum(cf * x[-k] for k, cf in enumerate(diff) if k)
                    w.append(wn)
                    e.append(0.0)
                    x.append(xn)
                    rows.append((r.city, s, xn))
                # psi weights of the full (integrated) model for the interval
                arp = np.zeros(max(c.ar or [0]) + 1)
                arp[0] = 1.0
                for ph, l in zip(phi, c.ar):
                    arp[l] -= ph
                full = np.convolve(arp, np.asarray(diff))
                a = -full[1:]
                psi = np.zeros(horizon)
                psi[0] = 1.0
                for j in range(1, horizon):
                    th = sum(t for t, l in zip(theta, c.ma) if l == j)
                    psi[j] = th + sum(a[i - 1] * psi[j - i] for i in range(1, min(j, len(a)) + 1))
                cum = np.sqrt(np.cumsum(psi ** 2) * float(r.sigma2))
                base = len(rows) - horizon
                for s in range(horizon):
                    city, step, val = rows[base + s]
                    rows[base + s] = (city, step, val, val - z * cum[s], val + z * cum[s])
            yield pd.DataFrame(rows, columns=["city", "step", "forecast", "lower", "upper"])
    return run


def forecast_from_fit(best: DataFrame, res: DataFrame, horizon: int, orders=CANDIDATE_ORDERS,
                      z: float = Z95) -> DataFrame:
    """h-step mean and 95% interval (psi weights) for each city's chosen
    candidate. Only a bounded tail of each series (the longest lag span)
    leaves the window: one small row per city goes to the recursion."""
    cands = candidate_set(orders)
    ids = cfg_ids(cands)
    span = max(max(c.ar or [0]) + 1 for c in cands)
    span = max(span, max(len(c.diff) for c in cands), max(max(c.ma or [0]) + 1 for c in cands))
    cand_cfg = F.broadcast(best.sparkSession.createDataFrame(
        [(c.cid, ids[c.cfg]) for c in cands], "cand_id int, cfg int"))
    chosen = best.join(cand_cfg, "cand_id")
    last = res.groupBy("city").agg(F.max("pos").alias("_last"), F.max("date").alias("last_date"))
    tail = (res.join(chosen.select("city", "cfg"), ["city", "cfg"]).join(last, "city")
            .where(F.col("pos") > F.col("_last") - span)
            .groupBy("city").agg(F.collect_list(F.struct("pos", "value", "w", "e")).alias("tail")))
    inp = chosen.join(tail, "city").select("city", "cand_id", "ar_coef", "ma_coef", "sigma2", "tail")
    fc = inp.mapInPandas(_forecast_runner({c.cid: c for c in cands}, horizon, z),
                         "city string, step int, forecast double, lower double, upper double")
    return fc.join(last.select("city", "last_date"), "city").select(
        "city", "step", F.date_add("last_date", F.col("step")).alias("date"),
        "forecast", "lower", "upper")


def model_backtest(series: DataFrame, horizon: int = 30, orders=CANDIDATE_ORDERS) -> dict[str, DataFrame]:
    """Fit on all but the last ``horizon`` days, forecast, score against the
    held-out days and the two naive baselines."""
    split = cut_lineage(split_train_test(series, horizon))
    train = split.where(~F.col("is_test")).select("city", "pos", "date", "value")
    fits, res = fit_candidates(train, orders)
    best = select_order(fits)
    fc = forecast_from_fit(best, res, horizon, orders)
    test = split.where("is_test").select("city", "date", F.col("value").alias("actual"))
    model_pred = fc.join(test, ["city", "date"]).select(
        "city", F.lit("model").alias("model"), "date", "step", "actual",
        F.col("forecast").alias("predicted"))
    preds = model_pred.unionByName(naive_forecasts(split, horizon))
    return {"forecast": fc, "fits": fits, "best": best, "metrics": forecast_metrics(preds)}


def forecast_verdict(metrics: DataFrame) -> DataFrame:
    """Model MAE against the best naive MAE, with the deltas."""
    g = metrics.groupBy("city").agg(
        F.max(F.when(F.col("model") == "model", F.col("mae"))).alias("model_mae"),
        F.max(F.when(F.col("model") == "persistence", F.col("mae"))).alias("persistence_mae"),
        F.max(F.when(F.col("model") == "seasonal_naive", F.col("mae"))).alias("seasonal_naive_mae"))
    best_naive = F.least("persistence_mae", "seasonal_naive_mae")
    return g.select("city", "model_mae", "persistence_mae", "seasonal_naive_mae",
                    best_naive.alias("best_naive_mae"),
                    (F.col("model_mae") - best_naive).alias("delta_vs_best_naive"),
                    (F.col("model_mae") < best_naive).alias("beats_naive"))
