"""Decomposition properties and the re-aimed forecaster on generated series."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlake.operators import forecast as FC
from airlake.operators import series as SE


def _series(spark, values, city="X", start=dt.date(2015, 1, 1)):
    rows = [(city, i, start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "city string, pos int, date date, value double")


def test_decomposition_adds_back_and_cycle_sums_to_zero(spark):
    from conftest import SF_MID
    from airlake.sources.fixtures import base_day
    dec = SE.seasonal_decompose(SE.monthly_series(base_day(spark, SF_MID), "pm25", 2))
    rows = dec.where(F.col("trend").isNotNull()).collect()
    assert rows
    for r in rows:
        assert r.trend + r.seasonal + r.resid == pytest.approx(r.observed)
    cyc = SE.seasonal_cycle(dec).groupBy("city").agg(F.sum("effect").alias("s")).collect()
    assert all(abs(r.s) < 1e-6 for r in cyc)


def test_naive_baselines_exact(spark):
    vals = list(range(1, 101))
    split = FC.split_train_test(_series(spark, vals), 10)
    p = {(r.model, r.step): r.predicted for r in FC.naive_forecasts(split, 10, m=7).collect()}
    assert p[("persistence", 1)] == 90.0 and p[("persistence", 10)] == 90.0
    assert [p[("seasonal_naive", s)] for s in range(1, 11)] == [84, 85, 86, 87, 88, 89, 90, 84, 85, 86]
    too_short = FC.split_train_test(_series(spark, vals[:20]), 10)
    assert too_short.count() == 0


def test_metrics_skip_zero_actual(spark):
    df = spark.createDataFrame([("X", "m", 0.0, 1.0), ("X", "m", 2.0, 1.0)],
                               "city string, model string, actual double, predicted double")
    r = FC.forecast_metrics(df).first()
    assert r.mae == 1.0 and r.rmse == 1.0 and r.mape == 50.0 and r.n_mape_skipped == 1


def test_recovers_ar_coefficients_and_intervals(spark):
    rng = np.random.default_rng(3)
    n = 1500
    # x_t - x_{t-1} = w_t follows AR(1) with phi 0.6 plus MA(1) 0.3
    e = rng.normal(0, 1, n + 2)
    w = np.zeros(n + 2)
    for t in range(1, n + 2):
        w[t] = 0.6 * w[t - 1] + e[t] + 0.3 * e[t - 1]
    x = 100 + np.cumsum(w[2:])
    series = _series(spark, x)
    orders = (((1, 1, 1), (0, 0, 0, 0)), ((2, 1, 2), (0, 0, 0, 0)))
    fits, res = FC.fit_candidates(series, orders)
    f = {r.cand_id: r for r in fits.collect()}
    assert f[0].ok and f[0].ar_coef[0] == pytest.approx(0.6, abs=0.08)
    assert f[0].ma_coef[0] == pytest.approx(0.3, abs=0.1)
    best = FC.select_order(fits)
    fc = FC.forecast_from_fit(best, res, 14, orders).orderBy("step").collect()
    assert len(fc) == 14
    widths = [r.upper - r.lower for r in fc]
    assert all(np.isfinite(widths)) and all(b >= a for a, b in zip(widths, widths[1:]))
    assert all(r.lower <= r.forecast <= r.upper for r in fc)


def _months(spark, values, city="X"):
    rows = [(city, dt.date(2000 + i // 12, i % 12 + 1, 1), float(v), False, 0, len(values), i)
            for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "city string, month date, value double, interpolated boolean, "
                                       "n_interpolated long, n_months long, pos int")


def test_multiplicative_decomposition_multiplies_back(spark):
    wave = [1 + 0.3 * np.sin(2 * np.pi * i / 12) for i in range(60)]
    good = _months(spark, [(100 + i) * w for i, w in enumerate(wave)])
    series = good.unionByName(_months(spark, [0.0] * 40, "zero")).unionByName(_months(spark, wave[:20], "short"))
    rows = SE.seasonal_decompose(series, model="multiplicative").where("trend is not null").collect()
    assert rows and {r.city for r in rows} == {"X"}
    assert all(r.trend * r.seasonal * r.resid == pytest.approx(r.observed) for r in rows)
    status = {r.city: r.status for r in SE.decomposition_status(series, model="multiplicative").collect()}
    assert status == {"X": "ok", "zero": "not_positive", "short": "too_short"}


def test_forecast_status_has_every_city(spark):
    rng = np.random.default_rng(0)
    series = (_series(spark, rng.normal(size=200).cumsum() + 50, "good")
              .unionByName(_series(spark, [5.0] * 200, "constant"))
              .unionByName(_series(spark, rng.normal(size=50), "short")))
    status = spark.createDataFrame([("good", 200, "ok"), ("constant", 200, "ok"), ("short", 50, "ok"),
                                    ("gaps", 90, "gaps_remaining")], "city string, n_days long, status string")
    train = FC.split_train_test(series, 30).where(~F.col("is_test")).select("city", "pos", "date", "value")
    got = {r.city: r.status for r in FC.forecast_status(status, 30, FC.fit_candidates(train)[0]).collect()}
    assert got == {"good": "ok", "constant": "no_usable_fit", "short": "too_short", "gaps": "gaps_remaining"}
