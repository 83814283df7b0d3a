"""Trials of the forecast intervals against fits of each origin on its own."""

import datetime as dt

import numpy as np
import pytest

from airlake.operators import forecast as FC
from airlake.operators import rolling_origin as RO


def _series(spark, **cities):
    rows = [(c, i, dt.date(2015, 1, 1) + dt.timedelta(days=i), float(v)) for c, vs in cities.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "city string, pos int, date date, value double")


def _walk(seed, n, season=0.0):
    rng = np.random.default_rng(seed)
    w = np.zeros(n)
    for t in range(1, n):
        w[t] = 0.5 * w[t - 1] + rng.normal()
    return 100 + np.cumsum(w) * 0.3 + season * np.sin(2 * np.pi * np.arange(n) / 7)


def test_each_origin_equals_a_fit_of_its_own_days(spark):
    data = {"A": _walk(1, 420), "B": _walk(2, 367, 8.0), "SHORT": _walk(3, 200)}
    got = RO.interval_trials(_series(spark, **data), horizon=10, step=60, min_train=220).collect()
    assert {(r.city, r.origin) for r in got} == {("A", 0), ("A", 1), ("A", 2), ("A", 3), ("B", 0), ("B", 1), ("B", 2)}
    for origin in (0, 2):
        cuts = {c: len(v) - 10 - 60 * origin for c, v in data.items() if c != "SHORT"}
        fits, res = FC.fit_candidates(_series(spark, **{c: data[c][:n] for c, n in cuts.items()}))
        best = FC.select_order(fits)
        order = {r.city: r.cand_id for r in best.collect()}
        want = {(r.city, r.step): r for r in FC.forecast_from_fit(best, res, 10).collect()}
        mine = [r for r in got if r.origin == origin]
        assert len(mine) == len(want) == 20
        for r in mine:
            w = want[r.city, r.step]
            assert r.cand_id == order[r.city] and r.date == w.date
            assert (r.forecast, r.lower, r.upper) == pytest.approx((w.forecast, w.lower, w.upper), rel=1e-7)
            assert r.actual == pytest.approx(data[r.city][cuts[r.city] + r.step - 1])


def test_coverage_and_widening(spark):
    t = spark.createDataFrame([("X", 0, i, 0.0, -1.0, 1.0, a) for i, a in enumerate([0.0, 0.5, -1.0, 4.0])] +
                              [("FLAT", 0, 1, 0.0, 0.0, 0.0, 0.0)],
                              "city string, origin int, step int, forecast double, lower double, upper double, actual double")
    cov = RO.interval_coverage(t, level=1.0)
    rows = {r.city: r for r in cov.collect()}
    assert (rows["X"].n_origins, rows["X"].n_forecasts, rows["X"].pct_covered, rows["X"].mean_width, rows["X"].width_factor) == (
        1, 4, 75.0, 2.0, 4.0)
    assert rows["FLAT"].pct_covered == 100.0 and rows["FLAT"].width_factor is None
    fc = spark.createDataFrame([("X", 10.0, 8.0, 12.0), ("Y", 1.0, 0.0, 2.0)], "city string, forecast double, lower double, upper double")
    assert {(r.city, r.lower, r.upper) for r in RO.widen(fc, cov).collect()} == {("X", 2.0, 18.0), ("Y", 0.0, 2.0)}


def test_intervals_of_the_right_model_hold_their_level(spark):
    data = {f"C{i}": _walk(10 + i, 1200) for i in range(4)}
    cov = RO.interval_coverage(RO.interval_trials(_series(spark, **data), horizon=5, step=25, min_train=400), keys=())
    r = cov.first()
    assert r.n_forecasts == 4 * 32 * 5 and 90.0 < r.pct_covered < 98.5
    assert 0.8 < r.width_factor < 1.25


def test_short_and_empty_series(spark):
    none = RO.interval_trials(_series(spark, A=_walk(1, 100)), horizon=10, step=60, min_train=220)
    assert none.count() == 0 and RO.interval_coverage(none).count() == 0
    assert RO.interval_trials(_series(spark, A=[]), horizon=10, step=60, min_train=220).count() == 0
    with pytest.raises(ValueError):
        RO.interval_trials(_series(spark, A=[]), horizon=10, step=60, min_train=40)


def test_one_aggregate_reads_the_days(spark):
    s = RO._numbered(_series(spark, A=_walk(1, 420)), 10, 220)
    plan = RO.origin_sums(s, 10, 60, 220)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" in plan and "CartesianProduct" not in plan
