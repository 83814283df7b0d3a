"""One test per semantic trap, on tiny hand-written frames."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from airlake.functions.aqi import aqi_bucket, aqi_of, sub_index
from airlake.functions.stats import pearson
from airlake.operators import attribution as A
from airlake.operators import cities as C
from airlake.operators import events as EV
from airlake.operators import quality as Q
from airlake.operators import series as SE
from airlake.operators import splice as SP
from airlake.operators.ingest import normalise_units
from airlake.schema import nan_to_null
from helpers import city_day


def one(df):
    return [r.asDict() for r in df.collect()]


def test_bounded_interpolation_fills_start_of_long_gap(spark):
    # monthly values at months 0..9 with a 4-month gap (months 2..5)
    rows = [("X", dt.date(2020, m + 1, 15), float(v)) for m, v in
            [(0, 10), (1, 20), (6, 70), (7, 80), (8, 90), (9, 100)]]
    df = spark.createDataFrame(rows, "city string, date date, v double")
    g = SE.interpolate_bounded(SE.regular(
        df.groupBy("city", F.trunc("date", "MM").alias("month")).agg(F.avg("v").alias("value")),
        "month", "MONTH"), "month", 2)
    got = {r.pos: r.filled for r in g.collect()}
    assert got[2] == pytest.approx(30.0) and got[3] == pytest.approx(40.0)
    assert got[4] is None and got[5] is None
    # longest run: months 6..9 (4) vs 0..3 (4): earliest wins on ties
    s = SE.monthly_series(df.withColumnRenamed("v", "pm25"), "pm25", 2)
    months = sorted(r.month.month for r in s.collect())
    assert months == [1, 2, 3, 4]
    assert {r.n_interpolated for r in s.collect()} == {2}


def test_nan_becomes_null_and_greatest_skips_null(spark):
    df = spark.createDataFrame([(float("nan"), 5.0), (None, 7.0)], "a double, b double")
    out = nan_to_null(df).select(F.greatest("a", "b").alias("g"), F.col("a").isNull().alias("n")).collect()
    assert [(r.g, r.n) for r in out] == [(5.0, True), (7.0, True)]


def test_zero_baseline_gives_null_not_error(spark):
    recs = [{"city": "X", "date": f"2019-{m:02d}-01", "pm25": 0.0} for m in range(1, 10)]
    recs += [{"city": "X", "date": "2019-10-05", "pm25": 50.0}]
    r = one(EV.season_effect(city_day(spark, recs)))[0]
    assert r["rest_mean"] == 0.0 and r["multiplier"] is None and r["pct_change"] is None


def test_correlation_of_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(pearson("x", "y").alias("r")).first().r is None
    one_row = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    assert one_row.agg(pearson("x", "y").alias("r")).first().r is None


def test_sub_index_unclamped_edges_and_extrapolation(spark):
    df = spark.createDataFrame([(-6.0,), (30.0,), (30.000001,), (500.0,), (750.0,), (None,)], "c double")
    got = [r.si for r in df.select(sub_index("c", "PM2.5").alias("si")).collect()]
    assert got[0] == pytest.approx(-10.0)          # negative falls in the first band
    assert got[1] == pytest.approx(50.0)           # edge belongs to the lower band
    assert got[2] == pytest.approx(50.0, abs=1e-4)
    assert got[3] == pytest.approx(500.0)
    assert got[4] == pytest.approx(600.0)          # above the table: last band's slope
    assert got[5] is None


def test_sub_index_monotone_and_continuous(spark):
    from airlake.reference import BREAKPOINTS
    xs = [i * 0.5 for i in range(0, 5000)]
    df = spark.createDataFrame([(x,) for x in xs], "c double")
    for p, bands in BREAKPOINTS.items():
        vals = [r.s for r in df.select(sub_index("c", p).alias("s")).orderBy("c").collect()]
        assert all(b >= a for a, b in zip(vals, vals[1:])), p
        for lo, hi, ilo, ihi in bands[:-1]:
            e = spark.createDataFrame([(float(hi),), (float(hi) + 1e-9,)], "c double")
            a, b = [r.s for r in e.select(sub_index("c", p).alias("s")).collect()]
            assert a == pytest.approx(ihi) and b == pytest.approx(ihi, abs=1e-5)


def test_aqi_needs_three_sub_indices_and_bucket(spark):
    df = spark.createDataFrame([(10.0, 20.0, None), (10.0, 20.0, 30.0)], "a double, b double, c double")
    got = [r.q for r in df.select(aqi_of(["a", "b", "c"]).alias("q")).collect()]
    assert got == [None, 30.0]
    b = spark.createDataFrame([(50.0,), (50.5,), (400.0,), (401.0,), (None,)], "x double")
    assert [r.k for r in b.select(aqi_bucket("x").alias("k")).collect()] == [
        "Good", "Satisfactory", "Very Poor", "Severe", None]


def test_equal_sub_indices_tie_to_table_order(spark):
    # PM2.5 30 -> 50, PM10 50 -> 50, NO2 40 -> 50: PM2.5 first in table order
    recs = [{"city": "X", "date": "2020-01-01", "pm25": 30.0, "pm10": 50.0, "no2": 40.0}]
    r = one(A.compute_sub_indices(city_day(spark, recs)))[0]
    assert r["responsible"] == "PM2.5" and r["computed_aqi"] == pytest.approx(50.0)


def test_dominant_pollutant_ties_alphabetical(spark):
    recs = [{"city": "X", "date": "2020-01-01", "pm25": 100.0, "pm10": 0.0, "no2": 0.0},
            {"city": "X", "date": "2020-01-02", "pm25": 0.0, "pm10": 300.0, "no2": 0.0}]
    shares = A.seasonal_attribution(city_day(spark, recs), order=False)
    d = one(A.dominant_pollutant_by_season(shares))
    assert d[0]["responsible"] == "PM10" and d[0]["share_pct"] == 50.0


def test_shares_sum_to_100(spark):
    from conftest import SF_SMALL
    from airlake.sources.fixtures import base_day
    s = A.seasonal_attribution(base_day(spark, SF_SMALL), order=False)
    tot = s.groupBy("city", "season").agg(F.sum("share_pct").alias("t")).collect()
    assert tot and all(r.t == pytest.approx(100.0) for r in tot)


def test_lockdown_baseline_uses_every_other_year(spark):
    recs = [{"city": "X", "date": f"{y}-04-10", "pm25": v} for y, v in
            [(2018, 100.0), (2019, 80.0), (2020, 40.0), (2021, 60.0)]]
    lk = EV.lockdown_effect(city_day(spark, recs))
    r = one(EV.lockdown_summary(lk))[0]
    assert r["baseline_mean"] == pytest.approx(80.0) and r["n_baseline_years"] == 3
    r2 = one(EV.lockdown_summary(lk, baseline_years=[2018, 2019]))[0]
    assert r2["baseline_mean"] == pytest.approx(90.0)


def test_city_summary_without_match_is_empty(spark):
    recs = [{"city": "X", "date": "2020-01-01", "aqi": 100.0}]
    assert C.city_summary(city_day(spark, recs), cities=["NOWHERE"]).count() == 0


def test_region_filter_strict(spark):
    recs = [{"city": "X", "date": "2020-01-01", "aqi": 100.0}]
    with pytest.raises(ValueError):
        Q.filter_cities(city_day(spark, recs), ["NOWHERE"])


def test_splice_recomputed_aqi_fills_every_hole_and_gate(spark):
    base = city_day(spark, [{"city": "X", "date": "2020-01-01", "pm25": 40.0, "pm10": 60.0, "no2": 50.0}])
    bul = spark.createDataFrame([("X", dt.date(2020, 2, 1), 123.0)], "city string, date date, aqi double")
    rec = city_day(spark, [{"city": "X", "date": "2020-03-01", "pm25": 10.0, "pm10": 20.0, "no2": 30.0,
                            "co": 5.0}]).drop("aqi", "aqi_bucket")
    out = {r.date.month: r for r in SP.splice_sources(base, bul, rec).collect()}
    assert out[1].aqi is not None          # base without AQI: recomputed
    assert out[2].aqi == 123.0             # bulletin
    assert out[3].co is None               # untrusted feed pollutant dropped
    assert out[3].aqi is not None
    dup = base.unionByName(base)
    with pytest.raises(Exception):
        SP.splice_sources(dup, bul, rec).collect()


def test_null_rates_rounding(spark):
    recs = [{"city": "X", "date": f"2020-01-{d:02d}", "pm25": (None if d <= 1 else 1.0)} for d in range(1, 9)]
    r = {x["column"]: x for x in one(Q.null_rates(city_day(spark, recs), ["pm25"]))}
    assert r["pm25"]["n_missing"] == 1 and r["pm25"]["pct_missing"] == 12.5
    assert r["pm25"]["pct_missing_exact"] == 12.5


def test_units_case_insensitive(spark):
    df = spark.createDataFrame([("no2", "PPB", 10.0), ("co", "ppm", 2.0), ("pm25", "ug/m3", 5.0),
                                ("so2", "ppb", None)], "param string, unit string, value double")
    got = [r.value_converted for r in normalise_units(df).collect()]
    assert got[0] == pytest.approx(18.8) and got[1] == pytest.approx(2.29) and got[2] == 5.0
    assert got[3] is None


def test_festival_window_inclusive(spark):
    cal = spark.createDataFrame([(2019, dt.date(2019, 10, 27))], "year int, event_date date")
    recs = [{"city": "X", "date": (dt.date(2019, 10, 27) + dt.timedelta(days=k)).isoformat(), "pm25": 10.0 + k}
            for k in range(-15, 4)]
    r = one(EV.festival_effect(city_day(spark, recs), cal))[0]
    assert r["n_festival"] == 3 and r["n_baseline"] == 14
    assert r["festival_mean"] == pytest.approx(11.0)
    assert r["baseline_mean"] == pytest.approx(sum(10.0 + k for k in range(-14, 0)) / 14)
    assert math.isclose(r["pct_change"], 100 * (11.0 - r["baseline_mean"]) / r["baseline_mean"])


def test_require_city_lists_available(spark):
    recs = [{"city": "X", "date": "2020-01-01", "aqi": 1.0}, {"city": "Y", "date": "2020-01-01", "aqi": 1.0}]
    with pytest.raises(ValueError, match=r"\['X', 'Y'\]"):
        Q.require_city(city_day(spark, recs), "Z")
    assert Q.require_city(city_day(spark, recs), "X").count() == 1


def test_null_rates_worst_first(spark):
    recs = [{"city": "X", "date": "2020-01-01", "pm25": 1.0, "aqi": None}]
    rows = Q.null_rates(city_day(spark, recs), ["pm25", "aqi", "nox"], order=True).collect()
    assert [r.column for r in rows] == ["aqi", "nox", "pm25"]
