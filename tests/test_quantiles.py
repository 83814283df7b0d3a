"""Sketches: rank errors against exact ranks, merging, options, plan."""

import datetime as dt

import pytest
from helpers import city_day
from pyspark.sql import functions as F

from airlake.operators import cities as C
from airlake.operators import quantiles as QU
from airlake.operators import trends as T

PROBS = {"q1": 0.01, "median": 0.5, "p95": 0.95}


def _values(spark, n=60_000):
    skewed = F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("C"), F.col("id") % 4))
    return spark.range(n).select(skewed.alias("city"), (F.col("id") % 50).alias("station"),
                                 F.pow(F.pmod(F.xxhash64("id"), F.lit(100003)) / 1000.0, 2).alias("v"))


def test_rank_error_within_bound_directly_and_merged(spark):
    rows = _values(spark)
    whole = QU.sketches(rows, ["city"], "v")
    merged = QU.merged(QU.sketches(rows, ["city", "station"], "v"), ["city"])
    for parts in (whole, merged):
        errors = QU.rank_errors(rows, QU.quantiles(parts, ["city"], PROBS), ["city"], "v", PROBS).collect()
        assert len(errors) == 15 and sum(r.n for r in errors if r.name == "median") == 60_000
        assert max(r.rank_error for r in errors) <= QU.RANK_ERROR
    assert {r.city: r.n for r in whole.collect()} == {r.city: r.n for r in merged.collect()}
    worst = QU.rank_errors(rows, QU.quantiles(whole, ["city"], PROBS).withColumn("median", F.lit(0.0)), ["city"], "v", PROBS)
    assert worst.where("name = 'median'").agg(F.min("rank_error")).first()[0] > 0.4


def test_nulls_nan_ties_and_empty(spark):
    rows = spark.createDataFrame([("A", None), ("A", float("nan")), ("B", 7.0), ("B", 7.0), ("B", 9.0), (None, 1.0)],
                                 "city string, v double")
    got = {r.city: (r.n, r.median) for r in QU.quantiles(QU.sketches(rows, ["city"], "v"), ["city"], {"median": 0.5}).collect()}
    assert got == {"B": (3, 7.0), None: (1, 1.0)}
    empty = QU.sketches(rows.limit(0), ["city"], "v")
    assert QU.quantiles(QU.merged(empty, ["city"]), ["city"], PROBS).collect() == []


def test_option_of_monthly_trend_and_city_summary(spark):
    rows = [{"city": "A", "date": dt.date(2020, 1 + i % 2, 1 + i // 2 % 28), "aqi": float(i)} for i in range(101)]
    df = city_day(spark, rows)
    exact, near = C.city_summary(df).first(), C.city_summary(df, sketch_k=200).first()
    assert exact.median == near.median == 50.0 and near.p95 == pytest.approx(exact.p95, abs=1.0)
    medians = {r.month: r.median for r in T.monthly_trend(df, sketch_k=200).collect()}
    for r in T.monthly_trend(df).collect():
        assert medians[r.month] == pytest.approx(r.median, abs=1.0)


def test_sketches_are_combined_before_the_shuffle(spark):
    plan = QU.sketches(_values(spark), ["city"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "partial_kll_sketch_agg_double" in plan
