"""Days by zone: changes of the clocks, offsets, half hours, session zones."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from airlake.functions import zones as Z
from airlake.operators.ingest import zone_daily
from airlake.sources.readers import feed_days, first_readable

D = dt.datetime


def _column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("session", ["UTC", "Asia/Kolkata", "America/New_York"])
def test_utc_clock_of_text(spark, session):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session)
    try:
        got = _column(spark, ["2024-03-10T02:30:00Z", "2024-03-10T08:00:00+05:30", "2024-03-09T21:30:00-0500",
                              "2024-03-10T02:30:00", "2024-03-10", "soon", None], "string", Z.utc_clock(F.col("v")))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [D(2024, 3, 10, 2, 30)] * 4 + [D(2024, 3, 10), None, None]


def test_clocks_that_skip_and_repeat_an_hour(spark):
    # Berlin 2024: 02:00 -> 03:00 on 31 March, 03:00 -> 02:00 on 27 October
    local = [D(2024, 3, 31, 1, 30), D(2024, 3, 31, 2, 30), D(2024, 3, 31, 3, 30), D(2024, 10, 27, 2, 30), D(2024, 10, 27, 3, 30)]
    assert _column(spark, local, "timestamp_ntz", Z.utc_of_local(F.col("v"), "Europe/Berlin")) == [
        D(2024, 3, 31, 0, 30), D(2024, 3, 31, 1, 30), D(2024, 3, 31, 1, 30), D(2024, 10, 27, 0, 30), D(2024, 10, 27, 2, 30)]
    days = [dt.date(2024, 3, 30), dt.date(2024, 3, 31), dt.date(2024, 10, 27)]
    assert _column(spark, days, "date", Z.day_hours(F.col("v"), "Europe/Berlin")) == [24.0, 23.0, 25.0]
    assert _column(spark, days, "date", Z.day_hours(F.col("v"), "Asia/Kolkata")) == [24.0, 24.0, 24.0]


def test_feed_day_follows_the_zone(spark):
    rows = [(1, ("pm25", "ug/m3"), ((t,),), 1.0) for t in
            ("2024-03-30T22:59:59Z", "2024-03-30T23:00:00Z", "2024-03-31T21:59:59Z", "2024-03-31T22:00:00Z", None, "bad")]
    raw = spark.createDataFrame(rows, "sensor_id int, parameter struct<name:string,units:string>,"
                                      " period struct<datetimeFrom:struct<utc:string>>, value double")
    days = lambda zone: [str(r.date) for r in feed_days(raw, dt.date(2024, 3, 30), zone).collect()]
    assert days("Europe/Berlin") == ["2024-03-30", "2024-03-31", "2024-03-31", "2024-04-01"]  # a day of 23 hours
    assert days("UTC") == ["2024-03-30", "2024-03-30", "2024-03-31", "2024-03-31"]
    assert days("Asia/Kolkata") == ["2024-03-31", "2024-03-31", "2024-04-01", "2024-04-01"]


def test_coverage_counts_a_repeated_hour_twice(spark):
    start = D(2024, 10, 26, 22)  # midnight in Berlin on the day of 25 hours
    rows = [("X", start + dt.timedelta(hours=h, minutes=m), float(h)) for h in range(25) for m in (0, 40)]
    got = zone_daily(spark.createDataFrame(rows, "city string, utc timestamp_ntz, value double"), "Europe/Berlin").collect()
    assert [(str(r.date), r.n, r.hours, r.day_hours, r["mean"]) for r in got] == [("2024-10-27", 50, 25, 25.0, 12.0)]
    # half-hour zone: the day begins inside an hour of UTC
    half = [("X", D(2024, 5, 1, 18, 30) + dt.timedelta(minutes=30 * i), 1.0) for i in range(48)]
    half += [("X", D(2024, 5, 1, 19), None), ("X", None, 1.0)]
    got = zone_daily(spark.createDataFrame(half, "city string, utc timestamp_ntz, value double"), "Asia/Kolkata").collect()
    assert [(str(r.date), r.n, r.hours, r.day_hours) for r in got] == [("2024-05-02", 48, 24, 24.0)]
    assert zone_daily(spark.createDataFrame([], "city string, utc timestamp_ntz, value double"), "UTC").collect() == []


def test_first_readable_passes_over_damaged_files(spark, scratch):
    damaged, other, good = f"{scratch}/damaged.parquet", f"{scratch}/other", f"{scratch}/good"
    with open(damaged, "w") as f:
        f.write("no parquet")
    spark.range(1).write.parquet(other)
    spark.sql("select 'X' City, '2024-01-01' Date").write.parquet(good)
    paths = [f"{scratch}/missing", damaged, other, good]
    assert first_readable(spark, paths, "parquet", ("City", "Date")) == good
    assert first_readable(spark, paths, "parquet") == other
    with pytest.raises(FileNotFoundError, match="lacks"):
        first_readable(spark, paths[:3], "parquet", ("City",))
