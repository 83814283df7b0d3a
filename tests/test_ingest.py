"""Ingest: the day-split rolling window against a station-wide brute force,
dense day grid, file scans and the curated sink."""

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from airlake.operators.ingest import city_daily, rolling_daily_max, station_daily
from airlake.sources import readers
from airlake.sources.readers import load_raw, scan_hourly, first_readable
from airlake.sources.sinks import replace_cities, write_city_day
from helpers import city_day


def _random_readings(seed=7, n=900):
    rng = np.random.default_rng(seed)
    rows = []
    eid = 0
    for st in range(3):
        t = dt.datetime(2024, 1, 1)
        for _ in range(n // 3):
            # irregular gaps: minutes to two days; some duplicate timestamps
            gap = rng.choice([0, 30, 60, 60, 60, 180, 600, 2880])
            t = t + dt.timedelta(minutes=int(gap))
            o3 = None if rng.random() < 0.25 else float(rng.integers(0, 200))
            co = None if rng.random() < 0.1 else float(rng.integers(0, 20)) / 4
            rows.append(("C", st, t, eid, o3, co))
            eid += 1
    return rows


@pytest.mark.parametrize("chunk", ["day", "hour"])
def test_split_rolling_matches_station_wide_rolling(spark, chunk):
    rows = _random_readings()
    df = spark.createDataFrame(rows, "city string, station_id long, ts timestamp_ntz, event_id long, "
                                     "o3 double, co double")
    got = rolling_daily_max(df, ["o3", "co"], means=["o3"], chunk=chunk).toPandas()
    pdf = pd.DataFrame(rows, columns=["city", "station_id", "ts", "event_id", "o3", "co"])
    exp = []
    for st, g in pdf.sort_values(["station_id", "ts", "event_id"]).groupby("station_id"):
        g = g.copy()
        for c in ("o3", "co"):
            g[f"{c}_8h"] = g[c].rolling(8, min_periods=6).mean()
        g["date"] = g["ts"].dt.date
        exp.append(g.groupby("date")[["o3_8h", "co_8h"]].max().reset_index().assign(station_id=st))
    exp = pd.concat(exp)
    m = exp.merge(got, on=["station_id", "date"], suffixes=("_exp", "_got"))
    assert len(m) == len(exp) == len(got)
    means = pdf.assign(date=pdf["ts"].dt.date).groupby(["station_id", "date"])["o3"].mean()
    mm = m.set_index(["station_id", "date"]).join(means.rename("o3_mean"))
    assert np.allclose(mm["o3"].to_numpy(dtype=float), mm["o3_mean"].to_numpy(dtype=float), equal_nan=True)
    for c in ("o3_8h", "co_8h"):
        a, b = m[f"{c}_exp"].to_numpy(dtype=float), m[f"{c}_got"].to_numpy(dtype=float)
        assert np.array_equal(np.isnan(a), np.isnan(b)), c
        assert np.allclose(a[~np.isnan(a)], b[~np.isnan(b)]), c


def _brute_time_rolling(rows, width, least=6):
    """(station, date) -> max over the day of the mean of (t - width, t], all readings of t included."""
    out = {}
    for _, st, t, _, *values in rows:
        best = out.setdefault((st, t.date()), [None] * len(values))
        near = [r for r in rows if r[1] == st and t - width < r[2] <= t]
        for i in range(len(values)):
            seen = [r[4 + i] for r in near if r[4 + i] is not None]
            if len(seen) >= least:
                best[i] = max(sum(seen) / len(seen), -1e9 if best[i] is None else best[i])
    return out


@pytest.mark.parametrize("frame,width", [("8 hours", dt.timedelta(hours=8)), ("90 minutes", dt.timedelta(minutes=90)),
                                         ("2 days", dt.timedelta(days=2))])
def test_time_frame_matches_brute_force(spark, frame, width):
    rows = _random_readings(seed=11, n=450)
    t0 = dt.datetime(2024, 6, 1)
    # a station whose readings lie exactly one frame apart, one microsecond less, and at chunk edges
    rows += [("C", 9, t0 + i * width / 2, 5000 + i, float(i), 1.0) for i in range(8)]
    rows += [("C", 9, t0 + width - dt.timedelta(microseconds=1), 6000, 50.0, None)]
    rows += [("C", 9, t0 + width, 6001 + i, 10.0, 2.0) for i in range(6)]
    df = spark.createDataFrame(rows, "city string, station_id long, ts timestamp_ntz, event_id long, "
                                     "o3 double, co double").repartition(3)
    got = rolling_daily_max(df, ["o3", "co"], min_rows=6, means=["o3"], frame=frame).collect()
    want = _brute_time_rolling(rows, width)
    assert {(r.station_id, r.date) for r in got} == set(want)
    for r in got:
        assert [r.o3_8h, r.co_8h] == pytest.approx(want[r.station_id, r.date]) or [r.o3_8h, r.co_8h] == want[r.station_id, r.date]
    assert any(v != [None, None] for v in want.values())


def test_time_frame_differs_from_rows_only_around_gaps(spark):
    t0 = dt.datetime(2024, 3, 31)
    full = [("C", 1, t0 + dt.timedelta(hours=h), h, float(h), 1.0) for h in range(48)]
    schema = "city string, station_id long, ts timestamp_ntz, event_id long, o3 double, co double"
    def days(rows, frame):
        out = rolling_daily_max(spark.createDataFrame(rows, schema), ["o3"], frame=frame).collect()
        return {r.date: r.o3_8h for r in out}
    assert days(full, "rows") == pytest.approx(days(full, "8 hours"))
    gap = [r for r in full if not 20 <= r[3] < 44]  # the four readings after the gap are too few
    assert days(gap, "rows")[dt.date(2024, 4, 1)] == pytest.approx((16 + 17 + 18 + 19 + 44 + 45 + 46 + 47) / 8)
    assert days(gap, "8 hours")[dt.date(2024, 4, 1)] is None


def test_time_frame_does_not_depend_on_the_session_zone(spark):
    rows = [("C", 1, dt.datetime(2024, 3, 10, h % 24, 30) + dt.timedelta(days=h // 24), h, float(h), 1.0) for h in range(40)]
    df = spark.createDataFrame(rows, "city string, station_id long, ts timestamp_ntz, event_id long, o3 double, co double")
    zone, out = spark.conf.get("spark.sql.session.timeZone"), []
    try:
        for z in ("UTC", "America/New_York"):  # 10 March 2024: clocks go forward there
            spark.conf.set("spark.sql.session.timeZone", z)
            out.append(sorted(tuple(r) for r in rolling_daily_max(df, ["o3"], frame="8 hours").collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert out[0] == out[1]


def test_time_frame_has_no_window_by_station_alone(spark):
    import re

    df = spark.createDataFrame(_random_readings(n=30), "city string, station_id long, ts timestamp_ntz, event_id long, "
                                                       "o3 double, co double")
    plan = rolling_daily_max(df, ["o3"], frame="8 hours")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if re.match(r"[\s:+-]*Window ", line)]
    assert windows and all(re.search(r"\], \[station_id#\d+L?, _chunk#\d+L?\]", w) for w in windows), windows
    with pytest.raises(ValueError):
        rolling_daily_max(df, ["o3"], frame="eight")


def test_monthly_rolling_over_calendar_months(spark):
    from airlake.operators.trends import monthly_rolling

    months = [dt.date(2020 + m // 12, m % 12 + 1, 1) for m in range(40) if not 10 <= m < 17 and m != 30]
    df = spark.createDataFrame([("A", m, float(i)) for i, m in enumerate(months)], "city string, month date, mean double")
    value, index = {m: float(i) for i, m in enumerate(months)}, lambda m: m.year * 12 + m.month
    for r in monthly_rolling(df, frame="months").collect():
        near = [v for m, v in value.items() if index(r.month) - 12 < index(m) <= index(r.month)]
        assert r.rolling_mean == (pytest.approx(sum(near) / len(near)) if len(near) >= 6 else None)
    assert monthly_rolling(df).where("rolling_mean is null").count() == 5


def test_dense_grid_and_city_mean(spark):
    rows = [("C", 1, dt.datetime(2024, 1, 1, h), h, 10.0, 10.0, 10.0, 1.0, 1.0) for h in range(8)]
    rows += [("C", 1, dt.datetime(2024, 1, 3, 0), 100, 30.0, 30.0, 30.0, 3.0, 3.0)]
    rows += [("C", 2, dt.datetime(2024, 1, 1, 5), 200, 50.0, 50.0, 50.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "city string, station_id long, ts timestamp_ntz, event_id long, "
                                     "pm25 double, pm10 double, no2 double, o3 double, co double")
    sd = station_daily(df, ["pm25", "pm10", "no2", "o3", "co"])
    days = {(r.station_id, r.date.day): r for r in sd.collect()}
    assert set(days) == {(1, 1), (1, 2), (1, 3), (2, 1)}
    assert days[(1, 2)].pm25 is None                       # empty day kept (dense grid)
    assert days[(1, 1)].o3_8h == pytest.approx(1.0)
    assert days[(1, 3)].o3_8h == pytest.approx((7 * 1.0 + 3.0) / 8)   # window crosses days
    cd = {r.date.day: r for r in city_daily(sd).collect()}
    assert cd[1].pm25 == pytest.approx(30.0)               # unweighted mean of station means
    assert cd[2].pm25 is None and cd[2].aqi is None


def test_scan_hourly_files_with_different_columns(spark, scratch):
    folder = os.path.join(scratch, "hourly")
    os.makedirs(folder)
    with open(os.path.join(folder, "ST1.csv"), "w") as f:
        f.write("From Date,To Date,PM2.5 (ug/m3),Ozone (ug/m3)\n")
        f.write("2020-01-01 00:00:00,2020-01-01 01:00:00,12.5,40\n")
        f.write("not a date,x,13,41\n")
        f.write("2020-01-01 01:00:00,2020-01-01 02:00:00,bad,NaN\n")
    with open(os.path.join(folder, "ST2.csv"), "w") as f:
        f.write("From Date,CO (mg/m3)\n2020-01-02 00:00:00,1.25\n")
    with open(os.path.join(folder, "junk.csv"), "w") as f:
        f.write("a,b\n1,2\n")
    out = {(r.station_id, r.ts): r for r in scan_hourly(spark, folder).collect()}
    assert len(out) == 3
    r = out[("ST1", dt.datetime(2020, 1, 1, 0))]
    assert r.pm25 == 12.5 and r.o3 == 40.0 and r.co is None
    r = out[("ST1", dt.datetime(2020, 1, 1, 1))]
    assert r.pm25 is None and r.o3 is None                  # bad text and NaN -> NULL
    assert out[("ST2", dt.datetime(2020, 1, 2))].co == 1.25


def test_load_raw_rejects_bad_dates_and_roundtrip(spark, scratch):
    good = os.path.join(scratch, "good.csv")
    with open(good, "w") as f:
        f.write("City,Date,PM2.5,AQI,AQI_Bucket\nX,2020-01-01,10,50,Good\nX,2020-01-02,nan,oops,\n")
    df = load_raw(spark, good)
    rows = {r.date.day: r for r in df.collect()}
    assert rows[1].pm25 == 10.0 and rows[2].pm25 is None and rows[2].aqi is None
    bad = os.path.join(scratch, "bad.csv")
    with open(bad, "w") as f:
        f.write("City,Date,PM2.5\nX,2020-13-45,1\nX,2020-01-01,2\n")
    with pytest.raises(ValueError, match="1 rows"):
        load_raw(spark, bad)
    assert first_readable(spark, [os.path.join(scratch, "missing.csv"), good]) == good
    out = os.path.join(scratch, "curated")
    prof = {r.city: r for r in write_city_day(df, out).collect()}
    assert prof["X"].n_rows == 2
    back = spark.read.parquet(out).where(F.col("city") == "X")
    assert back.count() == 2


def test_splice_rows_equal_distinct_keys(spark):
    from conftest import SF_SMALL
    import __spark_entry__ as E
    df = E.queries()["splice_sources"](spark, SF_SMALL)
    assert df.count() == df.select("city", "date").distinct().count()


def test_same_results_under_one_and_many_partitions(spark):
    from conftest import SF_SMALL
    import __spark_entry__ as E
    q = E.queries()["seasonal_attribution"]
    a = sorted(tuple(r) for r in q(spark, SF_SMALL).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        b = sorted(tuple(r) for r in q(spark, SF_SMALL).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b


def test_city_results_independent_of_other_cities(spark):
    from conftest import SF_SMALL
    from airlake.operators import cities as C
    from airlake.sources.fixtures import base_day
    bd = base_day(spark, SF_SMALL)
    full = {r.city: tuple(r) for r in C.city_summary(bd, order=False).collect()}
    only = {r.city: tuple(r) for r in C.city_summary(bd.where(F.col("city") == "ASIA"), order=False).collect()}
    assert only["ASIA"] == full["ASIA"]


def test_build_pipeline_end_to_end(spark, scratch):
    """Hourly files -> station lookup -> station-day (8h maxima) -> city-day
    with start floor and AQI -> curated write -> read back."""
    from airlake.sources.readers import attach_city, station_registry_csv
    folder = os.path.join(scratch, "raw")
    os.makedirs(folder)
    for sid, base in (("S1", 40.0), ("S2", 80.0)):
        with open(os.path.join(folder, f"{sid}.csv"), "w") as f:
            f.write("From Date,PM2.5 (ug/m3),PM10 (ug/m3),NO2 (ug/m3),Ozone (ug/m3),CO (mg/m3)\n")
            for h in range(48):
                t = dt.datetime(2014, 12, 31) + dt.timedelta(hours=h)
                f.write(f"{t:%Y-%m-%d %H:%M:%S},{base},{base * 2},{base / 2},{base + h},1.5\n")
    reg = os.path.join(scratch, "stations.csv")
    with open(reg, "w") as f:
        f.write("StationId,City\nS1,CityA\nS2,CityA\nS3,Elsewhere\n")
    readings = attach_city(scan_hourly(spark, folder), station_registry_csv(spark, reg, ["CityA"]))
    sd = station_daily(readings, ["pm25", "pm10", "no2", "o3", "co"], tiebreak="reading_id")
    cd = city_daily(sd, start=dt.date(2015, 1, 1))
    rows = cd.collect()
    assert [r.date for r in rows] == [dt.date(2015, 1, 1)]
    r = rows[0]
    assert r.pm25 == pytest.approx(60.0)
    # 8-reading trailing mean of o3 = base + h over hours 24..47: max at h=47
    assert r.o3_8h == pytest.approx(((40 + 80) / 2) + (47 + 46 + 45 + 44 + 43 + 42 + 41 + 40) / 8)
    assert r.aqi is not None and r.aqi_bucket is not None
    prof = write_city_day(cd.drop("o3_8h", "co_8h"), os.path.join(scratch, "out")).collect()
    assert prof[0].n_rows == 1


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_missing_dates_are_rejected(spark, scratch):
    path = os.path.join(scratch, "m.csv")
    _write(path, "City,Date,PM2.5\nX,,1\nX,2020-01-01,2\n")
    with pytest.raises(ValueError, match="1 rows"):
        load_raw(spark, path)


def test_load_clean_and_recent(spark, scratch):
    from airlake.sources.readers import load_clean, load_recent
    path = os.path.join(scratch, "c.csv")
    _write(path, "City,Date,PM2.5,AQI\nX,2020-01-01,1,50\nY,2020-01-01,2,\n")
    assert [(r.city, r.aqi) for r in load_clean(spark, path, ["X", "Z"]).collect()] == [("X", 50.0)]
    with pytest.raises(ValueError, match="present"):
        load_clean(spark, path, ["Z"])
    assert load_recent(spark, path).count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        load_recent(spark, os.path.join(scratch, "none.csv"))


def test_feed_days_cut_and_types(spark):
    from airlake.sources.readers import feed_days
    raw = spark.sql("""select 7L as sensor_id, named_struct('name', 'pm25', 'units', 'ug/m3') as parameter,
      named_struct('datetimeFrom', named_struct('utc', d)) as period, cast(v as float) as value
      from values ('2024-01-09T23:00:00Z', 1), ('2024-01-10T00:00:00Z', 2), (null, 3) as t(d, v)""")
    rows = feed_days(raw, dt.date(2024, 1, 10)).collect()
    assert [tuple(r) for r in rows] == [(7, dt.date(2024, 1, 10), "pm25", "ug/m3", 2.0)]


def test_hourly_headers_repeated_quoted_and_same_names(spark, scratch):
    rows = "2020-01-01 00:00:00,1\n2020-01-01 01:00:00,2\n"
    _write(os.path.join(scratch, "a", "S.csv"), f"From Date,CO (mg/m3)\n{rows}From Date,CO (mg/m3)\n"
                                                "2020-01-01 02:00:00,3\n")
    _write(os.path.join(scratch, "b", "S.csv"), '"From Date","note","PM2.5 (ug/m3)"\n'
                                                '"2020-01-02 00:00:00","x, ""y""","5"\n')
    got = sorted((r.station_id, r.ts, r.co, r.pm25) for r in scan_hourly(spark, os.path.join(scratch, "*")).collect())
    assert got == [("S", dt.datetime(2020, 1, 1, h), h + 1.0, None) for h in range(3)] + [
        ("S", dt.datetime(2020, 1, 2), None, 5.0)]


@pytest.mark.parametrize("n", [0, 1])
def test_few_pollutant_columns(spark, n):
    from airlake.operators.attribution import compute_sub_indices
    cols = ["pm25"][:n]
    df = spark.createDataFrame([("X", dt.date(2020, 1, 1), 50.0, *[10.0] * n)],
                               ", ".join(["city string", "date date", "aqi double", *(f"{c} double" for c in cols)]))
    assert compute_sub_indices(df).count() == 0
    sd = spark.createDataFrame([("X", 1, dt.date(2020, 1, 1), *[10.0] * n)],
                               ", ".join(["city string", "station_id long", "date date", *(f"{c} double" for c in cols)]))
    if n:
        assert city_daily(sd).collect()[0].aqi is None
    assert [r.computed_aqi for r in compute_sub_indices(df, min_count=n).collect()] == [10.0 * 50 / 30] * n + [None] * (1 - n)


def test_active_sensors_by_parameter_and_last_seen(spark):
    from airlake.operators import geo

    new, old = dt.datetime(2021, 5, 1), dt.datetime(2020, 12, 31, 23)
    locations = spark.createDataFrame([(1, 10.0, 20.0, new), (2, 10.1, 20.0, new), (3, 10.0, 20.1, old)],
                                      "location_id bigint, lat double, lon double, last_seen timestamp_ntz")
    centers = spark.createDataFrame([("A", 10.0, 20.0)], "city string, lat double, lon double")
    sensors = spark.createDataFrame(
        [(1, 11, "pm25", "ug/m3", new), (1, 12, "temperature", "c", new), (1, 13, "no2", "ppb", old),
         (1, 14, "co", "ppm", dt.datetime(2021, 1, 1)), (1, 15, "o3", "ug/m3", None),
         (2, 21, "humidity", "%", new), (2, 22, "so2", "ppb", old), (3, 31, "pm10", "ug/m3", new)],
        "location_id bigint, sensor_id bigint, param string, unit string, last_seen timestamp_ntz")
    since = dt.datetime(2021, 1, 1)
    got = geo.active_sensors(geo.nearby_sensors(locations, centers, since), sensors, since)
    assert sorted((r.city, r.location_id, r.sensor_id, r.pollutant, r.unit) for r in got.collect()) == [
        ("A", 1, 11, "PM2.5", "ug/m3"), ("A", 1, 14, "CO", "ppm")]


def test_split_by_date_reads_the_source_once(spark, scratch):
    import re

    path = os.path.join(scratch, "in.csv")
    with open(path, "w") as f:
        f.write("City,Date,PM2.5,date_text\nX,2020-01-01,10,own\nX,,1,own\nY,2020-13-45,oops,own\nY,  ,2,own\nY,2020-01-03,NaN,own\n")
    raw = spark.read.option("header", True).csv(path)
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        reads.add(1)
        return text
    split = readers.split_by_date(raw.withColumn("City", seen("City")))
    assert (split.n_good, split.n_rejected) == (2, 3)
    assert sorted((r.city, r.date.day, r.pm25) for r in split.good.collect()) == [("X", 1, 10.0), ("Y", 3, None)]
    assert sorted((r.city, r.date_text or "", r.reason, r.pm25) for r in split.rejected.collect()) == [
        ("X", "", "missing date", 1.0), ("Y", "  ", "missing date", 2.0), ("Y", "2020-13-45", "unparseable date", None)]
    assert reads.value == 5  # every row of the source was parsed once
    with pytest.raises(ValueError, match="3 rows"):
        split.accepted()
    plan = readers.date_checked(raw)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan", plan)) == 1 and "Exchange" not in plan
    assert split.good.columns == load_raw(spark, _csv(scratch, "City,Date\nX,2020-01-01\n")).columns


def _csv(scratch, text):
    path = os.path.join(scratch, "one.csv")
    with open(path, "w") as f:
        f.write(text)
    return path


def test_split_by_date_of_nothing(spark, scratch):
    split = readers.split_by_date(spark.read.option("header", True).csv(_csv(scratch, "City,Date\n")))
    assert (split.n_good, split.n_rejected, split.accepted().count(), split.rejected.count()) == (0, 0, 0, 0)


def test_rerun_replaces_named_cities_only(spark, scratch):
    out = os.path.join(scratch, "curated")
    day = lambda city, n, aqi: dict(city=city, date=f"2024-01-{n:02d}", aqi=aqi)
    write_city_day(city_day(spark, [day("A", 1, 1), day("A", 2, 2), day("B", 1, 3), day("C", 1, 4)]), out)
    kept = {c: sorted(os.listdir(os.path.join(out, f"city={c}"))) for c in "BC"}
    again = city_day(spark, [day("A", 2, 20), day("A", 3, None), day("A", 4, 40), day("B", 9, 99), day("D", 1, 5)])
    report = {r.city: r for r in replace_cities(again, out, ["A", "D", "E"]).collect()}
    assert [(r.n_rows, r.n_with_value, r.pct_with_value) for r in (report[c] for c in "ADE")] == [
        (3, 2, pytest.approx(200 / 3)), (1, 1, 100.0), (0, 0, None)]
    assert (report["A"].first_date, report["A"].last_date) == (dt.date(2024, 1, 2), dt.date(2024, 1, 4))
    rows = {(r.city, r.date.day): r.aqi for r in spark.read.parquet(out).collect()}
    assert rows == {("A", 2): 20, ("A", 3): None, ("A", 4): 40, ("B", 1): 3, ("C", 1): 4, ("D", 1): 5}
    assert kept == {c: sorted(os.listdir(os.path.join(out, f"city={c}"))) for c in "BC"}
    same = {r.city: r for r in replace_cities(again, out, ["A", "D", "E"]).collect()}
    assert same == report and spark.read.parquet(out).count() == 6  # a rerun of the rerun changes nothing
    assert replace_cities(again, out, []).count() == 0


def _records(text):
    """Records of a file, by the state of the quotes at each line's end."""
    out, open_quote = [], False
    for line in text.split("\n"):
        if open_quote:
            out[-1] += "\n" + line
        else:
            out.append(line)
        open_quote ^= line.count('"') % 2 == 1
    return out


def test_whole_records_across_blocks(spark):
    """Any cut of the files into blocks gives the records of the whole file."""
    rng = np.random.default_rng(3)
    files = {}
    for f in range(4):
        words = ["a", "b,c", '"q"', '"x\ny"', '"p\n\nq ""r\n"', "", "7"]
        files[f"f{f}"] = "\n".join(",".join(rng.choice(words, 4)) for _ in range(60))
    want = sorted((f, r) for f, text in files.items() for r in _records(text))
    for size in (1, 3, 7, 1000):
        rows = [(line, f, f + ".csv", i // size, i) for f, text in files.items() for i, line in enumerate(text.split("\n"))]
        df = spark.createDataFrame(rows, "line string, file string, name string, block long, place long").repartition(5)
        got = readers.whole_records(df).collect()
        assert sorted((r.file, r.line) for r in got) == want
        assert len({(r.file, r.place) for r in got}) == len(got)


def test_stray_quote_joins_nothing(spark):
    lines = ['t,v', '1,"a\nb"'.split("\n")[0], 'b"', '2,5" pipe'] + [f"{i},x" for i in range(3, 40)]
    df = spark.createDataFrame([(x, "f", "f.csv", i // 5, i) for i, x in enumerate(lines)],
                               "line string, file string, name string, block long, place long")
    got = {r.line for r in readers.whole_records(df, max_lines=10).collect()}
    assert got == {"t,v", '1,"a\nb"', '2,5" pipe', *lines[4:]}


def test_csv_fields(spark):
    lines = ['a,"b,c", "d ""e"" f" ,', '"x\ny,z",2', "", '"1,5"', "a\x01b,c"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = [r.f for r in df.select(readers.csv_fields(F.col("line")).alias("f")).collect()]
    assert got == [["a", "b,c", 'd "e" f', ""], ["x\ny,z", "2"], [""], ["1,5"], ["a b", "c"]]


def test_scan_hourly_with_line_breaks_and_small_blocks(spark, scratch):
    folder = os.path.join(scratch, "hourly")
    os.makedirs(folder)
    with open(os.path.join(folder, "ST1.csv"), "w") as f:
        f.write('"a ""note""\nover lines",From Date,PM2.5 (ug/m3)\n')
        for i in range(200):
            note = f'"first, {i}\nsecond ""line""\n"' if i % 3 == 0 else "plain"
            f.write(f"{note},2020-01-{i // 24 + 1:02d} {i % 24:02d}:00:00,{i}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        df = scan_hourly(spark, folder)
        assert spark.read.text(folder).rdd.getNumPartitions() > 5
        assert sorted((r.ts.day * 24 + r.ts.hour - 24, r.pm25) for r in df.collect()) == [(i, float(i)) for i in range(200)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
