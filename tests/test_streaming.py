"""ST1: the streaming daily mean equals the batch aggregate on the same
files, also when the input arrives over several micro-batches."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from airlake.sources import fixtures as X
from airlake.streaming import daily_mean as ST
from conftest import SF_SMALL

POLL = ("pm25", "pm10", "no2", "o3", "co")


def _batch(spark, events):
    b = ST.daily_means(X.readings_from_events(events), POLL)
    return sorted((r.city, r.pollutant, r.date, round(r.mean, 9), r.n)
                  for r in b.select("city", "pollutant", "date", "mean", "n").collect())


def _rows(df):
    return sorted((r.city, r.pollutant, r.date, round(r.mean, 9), r.n) for r in df.collect())


def test_stream_equals_batch(spark):
    src = f"{SF_SMALL}/events*.parquet"
    got = ST.stream_daily_mean(spark, src, X.SCHEMAS["events"], X.readings_from_events, POLL)
    exp = _batch(spark, X.table(spark, SF_SMALL, "events"))
    assert _rows(got) == exp and exp


def test_stream_over_several_batches(spark, scratch):
    # split the events into two files by day; one file per micro-batch
    ev = X.table(spark, SF_SMALL, "events")
    landing = os.path.join(scratch, "landing")
    early = ev.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
    late = ev.where(F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz"))
    early.coalesce(1).write.parquet(os.path.join(scratch, "a"))
    late.coalesce(1).write.parquet(os.path.join(scratch, "b"))
    os.makedirs(landing)
    for i, part in enumerate(("a", "b")):
        f = [x for x in os.listdir(os.path.join(scratch, part)) if x.endswith(".parquet")][0]
        shutil.copy(os.path.join(scratch, part, f), os.path.join(landing, f"part-{i}.parquet"))
    stream = (spark.readStream.schema(X.SCHEMAS["events"]).option("maxFilesPerTrigger", 1)
              .parquet(landing))
    agg = ST.daily_means(X.readings_from_events(stream), POLL)
    run = ST.run_to_table(agg)
    assert spark.read.parquet(run.table).select("batch_id").distinct().count() >= 2 and run.late_rows == 0
    out = ST.latest(spark, run.table, ST.RESULT).select("city", "pollutant", "date", "mean", "n")
    assert _rows(out) == _batch(spark, ev)


def _landing(spark, scratch, *frames):
    """One parquet file per frame, to be put into the landing folder in turn."""
    files = []
    for i, df in enumerate(frames):
        out = os.path.join(scratch, f"part{i}")
        df.coalesce(1).write.parquet(out)
        files.append(os.path.join(out, next(x for x in os.listdir(out) if x.endswith(".parquet"))))
    return files


def test_second_run_reads_only_new_files(spark, scratch):
    ev = X.table(spark, SF_SMALL, "events")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    files = _landing(spark, scratch, ev.where(F.col("ts") < cut), ev.where(F.col("ts") >= cut))
    landing, root = os.path.join(scratch, "landing"), os.path.join(scratch, "state")
    os.makedirs(landing)

    def run():
        stream = spark.readStream.schema(X.SCHEMAS["events"]).parquet(landing)
        return ST.run_to_table(ST.daily_means(X.readings_from_events(stream), POLL), root)
    read = []
    for i, f in enumerate(files):
        shutil.copy(f, os.path.join(landing, f"{i}.parquet"))
        read.append(run().input_rows)
    assert read == [spark.read.parquet(f).count() for f in files]
    assert run().input_rows == 0
    out = ST.latest(spark, f"{root}/table", ST.RESULT).select("city", "pollutant", "date", "mean", "n")
    assert _rows(out) == _batch(spark, ev)


def test_late_rows_are_dropped_and_counted(spark, scratch):
    ev = X.table(spark, SF_SMALL, "events")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    files = _landing(spark, scratch, ev.where(F.col("ts") >= cut), ev.where(F.col("ts") < cut))
    landing, root = os.path.join(scratch, "landing"), os.path.join(scratch, "state")
    os.makedirs(landing)
    late = 0
    for i, f in enumerate(files):
        shutil.copy(f, os.path.join(landing, f"{i}.parquet"))
        stream = spark.readStream.schema(X.SCHEMAS["events"]).parquet(landing)
        late += ST.run_to_table(ST.daily_means(X.readings_from_events(stream), POLL), root).late_rows
    assert late > 0


def test_unreadable_table_is_an_error(spark, scratch):
    assert ST.latest(spark, os.path.join(scratch, "none"), ST.RESULT).count() == 0
    bad = os.path.join(scratch, "bad", "batch_id=0")
    os.makedirs(bad)
    with open(os.path.join(bad, "part-0.parquet"), "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):
        ST.latest(spark, os.path.join(scratch, "bad"), ST.RESULT).collect()


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_days_do_not_depend_on_session_zone(spark, zone):
    from airlake.plans import registry
    from airlake.plans.check import compare, duck
    con = duck(SF_SMALL)
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for key in ("stream_daily_mean", "splice_sources", "nearby_sensors"):
            ok, msg = compare(registry.all_queries()[key](spark, SF_SMALL), con, registry.all_oracle()[key])
            assert ok, f"{zone} {key}: {msg}"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def _reading_schema():
    return "city string, station_id long, ts timestamp_ntz, event_id long, o3 double"


def _readings(spark, rows):
    import datetime as dt
    return spark.createDataFrame([("C", 1, dt.datetime(2024, 1, day, hour), i, float(v))
                                  for i, (day, hour, v) in enumerate(rows)], _reading_schema())


def test_append_emits_each_day_once_when_it_closes(spark, scratch):
    """Days 2 and 3 are open after run 1. Run 2 adds to day 3, closes both and
    brings a late row for day 1, which changes nothing; run 3 has no new file."""
    files = _landing(spark, scratch,
                     _readings(spark, [(1, 8, 10), (1, 9, 20), (2, 8, 5), (3, 20, 1), (4, 12, 7)]),
                     _readings(spark, [(1, 10, 999), (3, 21, 3), (9, 0, 4)]))
    landing, root = os.path.join(scratch, "landing"), os.path.join(scratch, "state")
    os.makedirs(landing)

    def run():
        stream = spark.readStream.schema(_reading_schema()).parquet(landing)
        out = ST.append_closed(ST.daily_means(stream, ["o3"], "2 days"), root)
        return out, [(r.date.day, r.mean, r.n) for r in ST.closed(spark, out.table, ST.RESULT).orderBy("date").collect()]

    shutil.copy(files[0], os.path.join(landing, "0.parquet"))
    first, rows = run()
    assert rows == [(1, 15.0, 2)]  # watermark: 2 January, 12:00
    assert (first.input_rows, first.late_rows, first.open_groups) == (5, 0, 3)
    before = {f for f in os.listdir(first.table) if f.endswith(".parquet")}

    shutil.copy(files[1], os.path.join(landing, "1.parquet"))
    second, rows = run()
    assert rows == [(1, 15.0, 2), (2, 5.0, 1), (3, 2.0, 2), (4, 7.0, 1)]
    assert (second.input_rows, second.late_rows, second.open_groups) == (3, 1, 1)  # the ninth stays open
    assert before < {f for f in os.listdir(second.table) if f.endswith(".parquet")}  # nothing rewritten

    third, again = run()
    assert again == rows and third.input_rows == 0


def test_append_equals_closed_days_of_the_batch(spark):
    got = ST.stream_closed_days(spark, f"{SF_SMALL}/events*.parquet", X.SCHEMAS["events"], X.readings_from_events, POLL)
    ev = X.table(spark, SF_SMALL, "events")
    newest = ev.agg(F.max("ts")).first()[0]
    import datetime as dt
    want = [r for r in _batch(spark, ev) if dt.datetime.combine(r[2], dt.time()) + dt.timedelta(days=3) <= newest]
    assert _rows(got) == want and want


def test_append_without_a_file(spark, scratch):
    os.makedirs(os.path.join(scratch, "none"))
    got = ST.stream_closed_days(spark, os.path.join(scratch, "none"), X.SCHEMAS["events"], X.readings_from_events, POLL)
    assert got.count() == 0
