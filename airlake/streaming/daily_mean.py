"""Incremental daily mean per (city, pollutant) from a landing folder of
readings (ST1).

``readStream`` file source -> long form -> event-time watermark -> 1-day
tumbling windows -> ``update`` output through ``foreachBatch`` into a table
with one partition per micro-batch. A batch that is written again after a
failure replaces its own partition; reading the table back keeps the newest row
per key. Progress and table live in the folder the caller names, so a later
run with the same folder reads only new files and updates the same table; the
default is a new folder under the shared ``spark.checkpoint.dir``.

``append_closed`` is the other form: output mode ``append`` into Spark's
exactly-once file sink. A day comes out once, when the watermark has passed its
end, and its state is dropped then; days still open stay in the state and come
out in a later run with the same folder. Nothing is ever rewritten, so readers
may take new files as they come.

Rows older than the watermark (``watermark`` behind the newest event time of
the batches before) are dropped, as in any windowed stream; ``Run.late_rows``
reports how many. Within one micro-batch nothing is late.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlake.session import ensure_checkpoint_dir


def event_time(ts: str, zone: str) -> F.Column:
    """Wall-clock ``timestamp_ntz`` -> TIMESTAMP whose UTC reading is that wall
    clock, so UTC-aligned day windows are the wall-clock days whatever the
    session zone (watermarks need TIMESTAMP)."""
    # cast reads the wall clock in the session zone; from_utc_timestamp then
    # moves that instant so its UTC reading is the original wall clock
    return F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone)


def daily_means(readings: DataFrame, pollutants: Sequence[str], watermark: str = "2 days",
                ts: str = "ts") -> DataFrame:
    """Streaming or batch: (city, pollutant, day window) -> mean, n."""
    zone = readings.sparkSession.conf.get("spark.sql.session.timeZone")
    long = (readings.unpivot(["city", ts], list(pollutants), "pollutant", "value")
            .where(F.col("value").isNotNull()).withColumn("_et", event_time(ts, zone)))
    if readings.isStreaming:
        long = long.withWatermark("_et", watermark)
    g = long.groupBy(F.window("_et", "1 day").alias("win"), "city", "pollutant").agg(
        F.avg("value").alias("mean"), F.count("value").alias("n"))
    # back: the window start's UTC reading is the wall-clock day
    return g.withColumn("date", F.to_date(F.to_utc_timestamp(F.col("win.start"), zone)))


class Run(NamedTuple):
    table: str       # partitioned by batch_id
    late_rows: int   # dropped behind the watermark by this run (summed rows, as Spark counts them)
    input_rows: int  # read by this run
    open_groups: int = 0  # (city, pollutant, day) still in the state


def _drain(writer, base: str) -> tuple[int, int, int]:
    """Run an available-now stream to its end: late rows, rows read, groups left in the state."""
    q = writer.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    progress = q.recentProgress
    states = [op for p in progress for op in p["stateOperators"]]
    return (sum(op["numRowsDroppedByWatermark"] for op in states), sum(p["numInputRows"] for p in progress),
            states[-1]["numRowsTotal"] if states else 0)


def _base(spark: SparkSession, root: str | None) -> str:
    return (root or f"{ensure_checkpoint_dir(spark)}/airlake-stream-{uuid.uuid4().hex}").rstrip("/")


def run_to_table(agg: DataFrame, root: str | None = None) -> Run:
    """Drain the stream (available-now trigger) into a parquet table of updates
    under ``root``; a later call with the same ``root`` goes on from there."""
    base = _base(agg.sparkSession, root)
    table = f"{base}/table"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return Run(table, *_drain(agg.writeStream.outputMode("update").foreachBatch(write), base))


def append_closed(agg: DataFrame, root: str | None = None) -> Run:
    """Drain the stream into a parquet table of closed days under ``root``, each
    written once; a later call with the same ``root`` goes on from there, with
    the days left open in the state."""
    base = _base(agg.sparkSession, root)
    table = f"{base}/closed"
    return Run(table, *_drain(agg.writeStream.outputMode("append").format("parquet").option("path", table), base))


def _written(spark: SparkSession, table: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def closed(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """All closed days so far; none if the stream never had a batch."""
    return spark.read.schema(schema).parquet(table) if _written(spark, table) else spark.createDataFrame([], schema)


def latest(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """Newest update per (window, city, pollutant). A table that was never
    written (empty stream) has no rows; any other read failure is raised."""
    if not _written(spark, table):
        return spark.createDataFrame([], schema)
    t = spark.read.schema(f"{schema}, batch_id long").parquet(table)
    w = Window.partitionBy("date", "city", "pollutant").orderBy(F.desc("batch_id"))
    return t.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") == 1).drop("_rk", "batch_id")


RESULT = ("win struct<start:timestamp,end:timestamp>, city string, pollutant string, mean double, n long, "
          "date date")


def stream_daily_mean(spark: SparkSession, source: str, schema, to_readings: Callable[[DataFrame], DataFrame],
                      pollutants: Sequence[str], watermark: str = "2 days", root: str | None = None) -> DataFrame:
    """Daily means over all files of ``source`` so far; with a ``root`` from an
    earlier run only new files are read."""
    stream = spark.readStream.schema(schema).parquet(source)
    run = run_to_table(daily_means(to_readings(stream), pollutants, watermark), root)
    return latest(spark, run.table, RESULT).select("city", "pollutant", "date", "mean", "n")


def stream_closed_days(spark: SparkSession, source: str, schema, to_readings: Callable[[DataFrame], DataFrame],
                       pollutants: Sequence[str], watermark: str = "2 days", root: str | None = None) -> DataFrame:
    """Means of the days of ``source`` that the watermark has closed so far
    (append output); with a ``root`` from an earlier run only new files are
    read, and days that were open then are completed."""
    stream = spark.readStream.schema(schema).parquet(source)
    run = append_closed(daily_means(to_readings(stream), pollutants, watermark), root)
    return closed(spark, run.table, RESULT).select("city", "pollutant", "date", "mean", "n")
