"""Scans (S1-S4, S6-S8, S10) with explicit conformance: typed parsing with
``try_*`` functions (ANSI-safe), NaN -> NULL, canonical names.

Everything is lazy except the gate the data contract asks for (a bad date in
the curated table is an error): ``split_by_date`` reads the source once, and
while it stages the parsed rows in the shared checkpoint folder it parts them
from the rejected ones and counts both; later steps read the staged table.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence
from typing import NamedTuple

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airlake.functions.zones import local_day, utc_clock
from airlake.operators.quality import filter_cities
from airlake.schema import CITY_DAY_COLUMNS, CITY_DAY_RENAME, CITY_DAY_SCHEMA, HOURLY_RENAME, conform, nan_to_null
from airlake.session import cut_lineage, ensure_checkpoint_dir


def _read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    if fmt == "csv":
        # all columns as text; typed parsing below is explicit (no inference)
        return spark.read.option("header", True).option("inferSchema", False).csv(path)
    return spark.read.format(fmt).load(path)


def load_raw(spark: SparkSession, path: str, fmt: str = "csv", date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Curated city-day table (S1): canonical names, parsed date, numbers as
    doubles (bad text -> NULL, NaN -> NULL). Fails, with the count, if any
    date is missing or does not parse. Sorting is left to the output (``orderBy`` there)."""
    return split_by_date(_read(spark, path, fmt), date_format).accepted()


class DateSplit(NamedTuple):
    """Parsed rows, parted by whether their date could be read."""
    good: DataFrame       # the city-day schema
    rejected: DataFrame   # date_text, reason, then the city-day schema without a date
    n_good: int
    n_rejected: int

    def accepted(self) -> DataFrame:
        """``good``, or an error with the count if any row was rejected."""
        if self.n_rejected:
            raise ValueError(f"{self.n_rejected} rows have an unparseable date.")
        return self.good


def split_by_date(raw: DataFrame, date_format: str = "yyyy-MM-dd", folder: str | None = None) -> DateSplit:
    """Rows of text in the curated layout, parsed and parted in one pass: the
    source is scanned once, by the map-only job that writes good and rejected
    rows to separate folders of a table under ``folder`` (default: the shared
    checkpoint folder) and counts both while it writes. An empty or blank date
    is missing; rejected rows keep the text of their date."""
    spark = raw.sparkSession
    folder = (folder or f"{ensure_checkpoint_dir(spark)}/airlake-parsed-{uuid.uuid4().hex}").rstrip("/")
    counts = Observation()
    rows = date_checked(raw, date_format).observe(
        counts, F.count_if(F.col("reason").isNull()).alias("good"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))
    rows = rows.withColumn("accepted", F.col("reason").isNull())
    rows.write.mode("overwrite").partitionBy("accepted").parquet(folder)
    staged = spark.read.schema(rows.schema).parquet(folder)
    good = staged.where("accepted").drop("accepted", "date_text", "reason")
    rejected = staged.where("not accepted").drop("accepted", "date")
    columns = [c for c in rejected.columns if c not in ("date_text", "reason")]
    return DateSplit(good, rejected.select("date_text", "reason", *columns), counts.get["good"], counts.get["rejected"])


def date_checked(raw: DataFrame, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """``parse_city_day`` with ``date_text``, the text of the date, and
    ``reason``: why there is no date (NULL where there is one)."""
    missing = F.coalesce(F.trim("date_text") == "", F.lit(True))
    reason = F.when(missing, "missing date").otherwise("unparseable date")
    typed = parse_city_day(raw, date_format, with_text=True)
    return typed.withColumn("reason", F.when(F.col("date").isNull(), reason))


def parse_city_day(raw: DataFrame, date_format: str = "yyyy-MM-dd", with_text: bool = False) -> DataFrame:
    """Rows of text in the curated layout -> the city-day schema; dates that
    are missing or do not parse become NULL. ``with_text`` adds their text."""
    names = {c: CITY_DAY_RENAME.get(c, c) for c in raw.columns}
    typed = raw.select([F.col(f"`{c}`").alias(n) for c, n in names.items() if n in CITY_DAY_COLUMNS])
    text = F.col("date").cast("string") if "date" in typed.columns else F.lit(None).cast("string")
    typed = typed.withColumn("date_text", text)
    typed = typed.withColumn("date", F.try_to_date(F.col("date_text"), date_format))
    for c in typed.columns:
        if c not in ("city", "date", "aqi_bucket", "date_text"):
            typed = typed.withColumn(c, F.col(c).cast("string").try_cast("double"))
    extra = ["date_text"] if with_text else []
    return nan_to_null(conform(typed, (*CITY_DAY_COLUMNS, *extra), T.StructType([
        *CITY_DAY_SCHEMA.fields, *(T.StructField(c, T.StringType()) for c in extra)])))


def load_clean(spark: SparkSession, path: str, cities: Sequence[str], fmt: str = "csv") -> DataFrame:
    """S1 then the city filter (S2); no imputation."""
    return filter_cities(load_raw(spark, path, fmt), cities, strict=True)


def load_recent(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Recent-source table (S7), wide (City, Date, pollutants, AQI): same
    conformance as the curated table. A missing path fails the read (Spark
    raises PATH_NOT_FOUND), as the source is required."""
    return load_raw(spark, path, fmt)


def first_readable(spark: SparkSession, paths: Sequence[str], fmt: str = "csv", needs: Sequence[str] = ()) -> str:
    """First path, in the order given, that can be read (S10): it is listed,
    its first row is decoded in ``fmt``, and it has the columns ``needs``.
    What is missing, unreadable, damaged or of another layout is passed over;
    the reasons are told when none is left."""
    reasons = []
    for p in paths:
        try:
            probe = _read(spark, p, fmt)
            probe.head(1)
        except (PySparkException, Py4JError) as e:
            reasons.append(f"{p}: {str(e).strip().splitlines()[0]}")
            continue
        lacking = [c for c in needs if c not in probe.columns]
        if not lacking:
            return p
        reasons.append(f"{p}: lacks {lacking}")
    raise FileNotFoundError("no readable path: " + "; ".join(reasons))


#: A quote left open over more lines than this is a stray mark, not a field with line breaks.
MAX_RECORD_LINES = 1000


def scan_hourly(spark: SparkSession, folder: str, ts_header: str = "From Date",
                rename: dict[str, str] = HOURLY_RENAME) -> DataFrame:
    """Hourly station files (S3): one CSV per station, any subset of the known
    columns. Read line-parallel as text with the file path and file block; each
    file's header is its first record that names the timestamp column, and is
    joined back by path, so files with different columns need no per-file driver
    loop. Header records repeated further down are no readings. Quoted fields
    may hold commas and line breaks (``whole_records``). Files without the
    timestamp column yield no rows; bad timestamps are dropped; numbers are
    coerced (bad text -> NULL). Output: station_id (file name without
    extension), ts, reading_id (a stable tie-break for duplicate timestamps),
    pollutants.
    """
    meta = F.col("_metadata")
    return parse_hourly(spark.read.text(folder).select(
        F.col("value").alias("line"), meta["file_path"].alias("file"), meta["file_name"].alias("name"),
        meta["file_block_start"].alias("block"),
        F.struct(meta["file_block_start"], F.monotonically_increasing_id()).alias("place")), ts_header, rename)


def whole_records(lines: DataFrame, max_lines: int = MAX_RECORD_LINES) -> DataFrame:
    """Lines (line, file, name, block, place) -> records, the same columns:
    lines are joined, with a line break, while a quote is open.

    Files stay split. Whether a quote is open at a line follows from the quotes
    of its block before it and of the blocks before that; each block tells its
    number of quotes (odd or even) and how many records would begin in it in
    either case, and a window over the blocks of a file (one row each) carries
    this on. Lines that are records of their own, nearly all, are not grouped;
    the others meet by (file, block, number) of the record they belong to. A
    quote that stays open over more than ``max_lines`` lines joins nothing.
    The numbered lines are checkpointed: the files are read once.
    """
    in_block = Window.partitionBy("file", "block").orderBy("place")
    earlier = in_block.rowsBetween(Window.unboundedPreceding, -1)
    until = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    odd = (F.length("line") - F.length(F.replace("line", F.lit('"')))) % 2
    lines = lines.select("line", "file", "name", "block", "place", odd.alias("_odd"))
    lines = lines.withColumn("_open", F.coalesce(F.sum("_odd").over(earlier), F.lit(0)) % 2)
    begun = lambda state: F.count_if(F.col("_open") == state).over(until)
    lines = cut_lineage(lines.withColumn("_begun0", begun(0)).withColumn("_begun1", begun(1)))  # read often below

    blocks = lines.groupBy("file", "block").agg(
        (F.sum("_odd") % 2).alias("_flips"), F.count_if(F.col("_open") == 0).alias("_begin0"),
        F.count_if(F.col("_open") == 1).alias("_begin1"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_carried", F.coalesce(F.sum("_flips").over(before), F.lit(0)) % 2)
    number = F.when(F.col("_carried") == 0, F.col("_begin0")).otherwise(F.col("_begin1"))
    owner = F.when(number > 0, F.struct(F.col("block").alias("block"), number.alias("number")))
    blocks = blocks.select("file", "block", "_carried", F.last(owner, ignorenulls=True).over(before).alias("_last"))

    lines = lines.join(blocks, ["file", "block"])
    lines = lines.withColumn("_number", F.when(F.col("_carried") == 0, F.col("_begun0")).otherwise(F.col("_begun1")))
    lines = lines.withColumn("_open", (F.col("_open") + F.col("_carried")) % 2)
    columns = ["line", "file", "name", "block", "place"]
    alone = (F.col("_open") == 0) & (F.col("_odd") == 0)
    own = F.struct(F.col("block").alias("block"), F.col("_number").alias("number"))
    parts = lines.where(~alone).withColumn("_record", F.when(F.col("_number") > 0, own).otherwise(F.col("_last")))
    sizes = parts.groupBy("file", "_record").agg(F.count(F.lit(1)).alias("_size"))
    parts = parts.join(sizes, ["file", "_record"])
    joined = parts.where(F.col("_size") <= max_lines).groupBy("file", "_record").agg(
        F.sort_array(F.collect_list(F.struct("place", "line", "block", "name"))).alias("_parts"))
    joined = joined.select(F.array_join("_parts.line", "\n").alias("line"), "file", F.col("_parts")[0]["name"].alias("name"),
                           F.col("_parts")[0]["block"].alias("block"), F.col("_parts")[0]["place"].alias("place"))
    return (lines.where(alone).select(columns).unionByName(joined)
            .unionByName(parts.where(F.col("_size") > max_lines).select(columns)))


def parse_hourly(lines: DataFrame, ts_header: str = "From Date",
                 rename: dict[str, str] = HOURLY_RENAME) -> DataFrame:
    """The lines of station files (line, file, name, block: part of a file,
    place: their order within the file) -> readings; see ``scan_hourly``."""
    records = whole_records(lines).withColumn("fields", csv_fields(F.col("line")))
    is_header = F.array_contains("fields", ts_header)
    headers = records.where(is_header).groupBy("file").agg(F.min_by("fields", "place").alias("hdr"))
    # one header row per file: left to the planner and to AQE, which sizes it
    # as it is and not as the whole folder
    body = records.where(~is_header).join(headers, "file")

    def field(name: str) -> F.Column:
        pos = F.array_position("hdr", name)
        return F.when(pos > 0, F.try_element_at("fields", pos.cast("int")))

    ts = F.try_to_timestamp(F.trim(field(ts_header)))
    cols = [F.trim(field(src)).try_cast("double").alias(dst) for src, dst in rename.items()]
    out = body.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("station_id"),
                      ts.cast("timestamp_ntz").alias("ts"),
                      F.xxhash64("file", "line").alias("reading_id"), *cols)
    return nan_to_null(out.where(F.col("ts").isNotNull()))


def csv_fields(line: F.Column) -> F.Column:
    """Fields of one CSV record: split at commas outside quotes, quotes taken
    off. Cut at the quotes first: every second part is outside, and only there
    do commas become the mark (U+0001) that the record is split at."""
    mark = "\x01"
    parts = F.transform(F.split(F.translate(line, mark, " "), '"', -1),
                        lambda p, i: F.when(i % 2 == 0, F.translate(p, ",", mark)).otherwise(p))
    return F.transform(F.split(F.array_join(parts, '"'), mark, -1), lambda p: F.regexp_replace(
        F.regexp_replace(p, r'(?s)^\s*"(.*)"\s*$', "$1"), '""', '"'))


def station_registry_csv(spark: SparkSession, path: str, cities: Sequence[str]) -> DataFrame:
    """Station registry (S4): (station_id, city) for the target cities."""
    s = _read(spark, path, "csv")
    return (s.select(F.col("StationId").alias("station_id"), F.col("City").alias("city"))
            .where(F.col("city").isin(list(cities))))


def attach_city(readings: DataFrame, registry: DataFrame) -> DataFrame:
    """Station -> city lookup (J3) as an equi-join; the planner broadcasts
    the registry when its measured size is under the broadcast threshold."""
    return readings.join(registry, "station_id")


def feed_days(raw: DataFrame, start: dt.date, zone: str | F.Column | None = None) -> DataFrame:
    """Sensor-day feed rows (S8) with nested API fields, kept from ``start``
    on. Input columns: sensor_id, parameter {name, units}, period
    {datetimeFrom {utc}}, value. The day is the first ten characters of the UTC
    start time or, with ``zone`` (a name, or a column of ``raw``), the day of
    that instant there; a start time that cannot be read has no day."""
    began = F.col("period.datetimeFrom.utc")
    day = F.to_date(F.substring(began, 1, 10)) if zone is None else local_day(utc_clock(began), zone)
    return raw.select(
        "sensor_id", day.alias("date"), F.col("parameter.name").alias("param"),
        F.col("parameter.units").alias("unit"), F.col("value").cast("double").alias("value"),
    ).where(F.col("date") >= F.lit(start))
