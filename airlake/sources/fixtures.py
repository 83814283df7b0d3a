"""Fixture views over the driver's tables (see FIXTURES.md).

Each function reads the given parquet tables and derives the inputs the
operators expect, so the work of every query grows with those tables.

Dimension joins: every lookup table is broadcast only when its estimated size
is under ``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks at run time);
otherwise the join is shuffled.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlake.functions.aqi import aqi_bucket, aqi_from_concentrations
from airlake.operators.common import broadcast_if_small, for_cities
from airlake.reference import FESTIVAL_DATES, STATION_SET
from airlake.schema import conform

# Fixture constants (the driver's data sit 20 years earlier than the calendars).
SHIFT_MONTHS = 240
BASE_END = dt.date(2021, 3, 31)          # end of the base source, shifted
BULLETIN_FROM = dt.datetime(2001, 1, 1)  # unshifted order date
ACTIVE_FROM = dt.datetime(2021, 1, 1)    # shifted last-seen cut-off
CITY_NAMES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
CENTERS = (
    ("AFRICA", -6.25, 35.5),
    ("AMERICA", 41.5, -93.75),
    ("ASIA", 30.75, 103.25),
    ("EUROPE", 48.5, 9.25),
    ("MIDDLE EAST", 24.25, 45.5),
)
#: Invented zones of the cities: two whole-hour ones without changes of the
#: clocks, one with a half hour, two with changes.
CITY_ZONES = {"AFRICA": "Africa/Nairobi", "AMERICA": "America/New_York", "ASIA": "Asia/Kolkata",
              "EUROPE": "Europe/Berlin", "MIDDLE EAST": "Asia/Dubai"}
SPREAD_DAYS = 397  # instants are spread over more than a year
SPARSE_MONTHS = (3, 4, 5, 6, 17)


# Schemas of the given tables, stated so that reads skip schema inference
# (a footer-reading job per read) and fail loudly on drift.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


SENSOR_PARAMS = ("pm25", "pm10", "no2", "so2", "co", "o3", "temperature", "relativehumidity")
SENSOR_UNITS = ("ug/m3", "ug/m3", "ppb", "ppb", "ppm", "ug/m3", "c", "%")


def ntz(value: dt.datetime) -> F.Column:
    """A TIMESTAMP_NTZ literal: compares with wall-clock columns whatever the
    session time zone (a Python datetime literal would be zone-aware)."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def _with_region(df: DataFrame, nation_key: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attach the region name as ``city``. Nation (25 rows) and region
    (5 rows) are small dimensions, broadcast behind a check of their size;
    each on its own, so their broadcast stages run concurrently."""
    nation = broadcast_if_small(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    region = broadcast_if_small(table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("city")))
    return (df.join(nation, F.col(nation_key) == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey")))


def station_registry(spark: SparkSession, sf_dir: str, cities: Sequence[str] | None = None) -> DataFrame:
    """(station_id, city): suppliers mapped to their region. Broadcast when
    the supplier projection (which bounds this N:1 lookup) is under the
    broadcast threshold; a shuffled join otherwise."""
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    out = _with_region(sup, "s_nationkey", spark, sf_dir).select(
        F.col("s_suppkey").alias("station_id"), "city")
    out = for_cities(out, cities)
    return broadcast_if_small(out, probe=sup)


def customer_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, city) with the same size-checked broadcast."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    out = _with_region(cust, "c_nationkey", spark, sf_dir).select("c_custkey", "city")
    return broadcast_if_small(out, probe=cust)


def shifted_date(c) -> F.Column:
    return F.add_months(F.to_date(c), SHIFT_MONTHS)


def station_readings(spark: SparkSession, sf_dir: str, until: dt.date | None = None) -> DataFrame:
    """Line items as station readings, keyed by station only (no lookup)."""
    li = table(spark, sf_dir, "lineitem")
    if until is not None:
        # Shifting is monotone, so the cut-off is pushed to the scan unshifted.
        li = li.where(F.col("l_shipdate") < ntz(
            dt.datetime(until.year - 20, until.month, until.day) + dt.timedelta(days=1)))
    return li.selectExpr(
        "l_suppkey AS station_id", f"add_months(to_date(l_shipdate), {SHIFT_MONTHS}) AS date",
        "l_orderkey", "l_linenumber",
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity * 43 / 7 * ("
        "CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 1.5D"
        " WHEN month(l_shipdate) IN (3, 4, 5, 6) THEN 1.0D"
        " WHEN month(l_shipdate) IN (7, 8, 9) THEN 0.4D ELSE 1.8D END) END AS pm25",
        "CASE WHEN l_linenumber = 6 THEN NULL ELSE l_extendedprice / 251 END AS pm10",
        "CASE WHEN l_linenumber IN (5, 6) THEN NULL ELSE l_discount * 30000 / 11 END AS no2",
        "CASE WHEN l_linenumber = 4 THEN NULL ELSE l_tax * 90000 / 11 END AS so2",
        "CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_partkey % 300 AS DOUBLE) * 10 / 11 END AS o3",
        "CASE WHEN l_linenumber = 2 THEN NULL ELSE CAST(l_orderkey % 20 AS DOUBLE) * 10 / 11 END AS co",
        "CASE WHEN l_linenumber = 1 THEN NULL"
        " ELSE CAST((l_orderkey + l_partkey) % 900 AS DOUBLE) * 10 / 11 END AS nh3",
    )


_BASE_POLLUTANTS = ("pm25", "pm10", "no2", "so2", "o3", "co", "nh3")
# Means are rounded to 9 places: a parallel sum is not bit-reproducible, and
# thresholds (AQI > 200, band edges) must not flip between runs or engines.
MEAN_SCALE = 1e9


def _round9(c: F.Column) -> F.Column:
    """floor(x * 1e9 + 0.5) / 1e9: identical IEEE steps in every engine."""
    return F.floor(c * F.lit(MEAN_SCALE) + F.lit(0.5)) / F.lit(MEAN_SCALE)


def region_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("city"))


def base_day(spark: SparkSession, sf_dir: str, until: dt.date | None = None,
             cities: Sequence[str] | None = None) -> DataFrame:
    """City-day table: station-day means, then the unweighted mean of stations.
    All line items are read; only the splice cuts its base source (``until``).
    ``cities``: readings of other cities' stations are dropped by a semi-join
    before the first aggregation.

    ``aqi`` is the mean over stations of the station-day AQI (station input
    set on daily means), so it differs from an AQI recomputed from city means.
    Two aggregations; both have map-side partial aggregation, so a hot city or
    station is combined before the shuffle. Readings are reduced to
    station-days before the station -> city lookup (city is a function of the
    station), so the lookup join sees one row per station-day, and a shuffled
    lookup (when the registry is too big to broadcast) moves aggregated rows.
    """
    raw = station_readings(spark, sf_dir, until)
    if cities is not None:
        wanted = station_registry(spark, sf_dir, cities).select("station_id")
        raw = raw.join(wanted, "station_id", "left_semi")
    sd = raw.groupBy("station_id", "date").agg(
        *[_round9(F.avg(c)).alias(c) for c in _BASE_POLLUTANTS])
    sd = sd.join(station_registry(spark, sf_dir), "station_id")
    sd = sd.withColumn("aqi", aqi_from_concentrations(STATION_SET))
    cd = sd.groupBy("city", "date").agg(
        *[_round9(F.avg(c)).alias(c) for c in _BASE_POLLUTANTS],
        _round9(F.avg("aqi")).alias("aqi"))
    cd = cd.withColumn("aqi_bucket", aqi_bucket("aqi"))
    return conform(cd)


def bulletin_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second source, index only: (date 'dd-MM-yyyy', area, aqi_value text)."""
    o = (table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= ntz(BULLETIN_FROM))
         .select("o_custkey", "o_orderdate", "o_totalprice"))
    cc = customer_city(spark, sf_dir)
    return o.join(cc, o.o_custkey == cc.c_custkey).select(
        F.date_format(shifted_date("o_orderdate"), "dd-MM-yyyy").alias("date"),
        F.col("city").alias("area"),
        (F.col("o_totalprice") / 1000).cast("string").alias("aqi_value"),
    )


def _city_of_user_sql(uid: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(CITY_NAMES))
    return f"CASE {uid} % 5 {whens} END"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sub-daily station readings (city, station_id, ts, event_id, ...)."""
    return readings_from_events(table(spark, sf_dir, "events"))


def readings_from_events(events: DataFrame) -> DataFrame:
    """Batch or streaming events -> readings."""
    e = events.select("event_id", "ts", "user_id", "event_type", "value")
    return e.selectExpr(
        f"{_city_of_user_sql('user_id')} AS city", "user_id % 15 AS station_id", "ts", "event_id",
        "CASE WHEN event_type = 'view' THEN NULL ELSE value END AS pm25",
        "CASE WHEN event_type = 'click' THEN NULL ELSE value * 1.5D END AS pm10",
        "CASE WHEN event_type = 'purchase' THEN NULL ELSE value * 0.8D END AS no2",
        "CASE WHEN event_type = 'signup' THEN NULL ELSE value * 1.2D END AS o3",
        "CASE WHEN event_type = 'error' THEN NULL ELSE value / 20 END AS co",
    )


def sensor_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third source, long form: (city, sensor_id, date, param, unit, value)."""
    e = table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value")
    return e.selectExpr(
        f"{_city_of_user_sql('user_id')} AS city", "user_id AS sensor_id", "to_date(ts) AS date",
        "CASE event_type WHEN 'view' THEN 'pm25' WHEN 'click' THEN 'pm10' WHEN 'purchase' THEN 'no2'"
        " WHEN 'signup' THEN 'o3' ELSE 'co' END AS param",
        "CASE event_type WHEN 'purchase' THEN 'ppb' WHEN 'error' THEN 'ppm' ELSE 'ug/m3' END AS unit",
        "value",
    )


def centers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CENTERS), "city string, lat double, lon double")


#: Invented centres whose radius crosses the 180th meridian and a pole.
EDGE_CENTERS = (("DATELINE", -16.5, 179.95), ("NORTH", 89.9, 10.0))


def edge_centers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EDGE_CENTERS), "city string, lat double, lon double")


def edge_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One location per customer by the 180th meridian (longitudes on both
    sides, -180 to 180) or, every second one, by the North Pole (all
    longitudes), with the latest (shifted) order date as last-seen time."""
    return (table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderdate").alias("last"))
            .selectExpr(
                "k AS location_id",
                "CASE WHEN k % 2 = 0 THEN -16.5D + (k % 101 - 50) / 100D ELSE 89.8D + (k % 21) / 100D END AS lat",
                "CASE WHEN k % 2 = 1 THEN CAST(k * 37 % 360 - 180 AS DOUBLE)"
                " WHEN k * 7 % 101 > 55 THEN -180.05D + (k * 7 % 101 - 50) / 100D"
                " ELSE 179.95D + (k * 7 % 101 - 50) / 100D END AS lon",
                "last + INTERVAL 20 YEARS AS last_seen"))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sensor location per customer around its region's centre, with the
    latest (shifted) order date as last-seen time (NULL without orders)."""
    last = (table(spark, sf_dir, "orders").groupBy("o_custkey")
            .agg(F.max("o_orderdate").alias("last_order")))
    ctr = F.broadcast(centers(spark).select(
        F.col("city").alias("home"), F.col("lat").alias("clat"), F.col("lon").alias("clon")))
    c = (customer_city(spark, sf_dir)
         .join(ctr, F.col("city") == F.col("home"))
         .join(last, F.col("c_custkey") == last.o_custkey, "left"))
    k = F.col("c_custkey")
    return c.select(
        k.alias("location_id"),
        (F.col("clat") + ((k % 101) - 50) / 100.0).alias("lat"),
        (F.col("clon") + (((k * 7) % 101) - 50) / 100.0).alias("lon"),
        (F.col("last_order") + F.expr("INTERVAL 20 YEARS")).alias("last_seen"),
    )


def sensor_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight sensors per location (customer): its orders by o_orderkey
    modulo 8 give parameter, unit and last-seen time (shifted order date). Two
    of the eight parameters are not supported."""
    n = F.col("n")
    return (table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", (F.col("o_orderkey") % 8).alias("n"))
            .groupBy("o_custkey", "n").agg(F.max("o_orderdate").alias("last_order"))
            .select(F.col("o_custkey").alias("location_id"), (F.col("o_custkey") * 8 + n).alias("sensor_id"),
                    F.array(*map(F.lit, SENSOR_PARAMS))[n.cast("int")].alias("param"),
                    F.array(*map(F.lit, SENSOR_UNITS))[n.cast("int")].alias("unit"),
                    (F.col("last_order") + F.expr("INTERVAL 20 YEARS")).alias("last_seen")))


def sparse_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by city, with no value in the planted months: (city, date, v)."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_shipdate")
    ym = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    reg = station_registry(spark, sf_dir)
    return li.join(reg, li.l_suppkey == reg.station_id).select(
        "city", shifted_date("l_shipdate").alias("date"),
        F.when(~(ym % 29).isin(*SPARSE_MONTHS), F.col("l_quantity")).alias("v"))


def festival_calendar(spark: SparkSession) -> DataFrame:
    rows = [(y, dt.date.fromisoformat(d)) for y, d in FESTIVAL_DATES.items()]
    return spark.createDataFrame(rows, "year int, event_date date")


def curated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of a curated file, all text, with planted bad values."""
    e = table(spark, sf_dir, "events")
    return e.selectExpr(
        f"{_city_of_user_sql('user_id')} AS City",
        "CASE WHEN event_id % 13 = 0 THEN 'no date' WHEN event_id % 17 = 0 THEN NULL"
        " ELSE date_format(ts, 'yyyy-MM-dd') END AS Date",
        "CASE WHEN event_id % 7 = 0 THEN 'bad' WHEN event_id % 11 = 0 THEN 'NaN'"
        " ELSE CAST(value AS STRING) END AS `PM2.5`",
        "CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(event_id AS STRING) END AS AQI")


LINES_PER_BLOCK = 301


def hourly_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of station files: two column layouts, quoted fields
    (every 23rd reading's note holds a line break, so it takes two lines, some
    of them in different blocks of the file), a header repeated before the last
    reading, bad numbers and time stamps."""
    e = table(spark, sf_dir, "events")
    lines = e.selectExpr(
        "CAST(user_id % 15 AS STRING) AS file", "event_id", "event_id % 23 = 0 AS broken",
        "CASE WHEN event_id % 19 = 0 THEN 'not a time' ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END AS t",
        "CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE CAST(event_id AS STRING) END AS a",
        "CAST(event_id % 100 AS STRING) AS b", "user_id % 15 % 2 = 0 AS even")
    lines = lines.selectExpr("file", "event_id", "even",
                             "CASE WHEN even AND broken THEN array(concat('\"', t, '\",', a, ',\"1,'), concat('5\",', b))"
                             " WHEN even THEN array(concat('\"', t, '\",', a, ',\"1,5\",', b))"
                             " ELSE array(concat(b, ',', t)) END AS parts")
    lines = lines.selectExpr("file", "event_id", "even", "posexplode(parts) AS (part, line)")
    header = ("CASE WHEN even THEN 'From Date,\"PM2.5 (ug/m3)\",note,Ozone (ug/m3)'"
              " ELSE 'PM10 (ug/m3),From Date' END AS line")
    stations = lines.groupBy("file", "even").agg(F.max("event_id").alias("last"))
    first = stations.selectExpr("file", "CAST(-1 AS BIGINT) AS place", header)
    again = stations.selectExpr("file", "2 * last - 1 AS place", header)
    return (lines.selectExpr("file", "2 * event_id + part AS place", "line").unionByName(first).unionByName(again)
            .withColumn("block", F.floor(F.col("place") / LINES_PER_BLOCK)).withColumn("name", F.concat("file", F.lit(".csv"))))


def feed_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the nested layout of the sensor feed."""
    e = table(spark, sf_dir, "events")
    return e.selectExpr(
        "user_id AS sensor_id", "named_struct('name', event_type, 'units', 'ug/m3') AS parameter",
        "named_struct('datetimeFrom', named_struct('utc', CASE WHEN event_id % 9 = 0 THEN NULL"
        " ELSE concat(date_format(ts, 'yyyy-MM-dd'), 'T00:00:00Z') END)) AS period", "value")


def zone_of(city: F.Column) -> F.Column:
    return F.create_map(*[F.lit(x) for pair in CITY_ZONES.items() for x in pair])[city]


_SPREAD_TS = f"ts + make_dt_interval(CAST(event_id * 7 % {SPREAD_DAYS} AS INT))"


def feed_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the layout of the sensor feed, with times of the day spread
    over more than a year: text with Z, with an offset, without one, or none."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "event_type", "value", f"{_SPREAD_TS} AS ts")
    clock = "date_format({}, \"yyyy-MM-dd'T'HH:mm:ss\")"
    return e.selectExpr(
        f"{_city_of_user_sql('user_id')} AS city", "user_id AS sensor_id",
        "named_struct('name', event_type, 'units', 'ug/m3') AS parameter",
        "named_struct('datetimeFrom', named_struct('utc', CASE WHEN event_id % 9 = 0 THEN NULL"
        f" WHEN event_id % 4 = 0 THEN concat({clock.format('ts + INTERVAL 330 MINUTES')}, '+05:30')"
        f" WHEN event_id % 4 = 1 THEN {clock.format('ts')} ELSE concat({clock.format('ts')}, 'Z') END)) AS period",
        "value")


def local_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as readings of stations whose clocks show their city's time:
    (city, ts, pm25), spread over more than a year."""
    return table(spark, sf_dir, "events").selectExpr(
        f"{_city_of_user_sql('user_id')} AS city", f"{_SPREAD_TS} AS ts",
        "CASE WHEN event_type = 'view' THEN NULL ELSE value END AS pm25")


def registry_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as rows of a station registry file."""
    return _with_region(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", spark,
                        sf_dir).select(F.col("s_suppkey").alias("StationId"), F.col("city").alias("City"))
