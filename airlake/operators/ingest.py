"""Ingest: raw readings -> station-day -> city-day (S3, W1, T1, A4, J3, A5),
and the sensor feed (S8, P8, A6, P10 guard).

Row-based rolling mean (W1), split for skew
-------------------------------------------
The 8-reading trailing mean must follow each station's reading order, but a
window partitioned by station alone puts a whole station in one task (a hot
station may hold a third of all rows). Readings are cut into chunks of an hour
instead and read once:

1. One window pass per (station, hour) gives the trailing mean of every
   reading that has its full 8-row frame inside its chunk. The aggregate over
   the same partitioning keeps, per chunk, the largest of these, sums and
   counts for the daily means, and the first and last 7 readings as arrays.
2. A window over the chunk table (one row per station and hour) hands every
   chunk the last 7 readings before it; the frames of its own first 7 readings
   are evaluated on these short arrays.
3. Chunks roll up to days.

The result equals a station-wide row window exactly, with parallelism of
stations x hours instead of stations, one scan and one shuffle of the readings.

Time-based rolling mean (``frame="8 hours"``)
---------------------------------------------
The frame of a reading at t holds the readings in (t - 8 h, t], so missing hours
narrow it instead of widening it, and the number of rows that earlier chunks
contribute is not fixed. Chunks are an eighth of the frame. The frame of a
reading then covers its own chunk up to t, the seven chunks before it whole, and
the end of the eighth one. A station's readings are dealt by (station, chunk):
each also stands, one frame later, in the chunk where its frame end lies, and
whole chunks contribute one sum to each of the seven that follow. No window
spans more than one chunk, however many readings a station has.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlake.functions.aqi import aqi_bucket, aqi_from_concentrations, n_available
from airlake.functions.units import convert_units
from airlake.functions.zones import day_hours, local_clock
from airlake.reference import FEED_PARAMS, FEED_SET, MIN_SUB_INDICES, STATION_SET, col_of


def rolling_daily_max(readings: DataFrame, cols: Sequence[str], rows: int = 8, min_rows: int = 6,
                      key: str = "station_id", ts: str = "ts", tiebreak: str = "event_id",
                      means: Sequence[str] = (), carry: Sequence[str] = (),
                      chunk: str = "hour", frame: str = "rows") -> DataFrame:
    """Per (key, day): max over the day's readings of the ``rows``-reading
    trailing mean (NULL unless ``min_rows`` values are present). Row-based:
    missing hours widen the window, which crosses midnight. Daily means of
    ``means`` come out of the same aggregate; ``carry`` columns must be
    functions of ``key``. ``chunk``: a ``date_trunc`` unit of a day at most;
    results do not depend on it.

    ``frame``: ``"rows"``, or a length of time such as ``"8 hours"`` for the
    trailing mean over that time (see the module note), for which ``rows``,
    ``tiebreak`` and ``chunk`` have no meaning: readings of one time stamp all
    belong to each other's frame, readings without one to none.
    """
    if frame != "rows":
        return _rolling_daily_max_time(readings, cols, _micros(frame), min_rows, key, ts, means, carry)
    look = rows - 1
    used = list(dict.fromkeys([*cols, *means]))
    r = readings.select(*carry, key, ts, tiebreak, *used).withColumn("_chunk", F.date_trunc(chunk, F.col(ts)))
    part = Window.partitionBy(key, "_chunk")
    ordered = part.orderBy(ts, tiebreak)
    frame = ordered.rowsBetween(-look, 0)
    x = r.select(
        *carry, key, "_chunk", *used,
        F.row_number().over(ordered).alias("_rn"), F.count(F.lit(1)).over(part).alias("_cnt"),
        *[F.when(F.count(c).over(frame) >= min_rows, F.avg(c).over(frame)).alias(f"_r_{c}") for c in cols])
    reading = F.struct("_rn", *cols)
    chunks = x.groupBy(key, "_chunk", *carry).agg(
        *[F.sum(m).alias(f"_s_{m}") for m in means], *[F.count(m).alias(f"_n_{m}") for m in means],
        *[F.max(F.when(F.col("_rn") > look, F.col(f"_r_{c}"))).alias(f"_in_{c}") for c in cols],
        F.array_sort(F.collect_list(F.when(F.col("_rn") <= look, reading))).alias("_head"),
        F.array_sort(F.collect_list(F.when(F.col("_rn") > F.col("_cnt") - look, reading))).alias("_tail"))
    # every chunk has a reading, so the last ``look`` ones lie in as many chunks
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(-look, -1)
    c = chunks.withColumn("_before", F.flatten(F.collect_list("_tail").over(earlier)))
    c = c.withColumn("_before", F.when(F.size("_before") > look, F.slice("_before", -look, look))
                     .otherwise(F.col("_before")))
    c = c.withColumn("_seen", F.concat("_before", "_head"))

    def head_max(name: str) -> F.Column:
        def trailing(i):
            at = F.size("_before") + i
            begin = F.greatest(at - look, F.lit(0))
            values = F.filter(F.transform(F.slice("_seen", begin + 1, at - begin + 1), lambda s: s[name]),
                              lambda v: v.isNotNull())
            return F.when(F.size(values) >= min_rows,
                          F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values))
        return F.array_max(F.transform(F.sequence(F.lit(0), F.size("_head") - 1), trailing))

    days = c.select(*carry, key, F.to_date("_chunk").alias("date"), *[f"_s_{m}" for m in means],
                    *[f"_n_{m}" for m in means],
                    *[F.greatest(f"_in_{n}", head_max(n)).alias(f"_max_{n}") for n in cols])
    return days.groupBy(*carry, key, "date").agg(
        *[F.try_divide(F.sum(f"_s_{m}"), F.sum(f"_n_{m}")).alias(m) for m in means],
        *[F.max(f"_max_{n}").alias(f"{n}_8h") for n in cols])


_UNIT_MICROS = {"minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}
CHUNKS_PER_FRAME = 8


def _micros(frame: str) -> int:
    """``"8 hours"`` -> microseconds."""
    m = re.fullmatch(r"\s*(\d+)\s+(minute|hour|day)s?\s*", frame)
    if not m or not int(m[1]):
        raise ValueError(f"frame must be 'rows' or a length of time such as '8 hours', not {frame!r}")
    return int(m[1]) * _UNIT_MICROS[m[2]]


def wall_micros(ts: str) -> F.Column:
    """Microseconds of a wall-clock time stamp since 1970, whatever the session zone."""
    return F.expr(f"datediff(to_date({ts}), date'1970-01-01') * 86400000000L + hour({ts}) * 3600000000L"
                  f" + minute({ts}) * 60000000L + cast(extract(second from {ts}) * 1000000 as bigint)")


def _rolling_daily_max_time(readings: DataFrame, cols: Sequence[str], width: int, min_rows: int, key: str,
                            ts: str, means: Sequence[str], carry: Sequence[str]) -> DataFrame:
    size = width // CHUNKS_PER_FRAME  # _micros gives multiples
    used = list(dict.fromkeys([*cols, *means]))
    r = readings.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        *carry, key, F.to_date(ts).alias("date"), wall_micros(ts).alias("_t"), *used)
    in_chunk = F.floor(F.col("_t") / size)

    # sums of whole chunks, handed to the chunks whose frames cover them
    whole = r.groupBy(key, in_chunk.alias("_chunk")).agg(
        *[F.sum(c).alias(f"_s_{c}") for c in cols], *[F.count(c).alias(f"_n_{c}") for c in cols])
    offsets = F.explode(F.sequence(F.lit(1), F.lit(CHUNKS_PER_FRAME - 1)))
    whole = whole.withColumn("_offset", offsets).groupBy(key, (F.col("_chunk") + F.col("_offset")).alias("_chunk")).agg(
        *[F.sum(f"_s_{c}").alias(f"_ws_{c}") for c in cols], *[F.sum(f"_n_{c}").alias(f"_wn_{c}") for c in cols])

    # a reading in its own chunk, and again where the frames that begin after it end
    twice = F.explode(F.array(F.lit(0), F.lit(width)))
    x = (r.withColumn("_shift", twice).withColumn("_t", F.col("_t") + F.col("_shift"))
         .withColumn("_own", F.col("_shift") == 0).withColumn("_chunk", in_chunk))
    part = Window.partitionBy(key, "_chunk")
    until = part.orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = part.orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, -1)
    own, old = (lambda c: F.when(F.col("_own"), F.col(c))), (lambda c: F.when(~F.col("_own"), F.col(c)))
    x = x.select(*carry, key, "_chunk", "date", "_own", *used, *[
        e for c in cols for e in (F.sum(own(c)).over(until).alias(f"_us_{c}"), F.count(own(c)).over(until).alias(f"_un_{c}"),
                                  F.sum(old(c)).over(after).alias(f"_as_{c}"), F.count(old(c)).over(after).alias(f"_an_{c}"))])
    x = x.where("_own").join(whole, [key, "_chunk"], "left")

    def total(kind: str, c: str) -> F.Column:
        return sum((F.coalesce(F.col(f"_{part}{kind}_{c}"), F.lit(0)) for part in "wua"), F.lit(0))

    trailing = {c: F.when(total("n", c) >= min_rows, F.try_divide(total("s", c), total("n", c))) for c in cols}
    days = x.groupBy(*carry, key, "_chunk", "date").agg(
        *[F.sum(m).alias(f"_s_{m}") for m in means], *[F.count(m).alias(f"_n_{m}") for m in means],
        *[F.max(trailing[c]).alias(f"_max_{c}") for c in cols])
    return days.groupBy(*carry, key, "date").agg(
        *[F.try_divide(F.sum(f"_s_{m}"), F.sum(f"_n_{m}")).alias(m) for m in means],
        *[F.max(f"_max_{n}").alias(f"{n}_8h") for n in cols])


def fixed_places(c: F.Column, places: int | None) -> F.Column:
    """Optional rounding of a mean to ``places`` decimals as
    floor(x * 10^p + 0.5) / 10^p. A parallel sum is not bit-reproducible
    (the order of partial sums varies), so a mean can land one ulp either
    side of a threshold or a rounding tie; fixing the places makes results
    reproducible across runs and engines."""
    if places is None:
        return c
    scale = float(10 ** places)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def station_daily(readings: DataFrame, pollutants: Sequence[str], rolling: Sequence[str] = ("o3", "co"),
                  rows: int = 8, min_rows: int = 6, dense: bool = True,
                  places: int | None = None, tiebreak: str = "event_id",
                  chunk: str = "hour", frame: str = "rows") -> DataFrame:
    """Station-day table: daily means of every pollutant plus the daily max of
    the trailing ``rows``-reading mean for ``rolling`` pollutants; with
    ``dense``, every day between a station's first and last reading appears
    (all-missing days included). ``places``: see ``fixed_places``; ``frame``: see
    ``rolling_daily_max``."""
    out = rolling_daily_max(readings, list(rolling), rows, min_rows, tiebreak=tiebreak,
                            means=list(pollutants), carry=["city"], chunk=chunk, frame=frame)
    out = out.select("city", "station_id", "date", *[
        fixed_places(F.col(c), places).alias(c) for c in (*pollutants, *[f"{r}_8h" for r in rolling])])
    if dense:
        from airlake.operators.series import fill_grid
        out = fill_grid(out, ["city", "station_id"], "date", "DAY")
    return out.select("city", "station_id", "date", *pollutants, *[f"{c}_8h" for c in rolling])


def city_daily(station_day: DataFrame, aqi_set: Sequence[str] = STATION_SET,
               rolling_for: Sequence[str] = ("O3", "CO"), places: int | None = None,
               start=None) -> DataFrame:
    """Unweighted mean of station means per (city, day), each column on its
    own; AQI from the station input set (8h maxima for O3/CO), columns absent
    from the input are skipped; then the bucket. ``start``: optional first
    day kept (the build's start-date floor)."""
    if start is not None:
        station_day = station_day.where(F.col("date") >= F.lit(start))
    vals = [c for c in station_day.columns if c not in ("city", "station_id", "date")]
    cd = station_day.groupBy("city", "date").agg(*[fixed_places(F.avg(c), places).alias(c) for c in vals])
    src = {lab: f"{col_of(lab)}_8h" for lab in rolling_for}
    labels = [lab for lab in aqi_set if src.get(lab, col_of(lab)) in cd.columns]
    return (cd.withColumn("aqi", aqi_from_concentrations(labels, src))
            .withColumn("aqi_bucket", aqi_bucket("aqi")))


def normalise_units(sensor: DataFrame) -> DataFrame:
    """Feed rows with canonical pollutant label and the value converted to the
    index basis (S8, P8)."""
    lab = None
    for p, label in FEED_PARAMS.items():
        cond = F.col("param") == p
        lab = F.when(cond, F.lit(label)) if lab is None else lab.when(cond, F.lit(label))
    return (sensor.withColumn("pollutant", lab)
            .withColumn("value_converted", convert_units("value", "pollutant", "unit")))


def pivot_feed(norm: DataFrame, keys: Sequence[str] = ("city", "date"),
               aqi_set: Sequence[str] = FEED_SET) -> DataFrame:
    """Long -> wide: mean per key and parameter, one column per known
    parameter (fixed pivot list: no extra pass to find values), then AQI and
    bucket (A6, P10, P13)."""
    params = list(FEED_PARAMS)
    wide = (norm.groupBy(*keys).pivot("param", params).agg(F.avg("value_converted")))
    wide = wide.select(*keys, *[F.col(p).alias(col_of(FEED_PARAMS[p])) for p in params])
    return (wide.withColumn("aqi", aqi_from_concentrations(aqi_set))
            .withColumn("aqi_bucket", aqi_bucket("aqi")))


def index_guard(wide: DataFrame, keys: Sequence[str], aqi_set: Sequence[str] = FEED_SET,
                min_count: int = MIN_SUB_INDICES) -> DataFrame:
    """Per key: number of available sub-indices and the AQI, which stays
    missing below ``min_count`` (P10, P12 guard)."""
    return wide.select(*keys, n_available([col_of(p) for p in aqi_set]).alias("n_sub_indices"),
                       aqi_from_concentrations(aqi_set, min_count=min_count).alias("aqi"))


def zone_daily(readings: DataFrame, zone: str | F.Column, col: str = "value", places: int | None = None) -> DataFrame:
    """Daily mean per city by the local day of ``zone``. ``readings``: city, utc
    (clock time in UTC), the value column and what ``zone`` names. ``hours`` are
    the hours of the day that hold a value, ``day_hours`` those that it has (23
    or 25 where clocks change); an hour that clocks repeat counts twice, its
    offset from UTC tells one from the other. Sums per hour come before the
    day's; both are combined before they are shuffled."""
    r = readings.where(F.col(col).isNotNull() & F.col("utc").isNotNull()).select(
        "city", zone.alias("zone") if isinstance(zone, F.Column) else F.lit(zone).alias("zone"), "utc", F.col(col).alias("v"))
    r = r.withColumn("_local", local_clock(F.col("utc"), F.col("zone")))
    hours = r.groupBy("city", "zone", F.date_trunc("hour", "_local").alias("_hour"),
                      F.timestamp_diff("MINUTE", "utc", "_local").alias("_offset")).agg(
        F.sum("v").alias("_sum"), F.count("v").alias("_n"))
    out = hours.groupBy("city", "zone", F.to_date("_hour").alias("date")).agg(
        (F.sum("_sum") / F.sum("_n")).alias("mean"), F.sum("_n").alias("n"), F.count(F.lit(1)).alias("hours"))
    return out.select("city", "zone", "date", fixed_places(F.col("mean"), places).alias("mean"), "n", "hours",
                      day_hours(F.col("date"), F.col("zone")).alias("day_hours"))
