"""Ingest, feed, splice and radius-search queries."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from airlake.functions.zones import utc_clock, utc_of_local
from airlake.operators import geo as G
from airlake.operators import ingest as I
from airlake.operators import quality as Q
from airlake.operators import quantiles as QU
from airlake.operators import splice as SP
from airlake.plans import sqlgen as S
from airlake.plans.base import rounded
from airlake.reference import FEED_PARAMS, FEED_SET, PPB_FACTOR, SPLICE_SET, col_of
from airlake.schema import CITY_DAY_SCHEMA
from airlake.session import ensure_checkpoint_dir
from airlake.sources import fixtures as X
from airlake.sources import readers as R
from airlake.sources.sinks import replace_cities, write_city_day

READ_POLL = ("pm25", "pm10", "no2", "o3", "co")


PLACES = 9  # fixed places for means (see ingest.fixed_places)


def _station_daily(s, d, frame="rows"):
    return I.station_daily(X.readings(s, d), READ_POLL, places=PLACES, frame=frame)


def _recent(s, d):
    return I.pivot_feed(I.normalise_units(X.sensor_days(s, d)))


def q_splice(s, d):
    base = X.base_day(s, d, until=X.BASE_END)
    bul = SP.scan_bulletin(X.bulletin_raw(s, d), X.CITY_NAMES, X.BASE_END)
    return rounded(SP.splice_sources(base, bul, _recent(s, d)))


FEED_START = dt.date(2024, 1, 10)
RERUN = ("ASIA", "ATLANTIS", "EUROPE")  # one of them has no rows


def q_city_table_rerun(s, d):
    """Write all cities up to the base source's end, then rerun some of them
    over all days: the coverage counted by that write beside the table as it is."""
    path = f"{ensure_checkpoint_dir(s)}/airlake-curated-{uuid.uuid4().hex}"
    write_city_day(X.base_day(s, d, until=X.BASE_END), path)
    written = replace_cities(X.base_day(s, d), path, RERUN).select(
        "city", F.col("n_rows").alias("n_written"), F.col("n_with_value").alias("n_written_with_value"),
        F.col("last_date").alias("last_written"))
    return rounded(Q.dataset_profile(s.read.schema(CITY_DAY_SCHEMA).parquet(path)).join(written, "city", "full"))


def q_curated_split(s, d):
    """Accepted and rejected rows of one pass, and its counts."""
    split = R.split_by_date(X.curated_text(s, d))
    rows = split.good.select("city", "date", F.lit(None).cast("string").alias("date_text"),
                             F.lit(None).cast("string").alias("reason"), "pm25", "aqi").unionByName(
        split.rejected.select("city", F.lit(None).cast("date").alias("date"), "date_text", "reason", "pm25", "aqi"))
    return rounded(rows.select("*", F.lit(split.n_good).cast("long").alias("n_good"),
                               F.lit(split.n_rejected).cast("long").alias("n_rejected")))



REPORT_ZONE = "Europe/Berlin"
PICKED = ("ASIA", "EUROPE", "ATLANTIS")


def q_feed_zone_days(s, d):
    feed = X.feed_instants(s, d).select("city", "value", utc_clock(F.col("period.datetimeFrom.utc")).alias("utc"))
    return rounded(I.zone_daily(feed, X.zone_of(F.col("city")), places=PLACES))


def q_station_zone_days(s, d):
    """Stations keep their own clocks; days are those of one zone."""
    files = X.local_readings(s, d).withColumn("utc", utc_of_local(F.col("ts"), X.zone_of(F.col("city"))))
    return rounded(I.zone_daily(files, REPORT_ZONE, col="pm25", places=PLACES))


def q_recent_clean(s, d):
    """A recent table is read from the first of four paths that can be read:
    one is missing, one holds no such format, one has other columns."""
    folder = f"{ensure_checkpoint_dir(s)}/airlake-recent-{uuid.uuid4().hex}"
    good = X.curated_text(s, d).where(F.try_to_date("Date", "yyyy-MM-dd").isNotNull())
    good.write.parquet(f"{folder}/good")
    X.region_names(s, d).write.csv(f"{folder}/text", header=True)
    X.region_names(s, d).write.parquet(f"{folder}/other")
    path = R.first_readable(s, [f"{folder}/{p}" for p in ("missing", "text", "other", "good")], "parquet", ("City", "Date"))
    recent = Q.filter_cities(R.load_recent(s, path, "parquet"), PICKED, strict=True)
    return rounded(recent.select("city", "date", "pm25", "aqi"))


def q_station_registry(s, d):
    """Registry file of the picked cities, attached to the readings."""
    path = f"{ensure_checkpoint_dir(s)}/airlake-registry-{uuid.uuid4().hex}"
    X.registry_text(s, d).write.csv(path, header=True)
    readings = X.station_readings(s, d).select("station_id", "date", "pm10")
    return rounded(R.attach_city(readings, R.station_registry_csv(s, path, PICKED)).groupBy("city", "date").agg(
        F.count(F.lit(1)).alias("n_readings"), F.count_distinct("station_id").alias("n_stations"), F.max("pm10").alias("max_pm10")))


PROBS = {"median": 0.5, "p95": 0.95, "p99": 0.99}


def q_city_quantiles(s, d):
    """Quantiles of all readings of a city: sketches by station, merged by
    city, held against the true ranks."""
    readings = X.station_readings(s, d).select("station_id", "pm10")
    registry = X.station_registry(s, d)
    parts = QU.sketches(readings, ["station_id"], "pm10")
    found = QU.quantiles(QU.merged(parts.join(registry, "station_id"), ["city"]), ["city"], PROBS)
    errors = QU.rank_errors(readings.join(registry, "station_id"), found, ["city"], "pm10", PROBS)
    return errors.select("city", "name", "p", "n", (F.col("rank_error") <= QU.RANK_ERROR).alias("within_bound"))


QUERIES = {
    "city_quantiles": q_city_quantiles,
    "feed_parse_zones": lambda s, d: rounded(R.feed_days(X.feed_instants(s, d), FEED_START, X.zone_of(F.col("city")))),
    "feed_zone_days": q_feed_zone_days,
    "station_zone_days": q_station_zone_days,
    "recent_clean": q_recent_clean,
    "one_city": lambda s, d: rounded(Q.require_city(R.parse_city_day(X.curated_text(s, d)), "ASIA").select(
        "city", "date", "pm25", "aqi")),
    "station_registry": q_station_registry,
    "curated_parse": lambda s, d: rounded(R.parse_city_day(X.curated_text(s, d)).select(
        "city", "date", "pm25", "aqi", "o3")),
    "curated_split": q_curated_split,
    "city_table_rerun": q_city_table_rerun,
    "hourly_parse": lambda s, d: rounded(R.parse_hourly(X.hourly_lines(s, d)).select(
        "station_id", "ts", "pm25", "pm10", "o3")),
    "feed_parse": lambda s, d: rounded(R.feed_days(X.feed_structs(s, d), FEED_START)),
    "station_daily_8h": lambda s, d: rounded(_station_daily(s, d)),
    "station_daily_8h_time": lambda s, d: rounded(_station_daily(s, d, "8 hours")),
    "city_daily": lambda s, d: rounded(I.city_daily(_station_daily(s, d), places=PLACES)),
    "unit_normalise": lambda s, d: rounded(I.normalise_units(X.sensor_days(s, d))),
    "pivot_sensor_days": lambda s, d: rounded(_recent(s, d)),
    "stationwise_index_guard": lambda s, d: rounded(I.index_guard(
        I.pivot_feed(I.normalise_units(X.sensor_days(s, d)), keys=("city", "sensor_id", "date")),
        ["city", "sensor_id", "date"])),
    "splice_sources": q_splice,
    "nearby_sensors": lambda s, d: rounded(G.nearby_sensors(
        X.locations(s, d), X.centers(s), X.ACTIVE_FROM)),
    "nearby_sensors_wrapped": lambda s, d: rounded(G.nearby_sensors(
        X.edge_locations(s, d), X.edge_centers(s), X.ACTIVE_FROM)),
    "nearby_active_sensors": lambda s, d: rounded(G.active_sensors(
        G.nearby_sensors(X.locations(s, d), X.centers(s), X.ACTIVE_FROM), X.sensor_catalogue(s, d), X.ACTIVE_FROM)),
}

# --------------------------------------------------------------------------- oracle
_R9 = S._r9
_RP = ", ".join(f"{_R9(f'avg({c})')} as {c}" for c in READ_POLL)
_ROWS_FRAME = "order by ts, event_id\n                           rows between 7 preceding and current row"
_TIME_FRAME = ("order by ts range between interval '7 hours 59 minutes 59.999999 seconds' preceding"
               " and current row")
STATION_DAILY = f""",
readings as ({S.READINGS}),
r as (select *, cast(ts as date) as date from readings),
w as (select station_id, date,
        case when count(o3) over w8 >= 6 then avg(o3) over w8 end as r_o3,
        case when count(co) over w8 >= 6 then avg(co) over w8 end as r_co
      from r window w8 as (partition by station_id {_ROWS_FRAME})),
roll as (select station_id, date, {_R9('max(r_o3)')} as o3_8h, {_R9('max(r_co)')} as co_8h from w group by 1, 2),
means as (select city, station_id, date, {_RP} from r group by 1, 2, 3),
bounds as (select city, station_id, min(date) as lo, max(date) as hi from means group by 1, 2),
grid as (select city, station_id, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as date
         from bounds),
sday as (select g.city, g.station_id, g.date, {', '.join('m.' + c for c in READ_POLL)}, ro.o3_8h, ro.co_8h
         from grid g left join means m on g.station_id = m.station_id and g.date = m.date
           left join roll ro on g.station_id = ro.station_id and g.date = ro.date)"""

_PARAM_CASE = "(CASE param " + " ".join(
    f"WHEN '{p}' THEN '{lab}'" for p, lab in FEED_PARAMS.items()) + " END)"
_FACTOR = "(CASE pollutant " + " ".join(
    f"WHEN '{lab}' THEN {S.d(f)}" for lab, f in PPB_FACTOR.items()) + f" ELSE {S.d(1.0)} END)"
NORM = f""",
sensor_days as ({S.SENSOR_DAYS}),
np0 as (select *, {_PARAM_CASE} as pollutant from sensor_days),
norm as (select *, case when lower(unit) in ('ppb', 'ppm') then
           (case when lower(unit) = 'ppm' then value * {S.d(1000.0)} else value end) * {_FACTOR}
           else value end as value_converted from np0)"""


def pivot_sql(keys: str) -> str:
    cols = ", ".join(f"avg(value_converted) filter (where param = '{p}') as {col_of(lab)}"
                     for p, lab in FEED_PARAMS.items())
    return f"select {keys}, {cols} from norm group by {keys}"


_FEED_COLS = [col_of(lab) for lab in FEED_PARAMS.values()]
RECENT = f""",
wide as ({pivot_sql('city, date')}),
recent as (select *, {S.aqi_from(FEED_SET)} as aqi from wide)"""


def _w(ctes: str, body: str, base: bool = False) -> str:
    head = f"with {S.base_ctes(str(X.BASE_END))}{ctes}" if base else "with " + ctes.lstrip(",\n")
    return f"{head}\n{body}"


_si = [S.sub_index(col_of(p), p) for p in FEED_SET]
_CONC = ("pm25", "pm10", "no", "no2", "nox", "nh3", "co", "so2", "o3", "benzene")
_TRUST = ("pm25", "pm10", "no2", "o3")
_final = ", ".join(f"coalesce(b.{c}, r.{c}) as {c}" if c in _TRUST else f"b.{c} as {c}" for c in _CONC)
SPLICE = f""",
bulletin_raw as ({S.BULLETIN_RAW}),
bul as (select area as city, d as date, avg(try_cast(aqi_value as double)) as aqi from (
          select *, cast(try_strptime(date, '%d-%m-%Y') as date) as d from bulletin_raw) x
        where area in ({', '.join(repr(c) for c in X.CITY_NAMES)}) and d is not null and d > date '2021-03-31'
        group by 1, 2),
keys as (select city, date from base_day union select city, date from bul union select city, date from recent),
sp as (select k.city, k.date, {_final}, b.aqi as b_aqi, u.aqi as u_aqi
       from keys k left join base_day b on k.city = b.city and k.date = b.date
         left join bul u on k.city = u.city and k.date = u.date
         left join recent r on k.city = r.city and k.date = r.date),
sp2 as (select *, coalesce(b_aqi, u_aqi, {S.aqi_from(SPLICE_SET)}) as aqi from sp)"""

NEARBY = f""",
locations as ({S.LOCATIONS}),
centers as ({S.CENTERS_SQL}),
c as (select ctr.city, l.location_id, l.last_seen,
        {S.d(2 * 6371000.0)} * asin(sqrt(pow(sin(radians(l.lat - ctr.lat) / 2), 2)
          + cos(radians(ctr.lat)) * cos(radians(l.lat)) * pow(sin(radians(l.lon - ctr.lon) / 2), 2))) as dist
      from locations l cross join centers ctr where l.last_seen >= timestamp '2021-01-01'),
rk as (select *, row_number() over (partition by city order by last_seen desc, location_id) as rn
       from c where dist <= {S.d(25000.0)})"""

SENSORS = f""",
sensors as ({S.SENSOR_CATALOGUE})"""

_CITY = S.city_of_user("user_id")
_ZONE = "(case city " + " ".join(f"when {c!r} then {z!r}" for c, z in X.CITY_ZONES.items()) + " end)"
SPREAD = f"""
e as (select event_id, user_id, event_type, value, {_CITY} as city, {_ZONE.replace('case city', 'case ' + _CITY)} as own,
        ts + to_days(cast(event_id * 7 % {X.SPREAD_DAYS} as integer)) as ts from events)"""


def in_zone(utc: str, zone: str) -> str:
    return f"(({utc} at time zone 'UTC') at time zone {zone})"


def from_zone(local: str, zone: str) -> str:
    """The first instant that shows this clock time (this engine gives the second)."""
    utc = f"(({local} at time zone {zone}) at time zone 'UTC')"
    earlier = f"({utc} - interval 1 hour)"
    return f"(case when {in_zone(earlier, zone)} = {local} then {earlier} else {utc} end)"


def zone_days(src: str) -> str:
    """From ``src(city, zone, utc, v)``."""
    midnight = lambda day: from_zone(f"cast({day} as timestamp)", "zone")
    return f"""
l as (select *, {in_zone('utc', 'zone')} as loc from {src} where v is not null and utc is not null),
days as (select city, zone, cast(loc as date) as date, {_R9('avg(v)')} as mean, count(*) as n,
    count(distinct (date_trunc('hour', loc), loc - utc)) as hours from l group by 1, 2, 3)
select city, zone, date, round(mean, 6) as mean, n, hours,
  round(date_diff('minute', {midnight('date')}, {midnight('(date + 1)')}) / 60.0, 6) as day_hours from days"""


_PICK = ", ".join(map(repr, PICKED))
CURATED = f"""
c as (select {_CITY} as city, case when event_id % 13 <> 0 and event_id % 17 <> 0 then cast(ts as date) end as date,
    round(case when event_id % 7 <> 0 and event_id % 11 <> 0 then value end, 6) as pm25,
    round(case when event_id % 5 <> 0 then cast(event_id as double) end, 6) as aqi from events)"""
ORACLE = {
    "city_quantiles": """
select r_name as city, name, p, count(*) as n, true as within_bound
from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey,
  (values """ + ", ".join(f"('{n}', {S.d(p)})" for n, p in PROBS.items()) + """) q(name, p)
where l_linenumber <> 6 and l_extendedprice is not null group by 1, 2, 3""",
    "feed_parse_zones": f"""
with {SPREAD},
f as (select *, cast({in_zone("date_trunc('second', ts)", 'own')} as date) as day from e where event_id % 9 <> 0)
select user_id as sensor_id, day as date, event_type as param, 'ug/m3' as unit, round(value, 6) as value
from f where day >= date '{FEED_START}'""",
    "feed_zone_days": f"""
with {SPREAD},
f as (select city, own as zone, date_trunc('second', ts) as utc, value as v from e where event_id % 9 <> 0),
{zone_days('f')}""",
    "station_zone_days": f"""
with {SPREAD},
f as (select city, '{REPORT_ZONE}' as zone, {from_zone('ts', 'own')} as utc,
    case when event_type <> 'view' then value end as v from e),
{zone_days('f')}""",
    "recent_clean": f"with {CURATED} select * from c where date is not null and city in ({_PICK})",
    "one_city": f"with {CURATED} select * from c where city = 'ASIA'",
    "station_registry": f"""
select r_name as city, cast(cast(l_shipdate as date) + interval 240 month as date) as date, count(*) as n_readings,
  count(distinct l_suppkey) as n_stations,
  round(max(case when l_linenumber <> 6 then l_extendedprice / 251 end), 6) as max_pm10
from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey where r_name in ({_PICK}) group by 1, 2""",
    "curated_parse": f"""
select {_CITY} as city, case when event_id % 13 <> 0 and event_id % 17 <> 0 then cast(ts as date) end as date,
  round(case when event_id % 7 <> 0 and event_id % 11 <> 0 then value end, 6) as pm25,
  round(case when event_id % 5 <> 0 then cast(event_id as double) end, 6) as aqi, cast(null as double) as o3
from events""",
    "curated_split": f"""
with t as (
  select {_CITY} as city, case when event_id % 13 = 0 then 'no date' when event_id % 17 = 0 then null
      else strftime(ts, '%Y-%m-%d') end as txt,
    case when event_id % 7 <> 0 and event_id % 11 <> 0 then value end as pm25,
    case when event_id % 5 <> 0 then cast(event_id as double) end as aqi,
    event_id % 13 = 0 or event_id % 17 = 0 as bad, cast(ts as date) as day from events)
select city, case when not bad then day end as date, case when bad then txt end as date_text,
  case when bad and txt is null then 'missing date' when bad then 'unparseable date' end as reason,
  round(pm25, 6) as pm25, round(aqi, 6) as aqi,
  count(*) filter (where not bad) over () as n_good, count(*) filter (where bad) over () as n_rejected
from t""",
    "hourly_parse": """
select cast(user_id % 15 as varchar) as station_id, date_trunc('second', ts) as ts,
  round(case when user_id % 15 % 2 = 0 and event_id % 7 <> 0 then cast(event_id as double) end, 6) as pm25,
  round(case when user_id % 15 % 2 <> 0 then cast(event_id % 100 as double) end, 6) as pm10,
  round(case when user_id % 15 % 2 = 0 then cast(event_id % 100 as double) end, 6) as o3
from events where event_id % 19 <> 0""",
    "feed_parse": f"""
select user_id as sensor_id, cast(ts as date) as date, event_type as param, 'ug/m3' as unit,
  round(value, 6) as value from events where event_id % 9 <> 0 and cast(ts as date) >= date '{FEED_START}'""",
    "station_daily_8h": _w(STATION_DAILY, "select city, station_id, date, " + ", ".join(
        f"round({c}, 6) as {c}" for c in (*READ_POLL, "o3_8h", "co_8h")) + " from sday"),
    "station_daily_8h_time": _w(STATION_DAILY.replace(_ROWS_FRAME, _TIME_FRAME),
                                "select city, station_id, date, " + ", ".join(
        f"round({c}, 6) as {c}" for c in (*READ_POLL, "o3_8h", "co_8h")) + " from sday"),
    "city_daily": _w(STATION_DAILY + f""",
cd as (select city, date, {', '.join(f"{_R9(f'avg({c})')} as {c}" for c in (*READ_POLL, 'o3_8h', 'co_8h'))}
       from sday group by 1, 2),
cda as (select *, {S.aqi_from(('PM2.5', 'PM10', 'NO2', 'O3', 'CO'), {'O3': 'o3_8h', 'CO': 'co_8h'})} as aqi from cd)""",
                     "select city, date, " + ", ".join(
                         f"round({c}, 6) as {c}" for c in (*READ_POLL, "o3_8h", "co_8h", "aqi"))
                     + f", {S.bucket('aqi')} as aqi_bucket from cda"),
    "city_table_rerun": f"""
with {S.base_ctes()},
kept as (select * from base_day where city in ({', '.join(map(repr, RERUN))}) or date <= date '{X.BASE_END}'),
prof as (
  select city, count(*) as n_rows, min(date) as first_date, max(date) as last_date, count(aqi) as n_with_value,
    round(count(aqi) * 100.0 / count(*), 6) as pct_with_value from kept group by city),
rerun as (
  select t.city, count(b.city) as n_written, count(b.aqi) as n_written_with_value, max(b.date) as last_written
  from (select unnest([{', '.join(map(repr, RERUN))}]) as city) t left join base_day b on b.city = t.city group by t.city)
select coalesce(prof.city, rerun.city) as city, n_rows, first_date, last_date, n_with_value, pct_with_value,
  n_written, n_written_with_value, last_written from prof full join rerun on prof.city = rerun.city""",
    "unit_normalise": _w(NORM, "select city, sensor_id, date, param, unit, round(value, 6) as value,"
                               " pollutant, round(value_converted, 6) as value_converted from norm"),
    "pivot_sensor_days": _w(NORM + RECENT, "select city, date, " + ", ".join(
        f"round({c}, 6) as {c}" for c in (*_FEED_COLS, "aqi")) + f", {S.bucket('aqi')} as aqi_bucket from recent"),
    "stationwise_index_guard": _w(NORM + f""",
sw as ({pivot_sql('city, sensor_id, date')}),
g as (select city, sensor_id, date, {S.n_avail(_si)} as n_sub_indices,
        {S.aqi(_si)} as aqi from sw)""",
                                  "select city, sensor_id, date, n_sub_indices, round(aqi, 6) as aqi from g"),
    "splice_sources": _w(NORM + RECENT + SPLICE, "select city, date, " + ", ".join(
        f"round({c}, 6) as {c}" for c in (*_CONC, "aqi")) + f", {S.bucket('aqi')} as aqi_bucket from sp2",
        base=True),
    "nearby_sensors": _w(NEARBY, "select city, location_id, round(dist / 1000.0, 6) as distance_km,"
                                 " last_seen, cast(rn as integer) as rank from rk where rn <= 20"),
    "nearby_sensors_wrapped": _w(NEARBY.replace(S.LOCATIONS, S.EDGE_LOCATIONS).replace(S.CENTERS_SQL, S.EDGE_CENTERS_SQL),
                                 "select city, location_id, round(dist / 1000.0, 6) as distance_km,"
                                 " last_seen, cast(rn as integer) as rank from rk where rn <= 20"),
    "nearby_active_sensors": _w(NEARBY + SENSORS, "select city, location_id, cast(rn as integer) as rank, sensor_id,"
                                f" case param {' '.join(f'when {p!r} then {v!r}' for p, v in FEED_PARAMS.items())} end"
                                " as pollutant, unit, s.last_seen from rk join sensors s using (location_id)"
                                f" where rn <= 20 and param in ({', '.join(map(repr, FEED_PARAMS))})"
                                " and s.last_seen >= timestamp '2021-01-01'"),
}
