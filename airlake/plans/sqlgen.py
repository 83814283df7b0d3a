"""DuckDB SQL builders for the oracle: the same fixed tables, written as SQL
expressions, plus the fixture views of FIXTURES.md as CTEs."""

from __future__ import annotations

from collections.abc import Sequence

from airlake.reference import (
    AQI_BUCKETS, AQI_TOP_BUCKET, BREAKPOINTS, MIN_SUB_INDICES, MONTH_NAMES, SEASON_MONTHS,
    SEASON_ORDER, STATION_SET, col_of,
)
from airlake.sources.fixtures import CENTERS, CITY_NAMES, EDGE_CENTERS, SPARSE_MONTHS


def d(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def sub_index(expr: str, label: str) -> str:
    bands = BREAKPOINTS[label]

    def line(b):
        lo, hi, ilo, ihi = b
        return f"({d(ilo)} + {d(ihi - ilo)} * (({expr}) - {d(lo)}) / {d(hi - lo)})"

    whens = " ".join(f"WHEN ({expr}) <= {d(b[1])} THEN {line(b)}" for b in bands)
    return f"(CASE {whens} ELSE {line(bands[-1])} END)"


def n_avail(exprs: Sequence[str]) -> str:
    return " + ".join(f"(CASE WHEN ({e}) IS NOT NULL THEN 1 ELSE 0 END)" for e in exprs)


def aqi(exprs: Sequence[str], min_count: int = MIN_SUB_INDICES) -> str:
    return f"(CASE WHEN {n_avail(exprs)} >= {min_count} THEN greatest({', '.join(exprs)}) END)"


def aqi_from(labels: Sequence[str], src: dict[str, str] | None = None) -> str:
    return aqi([sub_index((src or {}).get(lab, col_of(lab)), lab) for lab in labels])


def bucket(expr: str) -> str:
    whens = " ".join(f"WHEN ({expr}) <= {d(e)} THEN '{n}'" for e, n in AQI_BUCKETS)
    return f"(CASE WHEN ({expr}) IS NULL THEN NULL {whens} ELSE '{AQI_TOP_BUCKET}' END)"


def season(month_expr: str) -> str:
    whens = " ".join(f"WHEN ({month_expr}) IN ({', '.join(map(str, ms))}) THEN '{n}'"
                     for n, ms in SEASON_MONTHS.items())
    return f"(CASE {whens} END)"


def season_rank(expr: str) -> str:
    whens = " ".join(f"WHEN ({expr}) = '{n}' THEN {i}" for i, n in enumerate(SEASON_ORDER, 1))
    return f"(CASE {whens} END)"


def month_name(month_expr: str) -> str:
    arr = ", ".join(f"'{n}'" for n in MONTH_NAMES)
    return f"([{arr}][CAST({month_expr} AS INTEGER)])"


def r6(expr: str) -> str:
    return f"round({expr}, 6)"


def city_of_user(uid: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(CITY_NAMES))
    return f"(CASE {uid} % 5 {whens} END)"


# ---------------------------------------------------------------------------
# Fixture views (FIXTURES.md section 2) as CTE bodies.
# ---------------------------------------------------------------------------

REGISTRY = """
  select s_suppkey as station_id, r_name as city
  from supplier join nation on s_nationkey = n_nationkey
    join region on n_regionkey = r_regionkey"""

STATION_DAY_RAW = """
  select r_name as city, l_suppkey as station_id,
    cast(l_shipdate + interval 20 year as date) as date, l_orderkey, l_linenumber,
    case when l_linenumber = 7 then null else l_quantity * 43 / 7 *
      (case when month(l_shipdate) in (12,1,2) then 1.5
            when month(l_shipdate) in (3,4,5,6) then 1.0
            when month(l_shipdate) in (7,8,9) then 0.4 else 1.8 end) end as pm25,
    case when l_linenumber = 6 then null else l_extendedprice / 251 end as pm10,
    case when l_linenumber in (5,6) then null else l_discount * 30000 / 11 end as no2,
    case when l_linenumber = 4 then null else l_tax * 90000 / 11 end as so2,
    case when l_linenumber = 3 then null else cast(l_partkey % 300 as double) * 10 / 11 end as o3,
    case when l_linenumber = 2 then null else cast(l_orderkey % 20 as double) * 10 / 11 end as co,
    case when l_linenumber = 1 then null
         else cast((l_orderkey + l_partkey) % 900 as double) * 10 / 11 end as nh3
  from lineitem join supplier on l_suppkey = s_suppkey
    join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""

def _r9(e: str) -> str:
    return f"(floor(({e}) * CAST(1e9 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1e9 AS DOUBLE))"


_P = ("pm25", "pm10", "no2", "so2", "o3", "co", "nh3")


def base_ctes(until: str | None = None) -> str:
    """CTEs station_day_raw, base_station_day, base_day (cut for the splice only)."""
    where = f"where date <= date '{until}'" if until else ""
    avgs = ", ".join(f"{_r9(f'avg({c})')} as {c}" for c in _P)
    return f"""
station_day_raw as ({STATION_DAY_RAW}
),
base_station_day as (
  select city, station_id, date, {avgs}
  from station_day_raw {where}
  group by city, station_id, date
),
base_day as (
  select city, date, pm25, pm10, cast(null as double) as no, no2, cast(null as double) as nox,
    nh3, co, so2, o3, cast(null as double) as benzene, aqi, {bucket('aqi')} as aqi_bucket
  from (
    select city, date, {avgs}, {_r9('avg(st_aqi)')} as aqi
    from (select *, {aqi_from(STATION_SET)} as st_aqi from base_station_day) s
    group by city, date) c
)"""


def with_base(body: str) -> str:
    return f"with {base_ctes()}\n{body}"


BULLETIN_RAW = """
  select strftime(o_orderdate + interval 20 year, '%d-%m-%Y') as date, r_name as area,
    cast(o_totalprice / 1000 as varchar) as aqi_value
  from orders join customer on o_custkey = c_custkey
    join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  where o_orderdate >= timestamp '2001-01-01'"""

READINGS = f"""
  select {city_of_user('user_id')} as city,
    user_id % 15 as station_id, ts, event_id,
    case when event_type = 'view'     then null else value end       as pm25,
    case when event_type = 'click'    then null else value * 1.5 end as pm10,
    case when event_type = 'purchase' then null else value * 0.8 end as no2,
    case when event_type = 'signup'   then null else value * 1.2 end as o3,
    case when event_type = 'error'    then null else value / 20 end  as co
  from events"""

SENSOR_DAYS = f"""
  select {city_of_user('user_id')} as city, user_id as sensor_id, cast(ts as date) as date,
    case event_type when 'view' then 'pm25' when 'click' then 'pm10'
         when 'purchase' then 'no2' when 'signup' then 'o3' else 'co' end as param,
    case event_type when 'purchase' then 'ppb' when 'error' then 'ppm'
         else 'ug/m3' end as unit, value
  from events"""

CENTERS_SQL = "select * from (values " + ", ".join(
    f"('{c}', {d(la)}, {d(lo)})" for c, la, lo in CENTERS) + ") t(city, lat, lon)"

LOCATIONS = f"""
  select c_custkey as location_id,
    ctr.lat + ((c_custkey % 101) - 50) / CAST(100.0 AS DOUBLE) as lat,
    ctr.lon + (((c_custkey * 7) % 101) - 50) / CAST(100.0 AS DOUBLE) as lon,
    lo.last_order + interval 20 year as last_seen
  from customer join nation on c_nationkey = n_nationkey
    join region on n_regionkey = r_regionkey
    join ({CENTERS_SQL}) ctr on ctr.city = r_name
    left join (select o_custkey, max(o_orderdate) as last_order from orders group by o_custkey) lo
      on lo.o_custkey = c_custkey"""

EDGE_CENTERS_SQL = "select * from (values " + ", ".join(
    f"('{c}', {d(la)}, {d(lo)})" for c, la, lo in EDGE_CENTERS) + ") t(city, lat, lon)"

EDGE_LOCATIONS = f"""
  select k as location_id,
    case when k % 2 = 0 then {d(-16.5)} + (k % 101 - 50) / {d(100)} else {d(89.8)} + (k % 21) / {d(100)} end as lat,
    case when k % 2 = 1 then cast(k * 37 % 360 - 180 as double)
      when k * 7 % 101 > 55 then {d(-180.05)} + (k * 7 % 101 - 50) / {d(100)}
      else {d(179.95)} + (k * 7 % 101 - 50) / {d(100)} end as lon,
    last + interval 20 year as last_seen
  from (select o_custkey as k, max(o_orderdate) as last from orders group by o_custkey)"""

SENSOR_CATALOGUE = """
  select o_custkey as location_id, o_custkey * 8 + o_orderkey % 8 as sensor_id,
    case o_orderkey % 8 when 0 then 'pm25' when 1 then 'pm10' when 2 then 'no2' when 3 then 'so2' when 4 then 'co'
      when 5 then 'o3' when 6 then 'temperature' else 'relativehumidity' end as param,
    case o_orderkey % 8 when 2 then 'ppb' when 3 then 'ppb' when 4 then 'ppm' when 6 then 'c' when 7 then '%'
      else 'ug/m3' end as unit,
    max(o_orderdate) + interval 20 year as last_seen
  from orders group by o_custkey, o_orderkey % 8"""

SPARSE_DAY = f"""
  select r_name as city, cast(l_shipdate + interval 20 year as date) as date,
    case when (year(l_shipdate) * 12 + month(l_shipdate)) % 29 not in ({', '.join(map(str, SPARSE_MONTHS))})
      then l_quantity end as v
  from lineitem join supplier on l_suppkey = s_suppkey
    join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""
