"""Attribution queries: sub_indices, aqi_bucket, seasonal_attribution(+bad),
dominant_pollutant, attribution_grid, validate_aqi."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlake.functions.aqi import aqi_bucket, si_name
from airlake.operators import attribution as A
from airlake.plans import sqlgen as S
from airlake.plans.base import rounded
from airlake.reference import ATTRIBUTION_SET, col_of
from airlake.sources import fixtures as X

SI = [si_name(p) for p in ATTRIBUTION_SET]


def q_sub_indices(spark, sf):
    return rounded(A.compute_sub_indices(X.base_day(spark, sf)))


def q_aqi_bucket(spark, sf):
    att = A.compute_sub_indices(X.base_day(spark, sf))
    return rounded(att.select("city", "date", "computed_aqi",
                              aqi_bucket("computed_aqi").alias("computed_bucket")))


def q_seasonal_attribution(spark, sf):
    return rounded(A.seasonal_attribution(X.base_day(spark, sf)))


def q_seasonal_attribution_bad(spark, sf):
    return rounded(A.seasonal_attribution(X.base_day(spark, sf), bad_only=True))


def q_dominant_pollutant(spark, sf):
    return rounded(A.dominant_pollutant_by_season(A.seasonal_attribution(X.base_day(spark, sf), order=False)))


def q_attribution_grid(spark, sf):
    shares = A.seasonal_attribution(X.base_day(spark, sf), bad_only=True, order=False)
    return rounded(A.attribution_grid(shares))


def q_validate_aqi(spark, sf):
    return rounded(A.validate_computed_aqi(A.compute_sub_indices(X.base_day(spark, sf))))


QUERIES = {
    "sub_indices": q_sub_indices,
    "aqi_bucket": q_aqi_bucket,
    "seasonal_attribution": q_seasonal_attribution,
    "seasonal_attribution_bad": q_seasonal_attribution_bad,
    "dominant_pollutant": q_dominant_pollutant,
    "attribution_grid": q_attribution_grid,
    "validate_aqi": q_validate_aqi,
}

# --------------------------------------------------------------------------- oracle
_si_sel = ", ".join(f"{S.sub_index(col_of(p), p)} as {si_name(p)}" for p in ATTRIBUTION_SET)
_resp = "(CASE " + " ".join(
    f"WHEN {si_name(p)} = computed_aqi THEN '{p}'" for p in ATTRIBUTION_SET) + " END)"
ATTRIB_CTE = f""",
si as (select city, date, aqi, {_si_sel} from base_day),
attrib as (
  select *, {_resp} as responsible from (
    select *, greatest({', '.join(SI)}) as computed_aqi from si
    where {S.n_avail(SI)} >= 3) x
)"""


def _with_attrib(body: str) -> str:
    return f"with {S.base_ctes()}{ATTRIB_CTE}\n{body}"


def _shares(bad: bool) -> str:
    where = "where computed_aqi > 200.0" if bad else ""
    return f""",
seasoned as (select *, {S.season('month(date)')} as season from attrib {where}),
counts as (select city, season, responsible, count(*) as n_days from seasoned
           group by city, season, responsible),
shares as (select city, season, responsible, n_days,
           n_days * 100.0 / sum(n_days) over (partition by city, season) as share_pct from counts)"""


ORACLE = {
    "sub_indices": _with_attrib(
        "select city, date, round(aqi, 6) as aqi, "
        + ", ".join(f"round({c}, 6) as {c}" for c in SI)
        + ", round(computed_aqi, 6) as computed_aqi, responsible from attrib"),
    "aqi_bucket": _with_attrib(
        f"select city, date, round(computed_aqi, 6) as computed_aqi, "
        f"{S.bucket('computed_aqi')} as computed_bucket from attrib"),
    "seasonal_attribution": f"with {S.base_ctes()}{ATTRIB_CTE}{_shares(False)}\n"
    "select city, season, responsible, n_days, round(share_pct, 6) as share_pct from shares",
    "seasonal_attribution_bad": f"with {S.base_ctes()}{ATTRIB_CTE}{_shares(True)}\n"
    "select city, season, responsible, n_days, round(share_pct, 6) as share_pct from shares",
    "dominant_pollutant": f"with {S.base_ctes()}{ATTRIB_CTE}{_shares(False)}\n"
    "select city, season, responsible, round(share_pct, 6) as share_pct, n_days from ("
    "select *, row_number() over (partition by city, season order by share_pct desc, responsible) as rn"
    " from shares) t where rn = 1",
    "attribution_grid": f"with {S.base_ctes()}{ATTRIB_CTE}{_shares(True)}\n"
    "select a.city, a.season, a.responsible, round(s.share_pct, 6) as share_pct, s.n_days from ("
    "select distinct city, responsible, unnest(['Winter','Summer','Monsoon','Post-monsoon']) as season"
    " from shares) a left join shares s on a.city = s.city and a.season = s.season"
    " and a.responsible = s.responsible",
    "validate_aqi": _with_attrib(
        "select city, count(*) as n, round(case when stddev_pop(computed_aqi) * stddev_pop(aqi) > 0"
        " then covar_pop(computed_aqi, aqi) / (stddev_pop(computed_aqi) * stddev_pop(aqi)) end, 6)"
        " as correlation, round(avg(abs(computed_aqi - aqi)), 6) as mae,"
        " round(avg(case when abs(computed_aqi - aqi) <= 0.10 * aqi then 1.0 else 0.0 end) * 100.0, 6)"
        " as within_10pct from attrib where aqi is not null and computed_aqi is not null group by city"),
}
