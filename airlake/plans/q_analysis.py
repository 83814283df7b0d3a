"""Trend, event, city, health and quality queries over the city-day fixture."""

from __future__ import annotations

from airlake.operators import cities as C
from airlake.operators import events as EV
from airlake.operators import health as H
from airlake.operators import quality as Q
from airlake.operators import trends as T
from airlake.plans import sqlgen as S
from airlake.plans.base import rounded
from airlake.reference import FESTIVAL_DATES
from airlake.session import cut_lineage
from airlake.sources import fixtures as X

FOCUS = "ASIA"
REGION = ("ASIA", "EUROPE", "ATLANTIS")


def _bd(spark, sf):
    return X.base_day(spark, sf)


def q_event_headline(spark, sf):
    """Both effects need the city-day table: it is computed once."""
    cd = cut_lineage(_bd(spark, sf).select("city", "date", "pm25"))
    return rounded(EV.event_headline(EV.festival_effect(cd, X.festival_calendar(spark)), EV.season_effect(cd)))


QUERIES = {
    "monthly_trend": lambda s, d: rounded(T.monthly_trend(_bd(s, d), "aqi")),
    "monthly_rolling12": lambda s, d: rounded(T.monthly_rolling(T.monthly_trend(_bd(s, d), "aqi"))),
    "monthly_rolling12_time": lambda s, d: rounded(T.monthly_rolling(
        T.monthly_trend(X.sparse_day(s, d), "v"), frame="months")),
    "yearly_trend": lambda s, d: rounded(T.yearly_trend(_bd(s, d), "aqi")),
    "climatology": lambda s, d: rounded(T.monthly_climatology(_bd(s, d), "pm25")),
    "trend_headline": lambda s, d: rounded(T.trend_headline(T.yearly_trend(_bd(s, d), "aqi"))),
    "season_headline": lambda s, d: rounded(T.season_headline(T.monthly_climatology(_bd(s, d), "pm25"))),
    "festival_effect": lambda s, d: rounded(EV.festival_effect(_bd(s, d), X.festival_calendar(s))),
    "season_effect": lambda s, d: rounded(EV.season_effect(_bd(s, d))),
    "lockdown_effect": lambda s, d: rounded(EV.lockdown_effect(_bd(s, d))),
    "lockdown_summary": lambda s, d: rounded(EV.lockdown_summary(EV.lockdown_effect(_bd(s, d)))),
    "event_headline": q_event_headline,
    "city_summary": lambda s, d: rounded(C.city_summary(_bd(s, d))),
    "seasonal_city_means": lambda s, d: rounded(C.seasonal_city_means(_bd(s, d))),
    "seasonality_index": lambda s, d: rounded(C.seasonality_index(_bd(s, d))),
    "city_headline": lambda s, d: rounded(C.city_headline(_bd(s, d), FOCUS)),
    "health_exceedance": lambda s, d: rounded(H.health_exceedance(_bd(s, d))),
    "health_summary": lambda s, d: rounded(H.health_summary(_bd(s, d))),
    "health_day_classes": lambda s, d: H.health_day_classes(H.health_exceedance(_bd(s, d))),
    "null_rates": lambda s, d: rounded(Q.null_rates(_bd(s, d))),
    "dataset_profile": lambda s, d: rounded(Q.dataset_profile(_bd(s, d))),
    "region_filter": lambda s, d: rounded(Q.filter_cities(
        X.base_day(s, d, cities=REGION), REGION, known=X.region_names(s, d))),
}

# --------------------------------------------------------------------------- oracle


def obs(col: str, name: str = "obs") -> str:
    return f",\n{name} as (select city, date, {col} as value from base_day where {col} is not null)"


def W(ctes: str, body: str) -> str:
    return f"with {S.base_ctes()}{ctes}\n{body}"


MONTHLY = ",\nmonthly as (select city, cast(date_trunc('month', date) as date) as month, avg(value) as mean," \
          " median(value) as median, count(value) as n_days from obs group by 1, 2)"
YEARLY = ",\nyearly as (select city, cast(year(date) as integer) as year, avg(value) as mean," \
         " median(value) as median, count(value) as n_days from obs group by 1, 2)"
CLIM = ",\nclim as (select city, cast(month(date) as integer) as month_num, avg(value) as mean," \
       " count(value) as n_days from obs group by 1, 2)"
CAL = ",\ncal as (select * from (values " + ", ".join(
    f"({y}, date '{dte}')" for y, dte in FESTIVAL_DATES.items()) + ") t(year, event_date))"
FEST = CAL + """,
win as (select year, event_date, cast(event_date + cast(r.off as integer) as date) as date, r.off >= 0 as in_event
        from cal cross join range(-14, 3) r(off)),
fest as (
  select city, cast(year as integer) as year, event_date, festival_mean, baseline_mean,
    festival_mean - baseline_mean as abs_change,
    100.0 * (festival_mean - baseline_mean) / nullif(baseline_mean, 0) as pct_change,
    n_festival, n_baseline
  from (select o.city, w.year, w.event_date,
          avg(o.value) filter (where w.in_event) as festival_mean,
          avg(o.value) filter (where not w.in_event) as baseline_mean,
          count(o.value) filter (where w.in_event) as n_festival,
          count(o.value) filter (where not w.in_event) as n_baseline
        from obs o join win w on o.date = w.date group by 1, 2, 3) g
  where n_festival > 0 and n_baseline > 0)"""
SEASONEFF = """,
seff as (
  select city, year, season_mean, rest_mean, season_mean / nullif(rest_mean, 0) as multiplier,
    100.0 * (season_mean - rest_mean) / nullif(rest_mean, 0) as pct_change, n_season, n_rest
  from (select city, cast(year(date) as integer) as year,
          avg(value) filter (where month(date) in (10, 11)) as season_mean,
          avg(value) filter (where month(date) not in (10, 11)) as rest_mean,
          count(value) filter (where month(date) in (10, 11)) as n_season,
          count(value) filter (where month(date) not in (10, 11)) as n_rest
        from obs group by 1, 2) g
  where n_season > 0 and n_rest > 0)"""
LOCK = """,
lk as (select city, cast(year(date) as integer) as year, avg(value) as mean, count(value) as n_days,
         cast(year(date) as integer) = 2020 as is_lockdown
       from obs where month(date) in (4, 5) group by 1, 2)"""
SUMMARY = """,
summ as (select city, count(value) as n_days, avg(value) as mean, median(value) as median,
           quantile_cont(value, 0.95) as p95, avg(cast(value > 200.0 as double)) * 100.0 as pct_bad
         from obs group by city)"""
SEASONALITY = f""",
sx as (select city, winter, monsoon, winter / nullif(monsoon, 0) as winter_monsoon_ratio from (
         select city, avg(value) filter (where {S.season('month(date)')} = 'Winter') as winter,
           avg(value) filter (where {S.season('month(date)')} = 'Monsoon') as monsoon
         from obs2 group by city) g
       where winter is not null and monsoon is not null and winter / nullif(monsoon, 0) is not null)"""
HEALTH = """,
he as (select city, cast(year(date) as integer) as year, count(value) as n_days, avg(value) as mean_pm25,
         count_if(value > 15.0) as days_over_who, count_if(value > 60.0) as days_over_india,
         count_if(value <= 15.0) as clean_days,
         avg(cast(value > 15.0 as double)) * 100.0 as pct_over_who,
         avg(cast(value > 60.0 as double)) * 100.0 as pct_over_india,
         avg(value) / 22.0 as avg_cigarettes_day
       from obs group by 1, 2)"""

_KEYS = ("pm25", "pm10", "no2", "nox", "nh3", "co", "so2", "o3", "aqi")
NULLS = ",\nnr as (" + " union all ".join(
    f"select city, '{c}' as \"column\", count_if({c} is null) as n_missing, count(*) as n "
    f"from base_day group by city" for c in _KEYS) + ")"

ORACLE = {
    "monthly_trend": W(obs("aqi") + MONTHLY,
                       "select city, month, round(mean, 6) as mean, round(median, 6) as median, n_days from monthly"),
    "monthly_rolling12": W(obs("aqi") + MONTHLY,
                           "select city, month, round(mean, 6) as mean, round(case when count(mean) over w >= 6"
                           " then avg(mean) over w end, 6) as rolling_mean from monthly"
                           " window w as (partition by city order by month rows between 11 preceding and current row)"),
    "monthly_rolling12_time": f"""
with sparse_day as ({S.SPARSE_DAY}),
obs as (select city, date, v as value from sparse_day where v is not null){MONTHLY}
select city, month, round(mean, 6) as mean,
  round(case when count(mean) over w >= 6 then avg(mean) over w end, 6) as rolling_mean from monthly
window w as (partition by city order by month range between interval 11 months preceding and current row)""",
    "yearly_trend": W(obs("aqi") + YEARLY,
                      "select city, year, round(mean, 6) as mean, round(median, 6) as median, n_days from yearly"),
    "climatology": W(obs("pm25") + CLIM,
                     f"select city, month_num, {S.month_name('month_num')} as month, round(mean, 6) as mean,"
                     " n_days from clim"),
    "trend_headline": W(obs("aqi") + YEARLY, """
select city, first_year, round(first_mean, 6) as first_mean, last_year, round(last_mean, 6) as last_mean,
  round(last_mean - first_mean, 6) as delta,
  round(100.0 * (last_mean - first_mean) / nullif(first_mean, 0), 6) as pct_change, worst_year
from (select city,
        min(year) filter (where n_days >= 350) as first_year,
        arg_min(mean, year) filter (where n_days >= 350) as first_mean,
        max(year) filter (where n_days >= 350) as last_year,
        arg_max(mean, year) filter (where n_days >= 350) as last_mean,
        first(year order by mean desc, year asc) as worst_year,
        count(*) filter (where n_days >= 350) as n_full
      from yearly group by city) g
where n_full >= 2"""),
    "season_headline": W(obs("pm25") + CLIM, f"""
select city, {S.month_name('peak_num')} as peak_month, round(peak_mean, 6) as peak_mean,
  {S.month_name('trough_num')} as trough_month, round(trough_mean, 6) as trough_mean,
  round(peak_mean / nullif(trough_mean, 0), 6) as peak_trough_ratio
from (select city, first(month_num order by mean desc, month_num) as peak_num, max(mean) as peak_mean,
        first(month_num order by mean asc, month_num) as trough_num, min(mean) as trough_mean
      from clim group by city) g"""),
    "festival_effect": W(obs("pm25") + FEST,
                         "select city, year, event_date, round(festival_mean, 6) as festival_mean,"
                         " round(baseline_mean, 6) as baseline_mean, round(abs_change, 6) as abs_change,"
                         " round(pct_change, 6) as pct_change, n_festival, n_baseline from fest"),
    "season_effect": W(obs("pm25") + SEASONEFF,
                       "select city, year, round(season_mean, 6) as season_mean, round(rest_mean, 6) as rest_mean,"
                       " round(multiplier, 6) as multiplier, round(pct_change, 6) as pct_change, n_season, n_rest"
                       " from seff"),
    "lockdown_effect": W(obs("pm25") + LOCK,
                         "select city, year, round(mean, 6) as mean, n_days, is_lockdown from lk"),
    "lockdown_summary": W(obs("pm25") + LOCK, """
select city, round(lockdown_mean, 6) as lockdown_mean, round(baseline_mean, 6) as baseline_mean,
  round(lockdown_mean - baseline_mean, 6) as abs_change,
  round(100.0 * (lockdown_mean - baseline_mean) / nullif(baseline_mean, 0), 6) as pct_change, n_baseline_years
from (select city, max(mean) filter (where is_lockdown) as lockdown_mean,
        avg(mean) filter (where not is_lockdown) as baseline_mean,
        count(*) filter (where not is_lockdown) as n_baseline_years,
        count(*) filter (where is_lockdown) as n_lock
      from lk group by city) g
where n_lock > 0 and n_baseline_years > 0"""),
    "event_headline": W(obs("pm25") + FEST + SEASONEFF, """
select city, n_festivals, round(festival_avg_pct, 6) as festival_avg_pct, festival_worst_year,
  round(festival_worst_pct, 6) as festival_worst_pct, n_season_years,
  round(season_avg_multiplier, 6) as season_avg_multiplier, round(season_avg_pct, 6) as season_avg_pct
from (select city, count(*) as n_festivals, avg(pct_change) as festival_avg_pct,
        first(year order by pct_change desc, year asc) filter (where pct_change is not null) as festival_worst_year,
        max(pct_change) as festival_worst_pct
      from fest group by city) f
full join (select city, count(*) as n_season_years, avg(multiplier) as season_avg_multiplier,
             avg(pct_change) as season_avg_pct from seff group by city) s using (city)"""),
    "city_summary": W(obs("aqi") + SUMMARY,
                      "select city, n_days, round(mean, 6) as mean, round(median, 6) as median,"
                      " round(p95, 6) as p95, round(pct_bad, 6) as pct_bad from summ"),
    "seasonal_city_means": W(obs("pm25"),
                             f"select city, {S.season('month(date)')} as season, round(avg(value), 6) as mean"
                             " from obs group by 1, 2"),
    "seasonality_index": W(obs("pm25", "obs2") + SEASONALITY,
                           "select city, round(winter, 6) as winter, round(monsoon, 6) as monsoon,"
                           " round(winter_monsoon_ratio, 6) as winter_monsoon_ratio from sx"),
    "city_headline": W(obs("aqi") + obs("pm25", "obs2") + SUMMARY + SEASONALITY, f"""
select a.city, round(focus_mean, 6) as focus_mean, round(others_mean, 6) as others_mean,
  round(focus_mean / nullif(others_mean, 0), 6) as ratio_to_others, round(focus_pct_bad, 6) as focus_pct_bad,
  round(focus_seasonal_ratio, 6) as focus_seasonal_ratio, most_seasonal_city,
  round(most_seasonal_ratio, 6) as most_seasonal_ratio
from (select '{FOCUS}' as city, max(mean) filter (where city = '{FOCUS}') as focus_mean,
        avg(mean) filter (where city <> '{FOCUS}') as others_mean,
        max(pct_bad) filter (where city = '{FOCUS}') as focus_pct_bad,
        count(*) filter (where city = '{FOCUS}') as present from summ) a
left join (select '{FOCUS}' as city,
             max(winter_monsoon_ratio) filter (where city = '{FOCUS}') as focus_seasonal_ratio,
             first(city order by winter_monsoon_ratio desc, city) as most_seasonal_city,
             max(winter_monsoon_ratio) as most_seasonal_ratio from sx) b on a.city = b.city
where present > 0"""),
    "health_exceedance": W(obs("pm25") + HEALTH,
                           "select city, year, n_days, round(mean_pm25, 6) as mean_pm25, days_over_who,"
                           " days_over_india, clean_days, round(pct_over_who, 6) as pct_over_who,"
                           " round(pct_over_india, 6) as pct_over_india,"
                           " round(avg_cigarettes_day, 6) as avg_cigarettes_day from he"),
    "health_summary": W(obs("pm25"), """
select city, n_days, round(m, 6) as mean_pm25, round(pw, 6) as pct_over_who, round(pi, 6) as pct_over_india,
  round(pc, 6) as pct_clean, round(m / 5.0, 6) as x_who_annual, round(m / 40.0, 6) as x_india_annual,
  round(m / 22.0, 6) as avg_cigarettes_day, round(m / 22.0 * 365, 6) as cigarettes_year
from (select city, count(value) as n_days, avg(value) as m,
        avg(cast(value > 15.0 as double)) * 100.0 as pw, avg(cast(value > 60.0 as double)) * 100.0 as pi,
        avg(cast(value <= 15.0 as double)) * 100.0 as pc from obs group by city) g"""),
    "health_day_classes": W(obs("pm25") + HEALTH,
                            "select city, year, clean_days, days_over_who - days_over_india as over_who_only,"
                            " days_over_india from he"),
    "null_rates": W(NULLS, """
select city, "column", n_missing,
  round(case when n > 0 then n_missing * 100.0 / n else 0.0 end, 1) as pct_missing,
  round(case when n > 0 then n_missing * 100.0 / n else 0.0 end, 6) as pct_missing_exact
from nr"""),
    "dataset_profile": W("", """
select city, count(*) as n_rows, min(date) as first_date, max(date) as last_date, count(aqi) as n_with_value,
  round(count(aqi) * 100.0 / count(*), 6) as pct_with_value from base_day group by city"""),
    "region_filter": W("", "select city, date, " + ", ".join(
        f"round({c}, 6) as {c}" for c in ("pm25", "pm10", "no", "no2", "nox", "nh3", "co", "so2", "o3",
                                          "benzene", "aqi"))
        + ", aqi_bucket from base_day where city in ('ASIA', 'EUROPE', 'ATLANTIS')"),
}
