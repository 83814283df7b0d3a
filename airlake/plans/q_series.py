"""Series, decomposition, forecast and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlake.operators import forecast as FC
from airlake.operators import rolling_origin as RO
from airlake.operators import series as SE
from airlake.plans import forecast_sql as FS
from airlake.plans import sqlgen as S
from airlake.plans.base import rounded
from airlake.session import cut_lineage
from airlake.sources import fixtures as X
from airlake.streaming import daily_mean as ST

HORIZON = 30
ORIGIN_STEP, MIN_TRAIN = 240, 730  # days between origins, days before the first
STREAM_POLLUTANTS = ("pm25", "pm10", "no2", "o3", "co")


def _daily(s, d):
    return SE.daily_series(X.base_day(s, d), "aqi", 7)[0]


def _decomposed(s, d, model="additive"):
    return SE.seasonal_decompose(SE.monthly_series(X.base_day(s, d), "pm25", 2), model=model)


def q_naive_backtest(s, d):
    split = FC.split_train_test(_daily(s, d), HORIZON)
    return rounded(FC.forecast_metrics(FC.naive_forecasts(split, HORIZON)))


def q_model_backtest(s, d):
    bt = FC.model_backtest(_daily(s, d), HORIZON)
    labels = FC.candidates_frame(s).select("cand_id", F.col("label").alias("chosen_order"))
    chosen = bt["best"].join(labels, "cand_id").select("city", "chosen_order", "aic")
    return rounded(bt["metrics"].join(chosen, "city", "left"))


def q_model_forecast(s, d):
    series = cut_lineage(_daily(s, d).select("city", "pos", "date", "value"))
    fits, res = FC.fit_candidates(series)
    return rounded(FC.forecast_from_fit(FC.select_order(fits), res, HORIZON))


def q_forecast_verdict(s, d):
    return rounded(FC.forecast_verdict(FC.model_backtest(_daily(s, d), HORIZON)["metrics"]))


def _feats(s, d):
    return FC.features(_daily(s, d), FC.candidate_set())


def q_forecast_features(s, d):
    return rounded(_feats(s, d).select("city", "cfg", "pos", "w", *[f"w{i}" for i in range(1, FC.LONG_AR + 1)]))


def q_forecast_status(s, d):
    """The fits see what the backtest fits: all but the last ``HORIZON`` days."""
    series, status = SE.daily_series(X.base_day(s, d), "aqi", 7)
    train = FC.split_train_test(series, HORIZON).where(~F.col("is_test")).select("city", "pos", "date", "value")
    return FC.forecast_status(cut_lineage(status), HORIZON, FC.fit_candidates(train)[0])


def q_stream_daily_mean(s, d):
    src = f"{d}/events*.parquet"
    schema = X.SCHEMAS["events"]
    return rounded(ST.stream_daily_mean(s, src, schema, X.readings_from_events, STREAM_POLLUTANTS))


def q_stream_closed_days(s, d):
    return rounded(ST.stream_closed_days(s, f"{d}/events*.parquet", X.SCHEMAS["events"], X.readings_from_events,
                                         STREAM_POLLUTANTS))


def q_daily_series_status(s, d):
    return SE.daily_series(X.base_day(s, d), "aqi", 7)[1]


def q_decomposition_status(s, d):
    return SE.decomposition_status(SE.monthly_series(X.base_day(s, d), "pm25", 2))


QUERIES = {
    "daily_series_status": q_daily_series_status,
    "decomposition_status": q_decomposition_status,
    "monthly_series_filled": lambda s, d: rounded(SE.monthly_series(X.sparse_day(s, d), "v", 2)),
    "seasonal_decompose": lambda s, d: rounded(_decomposed(s, d)),
    "seasonal_decompose_mult": lambda s, d: rounded(_decomposed(s, d, "multiplicative")),
    "seasonal_cycle": lambda s, d: rounded(SE.seasonal_cycle(_decomposed(s, d))),
    "daily_series": lambda s, d: rounded(_daily(s, d)),
    "naive_backtest": q_naive_backtest,
    "forecast_features": q_forecast_features,
    "forecast_gram": lambda s, d: rounded(FC.stage1_sums(_feats(s, d))),
    "forecast_status": q_forecast_status,
    "model_backtest": q_model_backtest,
    "model_forecast": q_model_forecast,
    "forecast_verdict": q_forecast_verdict,
    "interval_coverage": lambda s, d: rounded(RO.interval_coverage(
        RO.interval_trials(_daily(s, d), HORIZON, ORIGIN_STEP, MIN_TRAIN))),
    "stream_daily_mean": q_stream_daily_mean,
    "stream_closed_days": q_stream_closed_days,
}

# --------------------------------------------------------------------------- oracle


def filled_series(src: str, step: str, limit: int, run: bool) -> str:
    """CTEs g, pn, f (+ r, runs, best, k when ``run``) over ``m(city, t, value)``."""
    unit = "month" if step == "MONTH" else "day"
    body = f""",
b as (select city, min(t) as lo, max(t) as hi from m group by city),
g0 as (select city, cast(unnest(generate_series(lo, hi, interval 1 {unit})) as date) as t from b),
g as (select g0.city, g0.t, m.value, row_number() over (partition by g0.city order by g0.t) - 1 as pos
      from g0 left join m on g0.city = m.city and g0.t = m.t),
pn as (select *,
         max(case when value is not null then pos end) over (partition by city order by pos
             rows between unbounded preceding and current row) as pp,
         min(case when value is not null then pos end) over (partition by city order by pos
             rows between current row and unbounded following) as np
       from g),
f as (select pn.city, pn.t, pn.pos, pn.value is null as was_missing,
        case when pn.value is not null then pn.value
             when pn.pp is not null and pn.np is not null and pn.pos - pn.pp <= {limit}
             then (gn.value - gp.value) / (pn.np - pn.pp) * (pn.pos - pn.pp) + gp.value end as filled
      from pn left join g gp on gp.city = pn.city and gp.pos = pn.pp
        left join g gn on gn.city = pn.city and gn.pos = pn.np)"""
    if run:
        body += """,
r0 as (select *, case when lag(filled is not null) over (partition by city order by pos) is null
                       or lag(filled is not null) over (partition by city order by pos) <> (filled is not null)
                      then 1 else 0 end as chg from f),
r as (select *, sum(chg) over (partition by city order by pos rows between unbounded preceding and current row)
        as run from r0),
runs as (select city, run, count(*) as len, min(t) as start from r where filled is not null group by 1, 2),
best as (select city, run from (select *, row_number() over (partition by city order by len desc, start) as rk
                                from runs) x where rk = 1),
k0 as (select r.* from r join best on r.city = best.city and r.run = best.run),
k as (select city, t, filled as value, was_missing as interpolated,
        count_if(was_missing) over (partition by city) as n_interpolated,
        count(*) over (partition by city) as n_months,
        cast(row_number() over (partition by city order by t) - 1 as integer) as pos from k0)"""
    return src + body


SPARSE_M = f""",
sparse_day as ({S.SPARSE_DAY}),
m as (select city, cast(date_trunc('month', date) as date) as t, avg(v) as value from sparse_day
      where v is not null group by 1, 2)"""
PM25_M = """,
m as (select city, cast(date_trunc('month', date) as date) as t, avg(pm25) as value from base_day
      where pm25 is not null group by 1, 2)"""
AQI_D = """,
m as (select city, date as t, avg(aqi) as value from base_day where aqi is not null group by 1, 2)"""

DECOMP = filled_series(PM25_M, "MONTH", 2, True) + """,
s as (select * from k where n_months >= 24),
tr as (select *, case when count(value) over w13 = 13 then
         (sum(value) over w13 - 0.5 * (lag(value, 6) over w + lead(value, 6) over w)) / 12.0 end as trend
       from s window w as (partition by city order by t),
         w13 as (partition by city order by t rows between 6 preceding and 6 following)),
dd as (select *, value - trend as dtr, pos % 12 as phase from tr),
ph as (select city, phase, avg(dtr) as sv from dd group by 1, 2),
ph2 as (select city, phase, sv - avg(sv) over (partition by city) as seasonal from ph),
dec as (select dd.city, dd.t as month, dd.value as observed, dd.trend, ph2.seasonal,
          dd.value - dd.trend - ph2.seasonal as resid
        from dd join ph2 on dd.city = ph2.city and dd.phase = ph2.phase)"""

DECOMP_MULT = filled_series(PM25_M, "MONTH", 2, True) + """,
s as (select * from k where n_months >= 24 and city not in (select city from k where value <= 0)),
tr as (select *, case when count(value) over w13 = 13 then
         (sum(value) over w13 - 0.5 * (lag(value, 6) over w + lead(value, 6) over w)) / 12.0 end as trend
       from s window w as (partition by city order by t),
         w13 as (partition by city order by t rows between 6 preceding and 6 following)),
dd as (select *, value / nullif(trend, 0) as dtr, pos % 12 as phase from tr),
ph as (select city, phase, avg(dtr) as sv from dd group by 1, 2),
ph2 as (select city, phase, sv / nullif(avg(sv) over (partition by city), 0) as seasonal from ph),
dec as (select dd.city, dd.t as month, dd.value as observed, dd.trend, ph2.seasonal,
          dd.value / nullif(dd.trend * ph2.seasonal, 0) as resid
        from dd join ph2 on dd.city = ph2.city and dd.phase = ph2.phase)"""

DAILY = filled_series(AQI_D, "DAY", 7, False) + """,
ds0 as (select *, count_if(was_missing) over (partition by city) as n_interpolated,
          count_if(filled is null) over (partition by city) as n_remaining from f),
ds as (select city, t as date, filled as value, was_missing as interpolated, n_interpolated,
         cast(pos as integer) as pos from ds0 where n_remaining = 0)"""

NAIVE = DAILY + f""",
sp as (select * from (select *, count(*) over (partition by city) as n from ds) x where n > {2 * HORIZON}),
test as (select city, date, pos - (n - {HORIZON}) + 1 as step, value as actual from sp where pos >= n - {HORIZON}),
lastv as (select city, value as predicted from sp where pos = n - {HORIZON} - 1),
tl as (select city, pos - (n - {HORIZON} - 7) as kk, value as predicted from sp
       where pos >= n - {HORIZON} - 7 and pos < n - {HORIZON}),
preds as (select t.city, 'persistence' as model, t.actual, l.predicted from test t join lastv l on t.city = l.city
          union all
          select t.city, 'seasonal_naive' as model, t.actual, x.predicted from test t
            join tl x on t.city = x.city and (t.step - 1) % 7 = x.kk)"""

FEATS = DAILY + ",\n" + FS.features("ds")
_WS = ["w", *[f"w{i}" for i in range(1, FC.LONG_AR + 1)]]
GRAM = FEATS + """,
wl as (select city, cfg, pos, unnest([{}]) as x, unnest(range(0, {})) as i from feats where pos >= dlen + {})""".format(
    ", ".join(_WS), FC.LONG_AR + 1, FC.LONG_AR)

STREAM = f""",
readings as ({S.READINGS}),
lg as (select city, ts, 'pm25' as pollutant, pm25 as value from readings union all
       select city, ts, 'pm10', pm10 from readings union all
       select city, ts, 'no2', no2 from readings union all
       select city, ts, 'o3', o3 from readings union all
       select city, ts, 'co', co from readings)"""


METRICS = """
  avg(abs(actual - predicted)) as mae, sqrt(avg((actual - predicted) * (actual - predicted))) as rmse,
  avg(abs((actual - predicted) / nullif(actual, 0))) * 100.0 as mape,
  count(*) as n_test, count_if(actual = 0) as n_mape_skipped"""
BACKTEST = NAIVE + f""",
train as (select city, pos, date, value from sp where pos < n - {HORIZON}),
""" + FS.forecast("train", HORIZON) + f""",
scored as (
  select city, model, {METRICS} from (
    select city, model, actual, predicted from preds
    union all select test.city, 'model' as model, actual, forecast as predicted
      from fc join test on fc.city = test.city and fc.date = test.date) group by city, model)"""


def _w(ctes: str, body: str, base: bool = True) -> str:
    return (f"with recursive {S.base_ctes()}{ctes}" if base else "with " + ctes.lstrip(",\n")) + "\n" + body


STATUS_DAILY = filled_series(AQI_D, "DAY", 7, False) + """,
ds0 as (select *, count_if(was_missing) over (partition by city) as n_interpolated,
          count_if(filled is null) over (partition by city) as n_remaining from f)"""

ORACLE = {
    "forecast_features": _w(FEATS, "select city, cast(cfg as integer) as cfg, pos, "
                            + ", ".join(f"round({w}, 6) as {w}" for w in _WS) + " from feats"),
    "forecast_gram": _w(GRAM, """select a.city, cast(a.cfg as integer) as cfg, cast(a.i as integer) as i,
  cast(b.i as integer) as j, count(*) as n, round(avg(a.x * b.x), 6) as mean
from wl a join wl b on a.city = b.city and a.cfg = b.cfg and a.pos = b.pos and b.i <= a.i
where a.i > 0 group by all"""),
    # every city long enough is expected to have a usable fit here
    "forecast_status": _w(STATUS_DAILY, f"""select city, count(*) as n_days,
  case when max(n_remaining) > 0 then 'gaps_remaining' when count(*) <= {2 * HORIZON} then 'too_short'
    else 'ok' end as status
from ds0 group by city"""),
    "daily_series_status": _w(STATUS_DAILY, """
select city, count(*) as n_days, max(n_interpolated) as n_interpolated, max(n_remaining) as n_remaining,
  case when max(n_remaining) = 0 then 'ok' else 'gaps_remaining' end as status
from ds0 group by city"""),
    "decomposition_status": _w(filled_series(PM25_M, "MONTH", 2, True), """
select city, max(n_months) as n_months, max(n_interpolated) as n_interpolated,
  case when max(n_months) >= 24 then 'ok' else 'too_short' end as status
from k group by city"""),
    "monthly_series_filled": _w(filled_series(SPARSE_M, "MONTH", 2, True),
                                "select city, t as month, round(value, 6) as value, interpolated, n_interpolated,"
                                " n_months, pos from k", base=False),
    "seasonal_decompose": _w(DECOMP, "select city, month, round(observed, 6) as observed, round(trend, 6) as trend,"
                                     " round(seasonal, 6) as seasonal, round(resid, 6) as resid from dec"),
    "seasonal_decompose_mult": _w(DECOMP_MULT, "select city, month, round(observed, 6) as observed,"
                                               " round(trend, 6) as trend, round(seasonal, 6) as seasonal,"
                                               " round(resid, 6) as resid from dec"),
    "seasonal_cycle": _w(DECOMP, f"select city, cast(month(month) as integer) as month_num,"
                                 f" {S.month_name('month(month)')} as month, round(avg(seasonal), 6) as effect"
                                 " from dec group by 1, 2, 3"),
    "daily_series": _w(DAILY, "select city, date, round(value, 6) as value, interpolated, n_interpolated, pos"
                              " from ds"),
    "naive_backtest": _w(NAIVE, """
select city, model, round(avg(abs(actual - predicted)), 6) as mae,
  round(sqrt(avg((actual - predicted) * (actual - predicted))), 6) as rmse,
  round(avg(abs((actual - predicted) / nullif(actual, 0))) * 100.0, 6) as mape,
  count(*) as n_test, count_if(actual = 0) as n_mape_skipped
from preds group by 1, 2"""),
    "model_backtest": _w(BACKTEST, """
select city, model, round(mae, 6) as mae, round(rmse, 6) as rmse, round(mape, 6) as mape, n_test, n_mape_skipped,
  label as chosen_order, round(aic, 6) as aic from scored left join best using (city)"""),
    "model_forecast": _w(DAILY + ",\n" + FS.forecast("ds", HORIZON), """
select city, cast(step as integer) as step, date, round(forecast, 6) as forecast, round(lower, 6) as lower,
  round(upper, 6) as upper from fc"""),
    "forecast_verdict": _w(BACKTEST, """
select city, round(model_mae, 6) as model_mae, round(persistence_mae, 6) as persistence_mae,
  round(seasonal_naive_mae, 6) as seasonal_naive_mae, round(best, 6) as best_naive_mae,
  round(model_mae - best, 6) as delta_vs_best_naive, model_mae < best as beats_naive
from (select city, max(case when model = 'model' then mae end) as model_mae,
    max(case when model = 'persistence' then mae end) as persistence_mae,
    max(case when model = 'seasonal_naive' then mae end) as seasonal_naive_mae,
    least(max(case when model = 'persistence' then mae end), max(case when model = 'seasonal_naive' then mae end))
      as best from scored group by city)"""),
    # the days before each origin are a series of their own, fitted anew
    "interval_coverage": _w(DAILY + f""",
sizes as (select city, count(*) - {HORIZON} as cut from ds group by city),
cuts as (select city, unnest(generate_series({MIN_TRAIN} + (cut - {MIN_TRAIN}) % {ORIGIN_STEP}, cut, {ORIGIN_STEP})) as cut
  from sizes where cut >= {MIN_TRAIN}),
before as (select ds.city || '@' || cut as city, pos, date, value from ds join cuts on ds.city = cuts.city and pos < cut),
""" + FS.forecast("before", HORIZON), """,
tried as (select split_part(fc.city, '@', 1) as city, fc.city as trial, forecast, lower, upper, (upper - lower) / 2 as half,
    value as actual from fc join ds on split_part(fc.city, '@', 1) = ds.city and fc.date = ds.date)
select city, count(distinct trial) as n_origins, count(*) as n_forecasts,
  round(avg(case when actual between lower and upper then 1.0 else 0.0 end) * 100.0, 6) as pct_covered,
  round(avg(half * 2), 6) as mean_width, round(avg(abs(actual - forecast)), 6) as mae,
  round(quantile_cont(abs(actual - forecast) / nullif(half, 0), 0.95), 6) as width_factor
from tried group by city"""),
    "stream_daily_mean": _w(STREAM, "select city, pollutant, cast(ts as date) as date, round(avg(value), 6) as mean,"
                                    " count(value) as n from lg where value is not null group by 1, 2, 3",
                            base=False),
    # one micro-batch: the watermark ends two days behind the newest reading
    "stream_closed_days": _w(STREAM, "select city, pollutant, cast(ts as date) as date, round(avg(value), 6) as mean,"
                                     " count(value) as n from lg where value is not null group by 1, 2, 3"
                                     " having cast(ts as date) + interval 1 day"
                                     " <= (select max(ts) from lg where value is not null) - interval 2 days",
                             base=False),
}
