"""DuckDB SQL of the forecast keys: both least-squares stages, the choice of a
candidate, the recursion and its intervals, written with recursive CTEs.

The normal equations are solved by Gauss-Jordan elimination (they are positive
definite here). A fit is stationary if all its reflection coefficients, found
by stepping its order down, lie between -1 and 1.
"""

from __future__ import annotations

from airlake.operators.forecast import LONG_AR, Z95, candidate_set, cfg_ids
from airlake.plans.sqlgen import d

CANDS = candidate_set()
CFG = cfg_ids(CANDS)
DIFF = {CFG[c.cfg]: c.diff for c in CANDS}
MAX_MA = max(max(c.ma) for c in CANDS if c.ma)
T_MIN = max(len(c.diff) - 1 for c in CANDS) + LONG_AR + MAX_MA


def _list(values, kind: str = "DOUBLE") -> str:
    return "CAST([" + ", ".join(map(repr, values)) + f"] AS {kind}[])"


def differenced(diff: list[float]) -> str:
    return " + ".join(f"{d(c)} * lag(value, {k}) over w" if k else f"{d(c)} * value"
                      for k, c in enumerate(diff) if c)


def features(src: str) -> str:
    """CTE ``feats``: the differenced value w and its lags for each
    differencing, from ``src(city, pos, date, value)``."""
    parts = ",\n".join(
        f"w{i} as (select city, {i} as cfg, {len(diff) - 1} as dlen, pos, date, value, {differenced(diff)} as w "
        f"from {src} window w as (partition by city order by pos))" for i, diff in DIFF.items())
    lags = ", ".join(f"lag(w, {i}) over x as w{i}" for i in range(1, LONG_AR + 1))
    union = " union all ".join(f"select * from w{i}" for i in DIFF)
    return f"""{parts},
wall as ({union}),
feats as (select city, cfg, dlen, pos, date, value, w, {lags}
  from wall window x as (partition by city, cfg order by pos))"""


def solved(name: str, system: str, key: str) -> str:
    """CTE ``name(city, key, i, v)``: the solution of every system in
    ``system(city, key, k, i, j, v)``, j = 0 being the right-hand side."""
    return f"""
{name}_gj as (
  select city, {key}, k, 0 as step, i, j, v from {system}
  union all
  select city, {key}, k, step + 1, i, j,
    case when i = step + 1 then v / p_kk else v - p_ik / p_kk * p_kj end
  from (select *,
      max(case when i = step + 1 and j = step + 1 then v end) over (partition by city, {key}) as p_kk,
      max(case when j = step + 1 then v end) over (partition by city, {key}, i) as p_ik,
      max(case when i = step + 1 then v end) over (partition by city, {key}, j) as p_kj
    from {name}_gj where step < k)),
{name} as (select city, {key}, i, v from {name}_gj where step = k and j = 0)"""


def fits(src: str) -> str:
    """CTEs up to ``best``: the chosen candidate of each city of ``src``."""
    ws = ", ".join(f"w{i}" for i in range(1, LONG_AR + 1))
    picks = " union all ".join(
        f"select city, {c.cid} as cand, {len(c.ar) + len(c.ma)} as k, w, "
        f"[{', '.join([f'w{i}' for i in c.ar] + [f'e{i}' for i in c.ma])}] as x "
        f"from res where cfg = {CFG[c.cfg]} and pos >= {T_MIN}" for c in CANDS)
    shape = ", ".join(f"({c.cid}, {CFG[c.cfg]}, '{c.label}', {_list(c.ar, 'INTEGER')}, {_list(c.ma, 'INTEGER')}, "
                      f"{_list(c.diff)})" for c in CANDS)
    e_lags = ", ".join(f"lag(e, {i}) over x as e{i}" for i in range(1, MAX_MA + 1))
    return features(src) + f""",
s1 as (select city, cfg, [w, {ws}] as x from feats where pos >= dlen + {LONG_AR}),
s1p as (select a.city, a.cfg, i, j, x[i + 1] * x[j + 1] as p from s1 a, range(1, {LONG_AR + 1}) r(i),
  range(0, {LONG_AR + 1}) q(j)),
sys1 as (select city, cfg, {LONG_AR} as k, i, j, sum(p) as v from s1p group by city, cfg, i, j),
{solved("sol1", "sys1", "cfg")},
coef as (select city, cfg, list(v order by i) as a from sol1 group by city, cfg),
res0 as (select f.*, case when pos >= dlen + {LONG_AR} then w - list_dot_product([{ws}], a) end as e
  from feats f join coef using (city, cfg)),
res as (select *, {e_lags} from res0 window x as (partition by city, cfg order by pos)),
x2 as ({picks}),
s2p as (select city, cand, k, i, j, x[i] * (case when j = 0 then w else x[j] end) as p
  from x2, range(1, 30) r(i), range(0, 30) q(j) where i <= k and j <= k),
sys2 as (select city, cand, k, i, j, sum(p) as v from s2p group by city, cand, k, i, j),
{solved("sol2", "sys2", "cand")},
yy as (select city, cand, k, count(*) as n, sum(w * w) as yy from x2 group by city, cand, k),
rss as (select s.city, s.cand, sum(s.v * b.v) as fitted, list(s.v order by s.i) as beta
  from sol2 s join sys2 b on s.city = b.city and s.cand = b.cand and s.i = b.i and b.j = 0 group by s.city, s.cand),
shape(cand, cfg, label, ar, ma, diff) as (values {shape}),
fit as (select city, cand, cfg, label, ar, ma, diff, beta, n, (yy - fitted) / n as sigma2,
    n * ln((yy - fitted) / n) + 2 * (k + 1) as aic
  from yy join rss using (city, cand) join shape using (cand)),
steps as (
  select city, cand, list_max(ar) as k, list_transform(range(1, list_max(ar) + 1), lambda n: list_sum(list_transform(
      range(1, len(ar) + 1), lambda q: case when ar[q] = n then beta[q] else CAST(0 AS DOUBLE) end))) as a
  from fit
  union all
  select city, cand, k - 1,
    list_transform(range(1, k), lambda n: (a[n] + a[k] * a[k - n]) / (1 - a[k] * a[k])) from steps
  where k > 0 and abs(a[k]) < 1),
stationary as (select city, cand from steps where k = 0),
best as (select * from (select *, row_number() over (partition by city order by aic, cand) as rk
  from fit join stationary using (city, cand)) where rk = 1)"""


def forecast(src: str, horizon: int) -> str:
    """CTE ``fc(city, step, date, forecast, lower, upper)``."""
    return fits(src) + f""",
tail as (select b.city, list(r.w order by pos) as w, list(coalesce(r.e, 0) order by pos) as e,
    list(r.value order by pos) as x, max(r.date) as last_date
  from res r join best b on r.city = b.city and r.cfg = b.cfg group by b.city),
walk as (
  select b.city, 0 as step, t.w, t.e, t.x, b.ar, b.ma, b.diff, b.beta, t.last_date, b.sigma2
  from best b join tail t using (city)
  union all
  select city, step + 1, list_append(w, wn), list_append(e, CAST(0 AS DOUBLE)),
    list_append(x, wn - coalesce(list_sum(list_transform(range(1, len(diff)),
      lambda k: diff[k + 1] * x[len(x) - k + 1])), 0)), ar, ma, diff, beta, last_date, sigma2
  from (select *, list_sum(list_concat(
      list_transform(range(1, len(ar) + 1), lambda k: beta[k] * w[len(w) - ar[k] + 1]),
      list_transform(range(1, len(ma) + 1), lambda k: beta[len(ar) + k] * e[len(e) - ma[k] + 1]))) as wn
    from walk where step < {horizon})),
poly as (select city, ar, ma, diff, beta, sigma2, list_transform(range(0, list_max(ar) + 1), lambda n:
    case when n = 0 then CAST(1 AS DOUBLE) else -coalesce(list_sum(list_transform(range(1, len(ar) + 1),
      lambda k: case when ar[k] = n then beta[k] else 0 end)), 0) end) as p from best),
full_ as (select *, list_transform(range(0, len(p) + len(diff) - 1), lambda n: list_sum(list_transform(
    range(1, len(p) + 1), lambda i: case when n - i + 1 between 0 and len(diff) - 1
      then p[i] * diff[n - i + 2] else 0 end))) as f from poly),
psi as (
  select city, 1 as n, [CAST(1 AS DOUBLE)] as v, f, ma, beta, len(ar) as n_ar, sigma2 from full_
  union all
  select city, n + 1, list_append(v, list_sum(list_concat(
      list_transform(range(1, len(ma) + 1), lambda k: case when ma[k] = n then beta[n_ar + k] else 0 end),
      list_transform(range(1, least(n, len(f) - 1) + 1), lambda i: -f[i + 1] * v[n - i + 1])))),
    f, ma, beta, n_ar, sigma2
  from psi where n < {horizon}),
width as (select city, i as step, {d(Z95)} * sqrt(sigma2 * list_sum(list_transform(v[1:i], lambda y: y * y))) as half
  from psi, range(1, {horizon + 1}) r(i) where n = {horizon}),
fc as (select city, step, cast(last_date + cast(step as integer) as date) as date, x[len(x)] as forecast,
    x[len(x)] - half as lower, x[len(x)] + half as upper
  from walk join width using (city, step))"""
