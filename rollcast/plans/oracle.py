"""DuckDB SQL that gives the rows of the catalogue's queries."""

from __future__ import annotations

import numpy as np

from ..config import THETA_GRID
from ..operators import nulls
from ..sources import synthetic
from .catalogue import ALPHA, BLOCKS, LAGS, PERIOD, R, UNIFORM, W, WEEKLY, X

DAILY = """daily AS (SELECT row_number() OVER (ORDER BY d) AS t, d, y, x1, x2, x3 FROM (
  SELECT CAST(l_shipdate AS DATE) AS d, sum(l_extendedprice) AS y, avg(l_discount) AS x1, avg(l_quantity) AS x2, avg(l_tax) AS x3
  FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1))"""
#: The last row of the library: what is left of n rows without the held-out ones.
END = "(SELECT n - least(greatest(20, CAST(floor(n * 0.2) AS BIGINT)), greatest(10, n // 3)) FROM (SELECT count(*) AS n FROM daily))"
ORDERS = "ord AS (SELECT CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS y, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1)"
HOURS = "hourly AS (SELECT {key} AS series_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, sum(value) AS y, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2)"
TYPES = HOURS.format(key="coalesce(event_type, '')")
SEASON = "CASE WHEN month({d}) IN (12, 1, 2) THEN 'DJF' WHEN month({d}) IN (3, 4, 5) THEN 'MAM' WHEN month({d}) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END"
ORDER = "CASE {s} WHEN 'DJF' THEN 1 WHEN 'MAM' THEN 2 WHEN 'JJA' THEN 3 ELSE 4 END"
#: Source-time alignment with persistence: the forecast of t + 1 is y(t).
LONG = "lg AS (" + " UNION ALL ".join(f"SELECT '{x}' AS feature, t, d, y AS pred, {x} AS x FROM daily" for x in X) + ")"
FRAME = f"(PARTITION BY feature ORDER BY t ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW)"
SCORES = f"""sc AS (SELECT feature, t, d, g, l, row_number() OVER (PARTITION BY feature ORDER BY t) AS i FROM (
  SELECT feature, t, d, corr(x, pred) OVER {FRAME} AS g, count(*) OVER {FRAME} AS c,
    (pred - avg(pred) OVER {FRAME}) / stddev_pop(pred) OVER {FRAME} * corr(x, pred) OVER {FRAME} * (x - avg(x) OVER {FRAME}) / stddev_pop(x) OVER {FRAME} AS l
  FROM lg) WHERE c = {W})"""
#: The shifts of series of as many days as the tables have (a draw depends on the length).
VALUES = ", ".join(f"({n}, {i}, {s})" for n in (2289, 2499) for i, s in enumerate(nulls.periodic_shifts(n, R, PERIOD, 0)))
NULLS = f"""sh AS (SELECT perm, s FROM (VALUES {VALUES}) v(n, perm, s) WHERE n = (SELECT count(*) FROM daily)), num AS (SELECT feature, t, x, pred, row_number() OVER (PARTITION BY feature ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY feature) AS n FROM lg),
rolled AS (SELECT a.feature, perm, a.i, a.t, a.x, b.pred FROM num a, sh JOIN num b ON b.feature = a.feature AND b.i = ((a.i - s) % a.n + a.n) % a.n),
nl AS (SELECT feature, perm, t, i, gr FROM (SELECT feature, perm, t, i, corr(x, pred) OVER (PARTITION BY feature, perm ORDER BY i ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW) AS gr FROM rolled) WHERE i >= {W - 1})"""
PV = f"""pv AS (SELECT sc.feature, sc.t, sc.d, sc.g, quantile_cont(gr, 0.025) AS lo, quantile_cont(gr, 0.975) AS hi,
  (count(*) FILTER (abs(round(gr, 9)) >= abs(round(g, 9))) + 1) / {R + 1}.0::DOUBLE AS p
  FROM sc JOIN nl ON nl.feature = sc.feature AND nl.t = sc.t GROUP BY ALL)"""


def bh(source: str, over: str, alpha: float, p: str = "p", flag: str = "sig", m: str | None = None) -> str:
    m = m or f"count({p}) OVER (PARTITION BY {over})"
    return f"""SELECT * EXCLUDE (k, m, cut), coalesce({p} <= cut, false) AS {flag} FROM (
  SELECT *, max(CASE WHEN {p} <= {alpha} * k / m THEN {p} END) OVER (PARTITION BY {over}) AS cut FROM (
    SELECT *, row_number() OVER (PARTITION BY {over} ORDER BY {p} NULLS LAST) AS k, {m} AS m FROM {source}))"""


SIG = f"sg AS ({bh('pv', 't', ALPHA)})"
ISLANDS = """isl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY d) - row_number() OVER (PARTITION BY feature, sig ORDER BY d) AS island FROM sg) WHERE sig)"""
ALL = ", ".join([DAILY, LONG, SCORES, NULLS, PV, SIG, ISLANDS])
HOLES = f"{DAILY}, hol AS (SELECT t, d, y, CASE WHEN t % 11 = 0 THEN NULL ELSE x1 END AS x1, x2, CASE WHEN t % 13 = 0 THEN 0.0 ELSE x3 END AS x3 FROM daily)"
HLONG = "hl AS (" + " UNION ALL ".join(f"SELECT '{x}' AS variable, t, d, {x} AS x FROM hol" for x in X) + ")"
BASE = f"""tps(tp) AS (VALUES (1), (3), (7), (14)), fc AS (
  SELECT 'B1_mean' AS model, CAST(tp AS INTEGER) AS tp, t, y AS obs, (SELECT avg(y) FROM daily WHERE t <= {END}) AS pred FROM daily, tps WHERE t > {END}
  UNION ALL SELECT 'B2_persistence', CAST(tp AS INTEGER), a.t, a.y, b.y FROM tps, daily a JOIN daily b ON b.t = a.t - tp WHERE a.t > {END}),
met AS (SELECT model, tp, count(*) AS n, CASE WHEN stddev_pop(pred) > 1e-12 * max(abs(pred)) THEN corr(obs, pred) END AS rho, avg(abs(pred - obs)) AS mae, sqrt(avg((pred - obs) ^ 2)) AS rmse, avg(pred - obs) AS bias FROM fc GROUP BY 1, 2)"""


def known() -> str:
    """The synthetic system from its raw normal draws alone: the drivers' recursion, z-scores,
    regimes, signal and sum are SQL."""
    n, c = 900, synthetic
    rng = np.random.default_rng(0)
    shock, noise = rng.standard_normal((2, n)), rng.standard_normal(n)
    rows = ", ".join(f"({t}, {float(shock[0, t])!r}::DOUBLE, {float(shock[1, t])!r}::DOUBLE, {float(noise[t])!r}::DOUBLE)" for t in range(n))
    step = lambda v: "CASE " + " ".join(f"WHEN t >= {a} THEN {x}::DOUBLE" for a, x in reversed(list(zip(c.SWITCHES, v)))) + " END"
    return f"""raw(t, s1, s2, e) AS (VALUES {rows}),
dr(t, d1, d2) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT raw.t, {c.CARRY} * d1 + s1, {c.CARRY} * d2 + {c.CROSS} * ({c.CARRY} * d1 + s1) + sqrt(1 - {c.CROSS}::DOUBLE * {c.CROSS}) * s2 FROM dr JOIN raw ON raw.t = dr.t + 1),
zs AS (SELECT t, (d1 - avg(d1) OVER ()) / stddev_pop(d1) OVER () AS x1, (d2 - avg(d2) OVER ()) / stddev_pop(d2) OVER () AS x2, {step(c.ALPHA)} AS true_alpha, {step(c.BETA)} AS true_beta FROM dr),
sg AS (SELECT *, coalesce(lag(true_alpha * x1 + true_beta * x2 + {c.SEASONAL} * sin(2 * pi() * t / {c.SEASON_ROWS})) OVER (ORDER BY t), 0) AS deterministic_signal FROM zs),
syn AS (SELECT t + 1 AS t, CASE WHEN t = 0 THEN 0.0 ELSE deterministic_signal + {c.NOISE} * e END AS y, x1, x2, true_alpha, true_beta, deterministic_signal, {c.NOISE} * e AS noise FROM sg JOIN raw USING (t))"""


def recovered(x: str, truth: str) -> str:
    w = f"(ORDER BY t ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW)"
    return f"SELECT 'all' AS series_id, '{x}' AS feature, {r(f'corr(g, {truth})', 'corr_with_truth')} FROM (SELECT t, {truth}, corr({x}, yh) OVER {w} AS g FROM (SELECT *, lead(deterministic_signal) OVER (ORDER BY t) AS yh FROM syn) WHERE yh IS NOT NULL) WHERE t >= {W}"


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def members(step: int) -> str:
    """Window members (feature, e, j, d, zx, zy, n): z-scored in the window."""
    return f"""{DAILY}, {LONG}, num AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY t) AS i, count(*) OVER (PARTITION BY feature) AS nn FROM lg),
mem AS (SELECT a.feature, e.i AS e, a.i - e.i + {W - 1} AS j, a.d, a.x, a.pred FROM num e JOIN num a ON a.feature = e.feature AND a.i BETWEEN e.i - {W - 1} AND e.i WHERE e.i >= {W} AND (e.i - {W}) % {step} = 0),
z AS (SELECT feature, e, j, d, (x - avg(x) OVER w) / coalesce(nullif(stddev_pop(x) OVER w, 0), 1) AS zx, (pred - avg(pred) OVER w) / coalesce(nullif(stddev_pop(pred) OVER w, 0), 1) AS zy, count(*) OVER w AS n FROM mem WINDOW w AS (PARTITION BY feature, e))"""


def shifted(cfg) -> str:
    rows = ", ".join(f"({i}, {s})" for i, s in enumerate(nulls.window_shifts(W, cfg.replicates, cfg.seed, cfg.preserve_weekly)))
    return f"""sh(perm, s) AS (VALUES {rows}), pm AS (SELECT a.feature, a.e, perm, a.zx, b.zy FROM z a, sh JOIN z b ON b.feature = a.feature AND b.e = a.e AND b.j = ((a.j - s) % a.n + a.n) % a.n)"""


def blocks(cfg) -> str:
    rows = ", ".join(str(x) for x in nulls.run_orders(5, cfg.replicates, cfg.seed))
    return f"""po(k, perm, pos, run) AS (VALUES {rows}),
lab AS (SELECT *, CASE WHEN strftime(d, '%Y-%m') <> lag(strftime(d, '%Y-%m')) OVER (PARTITION BY feature, e ORDER BY j) THEN 1 ELSE 0 END AS c FROM z),
rn AS (SELECT *, sum(c) OVER (PARTITION BY feature, e ORDER BY j ROWS UNBOUNDED PRECEDING) AS run FROM lab),
rl AS (SELECT *, count(*) OVER (PARTITION BY feature, e) AS k FROM (SELECT feature, e, run, count(*) AS len, min(j) AS first FROM rn GROUP BY ALL)),
mv AS (SELECT rl.feature, rl.e, rl.run, perm, first, coalesce(sum(len) OVER (PARTITION BY rl.feature, rl.e, perm ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM rl JOIN po ON po.k = rl.k AND po.run = rl.run),
yy AS (SELECT rn.feature, rn.e, perm, start + j - first AS j, zy FROM rn JOIN mv ON mv.feature = rn.feature AND mv.e = rn.e AND mv.run = rn.run),
pm AS (SELECT z.feature, z.e, perm, zx, yy.zy FROM z JOIN yy ON yy.feature = z.feature AND yy.e = z.e AND yy.j = z.j)"""


def window_null(cfg, form: str) -> str:
    return f"""WITH {members(1)}, {form},
ob AS (SELECT feature, e, sum(zx * zy) / sum(zy * zy) AS g FROM z GROUP BY ALL),
nl AS (SELECT feature, e, perm, sum(zx * zy) / (sum(zy * zy) + {cfg.ridge}) AS gr FROM pm GROUP BY ALL)
SELECT e, feature, {r('g', 'g')}, {r('quantile_cont(gr, 0.025)', 'lo')}, {r('quantile_cont(gr, 0.975)', 'hi')},
  {r(f'(count(*) FILTER (abs(round(gr, 9)) >= abs(round(g, 9))) + 1) / {cfg.replicates + 1}.0::DOUBLE', 'p')}
FROM ob JOIN nl USING (feature, e) GROUP BY e, feature, g"""


def adjusted(x: str) -> str:
    return f"{r(f'CASE WHEN count({x}) > 2 THEN skewness({x}) END', 'skewness', 5)}, {r(f'CASE WHEN count({x}) > 3 THEN kurtosis({x}) END', 'kurtosis', 5)}"


def line_map(theta: float, digits: int) -> str:
    return f"""WITH {DAILY}, dd AS (SELECT t, x2 AS x, lead(x2) OVER (ORDER BY t) AS y FROM daily),
p AS (SELECT b.t, b.y AS obs, b.x AS x0, a.x - b.x AS u, a.y, abs(a.x - b.x) AS d FROM dd b JOIN dd a ON a.t <> b.t AND a.t <= {END} AND a.y IS NOT NULL WHERE b.t > {END}),
w AS (SELECT *, exp(-2 * {theta} * d / avg(d) OVER (PARTITION BY t)) AS w FROM p),
m AS (SELECT t, any_value(obs) AS obs, sum(w) AS s, sum(w * u) AS su, sum(w * y) AS sy, sum(w * u * u) AS suu, sum(w * u * y) AS suy FROM w GROUP BY t),
f AS (SELECT t + 1 AS t_pred, obs, s, su, sy, (s * suy - su * sy) / (s * suu - su * su) AS slope FROM m)
SELECT t_pred, {r('obs', 'obs', digits)}, {r('(sy - slope * su) / s', 'pred', digits)}, {r('slope', 'slope', digits)} FROM f"""


def plane_map(theta: float, digits: int) -> str:
    """The local map of two states (x2, x1) by its normal equations in closed form: moments are
    centred at the point, so the forecast is the intercept, and Cramer's rule gives the rest."""
    det = lambda a, b, c, d, e, f, g, h, i: f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"
    m, y = ("s", "su", "sv", "su", "suu", "suv", "sv", "suv", "svv"), ("sy", "suy", "svy")
    solved = [det(*[y[k // 3] if k % 3 == column else m[k] for k in range(9)]) for column in range(3)]
    return f"""WITH {DAILY}, dd AS (SELECT t, x2 AS x, x1 AS z, lead(x2) OVER (ORDER BY t) AS y FROM daily),
p AS (SELECT b.t, b.y AS obs, a.x - b.x AS u, a.z - b.z AS v, a.y, sqrt((a.x - b.x) ^ 2 + (a.z - b.z) ^ 2) AS d FROM dd b JOIN dd a ON a.t <> b.t AND a.t <= {END} AND a.y IS NOT NULL WHERE b.t > {END}),
w AS (SELECT *, exp(-2 * {theta} * d / avg(d) OVER (PARTITION BY t)) AS w FROM p),
m AS (SELECT t, any_value(obs) AS obs, sum(w) AS s, sum(w * u) AS su, sum(w * v) AS sv, sum(w * u * u) AS suu, sum(w * u * v) AS suv, sum(w * v * v) AS svv, sum(w * y) AS sy, sum(w * u * y) AS suy, sum(w * v * y) AS svy FROM w GROUP BY t),
f AS (SELECT t + 1 AS t_pred, obs, {solved[0]} / {det(*m)} AS pred, {solved[1]} / {det(*m)} AS bx, {solved[2]} / {det(*m)} AS bz FROM m)
SELECT t_pred, {r('obs', 'obs', digits)}, {r('pred', 'pred', digits)}, {r('bx', 'slope_x2', digits)}, {r('bz', 'slope_x1', digits)} FROM f"""


def agreement(theta: float) -> str:
    """Rolling scores against the local map's coefficients of x1 and x2 beside y. The weighted
    mean is taken out, which leaves three normal equations, and Cramer's rule solves them.
    y counts in millions, x1 in hundredths, which scales the correlations' inputs only."""
    cols, of = ("a", "b", "c"), "PARTITION BY t"
    det = lambda m: f"({m[0]} * ({m[4]} * {m[8]} - {m[5]} * {m[7]}) - {m[1]} * ({m[3]} * {m[8]} - {m[5]} * {m[6]}) + {m[2]} * ({m[3]} * {m[7]} - {m[4]} * {m[6]}))"
    m = [f"m{min(i, j)}{max(i, j)}" for i in cols for j in cols]
    solved = [f"{det([f'm{cols[k // 3]}y' if k % 3 == column else m[k] for k in range(9)])} / {det(m)}" for column in (1, 2)]
    pairs = ", ".join(f"sum(w * {i} * {j}) AS m{i}{j}" for i, j in ("aa", "ab", "ac", "bb", "bc", "cc", "ay", "by", "cy"))
    mean = ", ".join(f"{c} - sum(w * {c}) OVER ({of}) / sum(w) OVER ({of}) AS {c}" for c in ("a", "b", "c", "y"))
    return f"""WITH {DAILY}, {LONG}, {SCORES}, dd AS (SELECT t, y, x1, x2, lead(y) OVER (ORDER BY t) AS nx FROM daily),
p AS (SELECT b.t, (a.y - b.y) / 1e6 AS a, (a.x1 - b.x1) * 100 AS b, a.x2 - b.x2 AS c, a.nx / 1e6 AS y, sqrt((a.y - b.y) ^ 2 + (a.x1 - b.x1) ^ 2 + (a.x2 - b.x2) ^ 2) AS d FROM dd b JOIN dd a ON a.t <> b.t AND a.t <= {END} AND a.nx IS NOT NULL WHERE b.t > {END}),
k AS (SELECT *, exp(-2 * {theta} * d / avg(d) OVER ({of})) AS w FROM p), ce AS (SELECT t, w, {mean} FROM k),
mo AS (SELECT t, {pairs} FROM ce GROUP BY t),
co AS (SELECT t, 'x1' AS feature, {solved[0]} AS coefficient FROM mo UNION ALL SELECT t, 'x2', {solved[1]} FROM mo)
SELECT 'all' AS series_id, feature, count(*) AS n, {r('corr(g, coefficient)', 'corr')} FROM sc JOIN co USING (t, feature) GROUP BY feature"""


def line_sweep() -> str:
    one = " UNION ALL ".join(f"SELECT {th}::DOUBLE AS theta, obs, pred FROM ({line_map(th, 12)})" for th in THETA_GRID)
    return f"SELECT theta, count(*) AS n, {r('corr(obs, pred)', 'rho', 5)}, {r('avg(abs(pred - obs))', 'mae', 5)}, {r('sqrt(avg((pred - obs) ^ 2))', 'rmse', 5)}, {r('avg(pred - obs)', 'bias', 5)} FROM ({one}) WHERE obs IS NOT NULL GROUP BY theta"


def neighbours(e: int) -> str:
    """Forecasts (t_pred, obs, pred) of the simplex with e lags of x2."""
    lags = ", ".join(f"lag(x2, {j}) OVER (ORDER BY t) AS s{j}" for j in range(e))
    dist = " + ".join(f"(a.s{j} - b.s{j}) ^ 2" for j in range(e))
    return f"""SELECT t + 1 AS t_pred, any_value(obs) AS obs, sum(w * y) / sum(w) AS pred FROM (
  SELECT t, obs, y, CASE WHEN d0 > 0 THEN greatest(exp(-dist / nullif(d0, 0)), 1e-6) WHEN dist = 0 THEN 1.0 ELSE 1e-6 END AS w FROM (
    SELECT *, min(dist) OVER (PARTITION BY t) AS d0 FROM (
      SELECT b.t, b.y AS obs, a.y, sqrt({dist}) AS dist, row_number() OVER (PARTITION BY b.t ORDER BY sqrt({dist}), a.t) AS rn
      FROM st b JOIN st a ON a.t <> b.t AND a.t <= {END} AND a.y IS NOT NULL AND a.s{e - 1} IS NOT NULL WHERE b.t > {END})
    WHERE rn <= {e + 1}))
GROUP BY t""".replace("FROM st b JOIN st a", f"FROM (SELECT t, lead(x2) OVER (ORDER BY t) AS y, {lags} FROM daily) b JOIN (SELECT t, lead(x2) OVER (ORDER BY t) AS y, {lags} FROM daily) a")


SWEEP = " UNION ALL ".join(f"SELECT CAST({e} AS INTEGER) AS e, corr(obs, pred) AS rho FROM ({neighbours(e)})" for e in range(1, 11))
SEA = SEASON.format(d="d")
RANKS = "(b * 7919 + slot * 104729 + grp * 1299709 + 1) % 2147483647"
for _step in (48271, 69621, 39373):
    RANKS = f"({RANKS} * {_step} + 12345) % 2147483647"

ORACLES: dict[str, str] = {
    "q_daily_series": f"WITH {DAILY} SELECT t, CAST(d AS VARCHAR) AS d, {r('y', 'y', 2)}, " + ", ".join(r(x, x) for x in X) + " FROM daily",
    "q_hourly_series": f"WITH {HOURS.format(key=chr(39) + 'all' + chr(39))} SELECT row_number() OVER (ORDER BY h) AS t, h, {r('y', 'y', 4)}, n FROM hourly",
    "q_hourly_by_type": f"WITH {TYPES} SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY h) AS t, h, {r('y', 'y', 4)}, n FROM hourly",
    "q_regular_calendar": f"WITH {ORDERS}, g AS (SELECT CAST(unnest(generate_series((SELECT min(d) FROM ord), (SELECT max(d) FROM ord), INTERVAL 1 DAY)) AS DATE) AS d) SELECT CAST(g.d AS VARCHAR) AS d, {r('y', 'y', 2)}, coalesce(n, 0) AS n, y IS NULL AS missing FROM g LEFT JOIN ord USING (d)",
    "q_time_index_modes": f"WITH {ORDERS} SELECT CAST(d AS VARCHAR) AS d, row_number() OVER (ORDER BY d) AS t_ordinal, CAST(date_diff('day', min(d) OVER (), d) + 1 AS BIGINT) AS t_calendar FROM ord",
    "q_first_k_years": f"WITH {DAILY} SELECT t, CAST(d AS VARCHAR) AS d FROM daily WHERE d < (SELECT min(d) + INTERVAL 2 YEAR FROM daily)",
    "q_season_label": f"WITH {DAILY} SELECT t, {SEA} AS season, CAST({ORDER.format(s=SEA)} AS INTEGER) AS season_order FROM daily",
    "q_block_labels": f"WITH {DAILY} SELECT t, strftime(d, '%Y-%m') AS month, year(d) || 'Q' || quarter(d) AS quarter, year(d) || '-' || {SEA} AS season FROM daily",
    "q_ordinal_dates": f"WITH {ORDERS}, k AS (SELECT row_number() OVER (ORDER BY d) AS t, min(d) OVER () AS first FROM ord) SELECT t, CAST(first + CAST(t - 1 AS INTEGER) AS VARCHAR) AS d FROM k",
    "q_clean_labels": r"SELECT regexp_replace(o_orderpriority, '[^\p{L}\p{N}_.\-]', '_', 'g') AS label, count(*) AS n FROM orders GROUP BY 1",
    "q_prediction_columns": f"WITH {DAILY} SELECT t AS t_pred, {r('x1', 'obs')}, {r('CASE WHEN t % 5 = 0 THEN NULL ELSE x2 END', 'pred')} FROM daily",
    "q_zscore": f"WITH {DAILY} SELECT t, {r('(y - avg(y) OVER ()) / stddev_pop(y) OVER ()', 'z_y')}, {r('(x1 - avg(x1) OVER ()) / stddev_pop(x1) OVER ()', 'z_x1')} FROM daily",
    "q_rolling_mean_std": f"WITH {DAILY} SELECT t, {r('CASE WHEN t >= 30 THEN avg(x1) OVER w END', 'x1_mean')}, {r('CASE WHEN t >= 30 THEN nullif(stddev_pop(x1) OVER w, 0) END', 'x1_sd')} FROM daily WINDOW w AS (ORDER BY t ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)",
    "q_align_source_time": f"WITH {DAILY} SELECT t AS t_src, CAST(d AS VARCHAR) AS d, t + 1 AS t_pred, {r('lead(y) OVER (ORDER BY t)', 'obs', 2)}, {r('y', 'pred', 2)}, " + ", ".join(r(x, x) for x in X) + " FROM daily",
    "q_align_prediction_time": f"WITH {DAILY} SELECT a.t AS t_src, b.t AS t_pred, CAST(b.d AS VARCHAR) AS d, {r('a.y', 'pred', 2)}, {r('a.x1', 'x1')} FROM daily a JOIN daily b ON b.t = a.t + 7",
    "q_persistence": f"WITH {DAILY} SELECT b.t AS t_pred, {r('b.y', 'obs', 2)}, {r('a.y', 'pred', 2)} FROM daily a JOIN daily b ON b.t = a.t + 7",
    "q_mean_baseline": f"WITH {DAILY} SELECT t AS t_pred, {r('y', 'obs', 2)}, {r(f'(SELECT avg(y) FROM daily WHERE t <= {END})', 'pred', 2)} FROM daily WHERE t > {END}",
    "q_forecast_metrics": f"WITH {DAILY}, {BASE} SELECT model, tp, n, {r('rho', 'rho')}, {r('mae', 'mae', 2)}, {r('rmse', 'rmse', 2)}, {r('bias', 'bias', 2)} FROM met",
    "q_skill_scores": f"WITH {DAILY}, {BASE} SELECT model, tp, {r('''1 - rmse / max(CASE WHEN model = 'B1_mean' THEN rmse END) OVER (PARTITION BY tp)''', 'skill_vs_b1')}, {r('''1 - rmse / max(CASE WHEN model = 'B2_persistence' THEN rmse END) OVER (PARTITION BY tp)''', 'skill_vs_b2')} FROM met",
    "q_rolling_score": f"WITH {DAILY}, {LONG}, {SCORES} SELECT feature, t AS t_src, CAST(d AS VARCHAR) AS d, {r('g', 'g')} FROM sc",
    "q_local_score": f"WITH {DAILY}, {LONG}, {SCORES} SELECT feature, t AS t_src, {r('l', 'l')} FROM sc",
    "q_endpoint_stride": f"WITH {DAILY}, {LONG}, {SCORES} SELECT feature, t AS t_src, {r('g', 'g')} FROM sc WHERE (i - 1) % 7 = 0",
    "q_multi_series_score": f"WITH {TYPES}, s AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY h) AS t, n, y FROM hourly) SELECT series_id, t AS t_src, {r('g', 'g', 5)} FROM (SELECT series_id, t, corr(n, y) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) AS g FROM s) WHERE t >= 48",
    "q_inverse_operator_raw": f"WITH {members(1)}, k AS (SELECT z.feature, z.e, z.j, zx, pred / 1e6 AS y FROM z JOIN mem ON mem.feature = z.feature AND mem.e = z.e AND mem.j = z.j) SELECT e, feature, {r('sum(zx * y) / sum(y * y)', 'g')}, {r('sum(zx * y) / sum(y * y) * max(CASE WHEN j = 89 THEN zx * y END)', 'l')} FROM k GROUP BY 1, 2",
    "q_equivalence": f"WITH {members(1)}, k AS (SELECT feature, e, corr(zx, zy) AS g FROM z GROUP BY ALL) SELECT feature, count(*) AS n_windows, {r('avg(g)', 'mean')}, {r('stddev_samp(g)', 'sd')}, 0.0::DOUBLE AS max_difference FROM k GROUP BY 1",
    "q_circular_null": f"WITH {DAILY}, {LONG}, {NULLS} SELECT feature, CAST(perm AS INTEGER) AS perm, t AS t_src, {r('gr', 'gr')} FROM nl",
    "q_envelope": f"WITH {ALL} SELECT feature, t AS t_src, {r('lo', 'lo')}, {r('hi', 'hi')} FROM pv",
    "q_pvalues": f"WITH {ALL} SELECT feature, t AS t_src, {r('p', 'p')} FROM pv",
    "q_window_null_uniform": window_null(UNIFORM, shifted(UNIFORM)),
    "q_window_null_weekly": window_null(WEEKLY, shifted(WEEKLY)),
    "q_window_null_block": window_null(BLOCKS, blocks(BLOCKS)),
    "q_fdr_pointwise": f"WITH {ALL} SELECT feature, t AS t_src, sig FROM sg",
    "q_fdr_over_time": f"WITH {ALL}, a AS ({bh('pv', 'feature', 0.5)}), b AS (SELECT *, CASE WHEN t % 10 > 0 THEN p END AS q FROM a), c AS ({bh('b', 'feature', 0.5, 'q', 'sig_all', 'count(*) OVER (PARTITION BY feature)')}) SELECT feature, t AS t_src, sig, sig_all FROM c",
    "q_segments": f"WITH {ALL} SELECT feature, t AS t_src, island FROM isl",
    "q_interval_table": f"WITH {ALL} SELECT feature, CAST(min(d) AS VARCHAR) AS start_date, CAST(max(d) AS VARCHAR) AS end_date, count(*) AS n, {r('avg(g)', 'mean')}, {r('median(g)', 'median')}, {r('min(g)', 'min')}, {r('max(g)', 'max')} FROM isl GROUP BY feature, island",
    "q_significance_by_season": f"WITH {ALL} SELECT feature, {SEA} AS season, count(*) AS n_timepoints, count(*) FILTER (sig) AS n_significant, {r('avg(CASE WHEN sig THEN 1.0::DOUBLE ELSE 0 END)', 'prop_significant')}, {r('median(sign(g)::DOUBLE)', 'median_sign_all')}, {r('avg(g)', 'mean_contribution_all')}, {r('avg(CASE WHEN sig THEN g END)', 'mean_contribution_significant')} FROM sg GROUP BY 1, 2",
    "q_primary_stats": f"WITH {HOLES}, {HLONG} SELECT variable, count(*) AS n_total, count(x) AS n_nonmissing, count(*) FILTER (x IS NULL) AS n_missing, count(*) FILTER (x = 0) AS n_zero, {r('avg(x)', 'mean')}, {r('stddev_samp(x)', 'sd')}, {r('min(x)', 'min')}, {r('median(x)', 'median')}, {r('max(x)', 'max')}, {adjusted('x')} FROM hl GROUP BY 1",
    "q_overview": f"WITH {HOLES}, {HLONG}, c AS (SELECT min(d) AS a, max(d) AS b, min(d) + INTERVAL 1 YEAR AS e FROM hol) SELECT variable, CAST(min(d) FILTER (d < e) AS VARCHAR) AS time_start, CAST(max(d) FILTER (d < e) AS VARCHAR) AS time_end, count(x) FILTER (d < e) AS n_used, count(*) FILTER (x = 0 AND d < e) AS zero_used, CAST(a AS VARCHAR) AS raw_start, CAST(b AS VARCHAR) AS raw_end, count(*) AS n_raw, count(*) FILTER (x IS NULL) AS missing_raw FROM hl, c GROUP BY variable, a, b",
    "q_seasonal_stats": f"WITH {HOLES}, {HLONG} SELECT variable, {SEA} AS season, count(x) AS n, {r('avg(x)', 'mean')}, {r('stddev_samp(x)', 'sd')}, {r('median(x)', 'median')}, {adjusted('x')}, CAST({ORDER.format(s=SEA)} AS INTEGER) AS season_order FROM hl GROUP BY 1, 2, season_order",
    "q_autocorr": f"WITH {HOLES}, {HLONG}, lags(lag, lag_steps) AS (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {v}::BIGINT)' for k, v in LAGS.items())}), v AS (SELECT DISTINCT variable FROM hl) SELECT v.variable, lag, lag_steps, count(a.x) FILTER (b.x IS NOT NULL) AS n_pairs, {r('CASE WHEN count(a.x) FILTER (b.x IS NOT NULL) > 2 THEN corr(a.x, b.x) END', 'autocorr')} FROM v, lags LEFT JOIN hl a ON a.variable = v.variable LEFT JOIN hl b ON b.variable = a.variable AND b.t = a.t - lag_steps GROUP BY 1, 2, 3",
    "q_crosscorr": f"WITH {HOLES} " + " UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, {r(f'corr({a}, {b})', 'corr')} FROM hol" for a in ["y", *X] for b in ["y", *X]),
    "q_design_snr": f"WITH {DAILY} SELECT {r('corr(x1, x2)', 'corr_x1_x2')}, {r('var_pop(x2)', 'signal_variance')}, {r('var_pop(x3)', 'noise_variance')}, {r('var_pop(x2) / var_pop(x3)', 'snr', 2)}, {r('corr(y, x2)', 'corr_y_signal')} FROM daily",
    "q_lag_embed": f"WITH {DAILY} SELECT t, {r('s0', 's0')}, {r('s1', 's1')}, {r('s2', 's2')} FROM (SELECT t, x2 AS s0, lag(x2) OVER (ORDER BY t) AS s1, lag(x2, 2) OVER (ORDER BY t) AS s2 FROM daily) WHERE t >= 3",
    "q_simplex": f"WITH {DAILY} SELECT t_pred, {r('obs', 'obs', 5)}, {r('pred', 'pred', 5)} FROM ({neighbours(2)})",
    "q_embed_dimension": f"WITH {DAILY} SELECT e, {r('rho', 'rho', 5)} FROM ({SWEEP})",
    "q_param_select": f"WITH {DAILY} SELECT e, {r('rho', 'rho', 5)} FROM ({SWEEP}) ORDER BY rho DESC, e LIMIT 1",
    "q_smap_theta0": f"WITH {DAILY}, dd AS (SELECT t, x2 AS x, lead(x2) OVER (ORDER BY t) AS y FROM daily), f AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM dd WHERE t <= {END}) SELECT t + 1 AS t_pred, {r('y', 'obs')}, {r('b + a * x', 'pred')}, {r('a', 'slope')} FROM dd, f WHERE t > {END}",
    "q_smap_1d": line_map(2.0, 5),
    "q_smap": line_map(2.0, 5),
    "q_smap_multivariate": plane_map(2.0, 4),
    "q_smap_coefficients": agreement(1.0),
    "q_theta_sweep": line_sweep(),
    "q_interpolate_limited": f"WITH {TYPES}, k AS (SELECT series_id, unnest(generate_series(min(h), max(h))) AS h FROM hourly GROUP BY 1), g AS (SELECT k.series_id, k.h, y, n FROM k LEFT JOIN hourly USING (series_id, h)), f AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN h END IGNORE NULLS) OVER b AS pt, last_value(y IGNORE NULLS) OVER b AS pv, first_value(CASE WHEN y IS NOT NULL THEN h END IGNORE NULLS) OVER a AS qt, first_value(y IGNORE NULLS) OVER a AS qv FROM g WINDOW b AS (PARTITION BY series_id ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY series_id ORDER BY h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT series_id, h, {r('CASE WHEN y IS NOT NULL THEN y WHEN coalesce(h - pt <= 2, false) OR coalesce(qt - h <= 2, false) THEN coalesce(pv + (qv - pv) * (h - pt) / (qt - pt), pv, qv) END', 'y', 7)}, n IS NULL AS filled_or_missing FROM f",
    "q_regularised_series": f"WITH {TYPES}, k AS (SELECT series_id, unnest(generate_series(min(h), max(h))) AS h FROM hourly GROUP BY 1), g AS (SELECT k.series_id, k.h, y FROM k LEFT JOIN hourly USING (series_id, h)), f AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN h END IGNORE NULLS) OVER b AS pt, last_value(y IGNORE NULLS) OVER b AS pv, first_value(CASE WHEN y IS NOT NULL THEN h END IGNORE NULLS) OVER a AS qt, first_value(y IGNORE NULLS) OVER a AS qv FROM g WINDOW b AS (PARTITION BY series_id ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY series_id ORDER BY h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), i AS (SELECT series_id, h, CASE WHEN y IS NOT NULL THEN y WHEN coalesce(h - pt <= 1, false) OR coalesce(qt - h <= 1, false) THEN coalesce(pv + (qv - pv) * (h - pt) / (qt - pt), pv, qv) END AS y FROM f) SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY h) AS t, h, {r('y', 'y', 7)} FROM i WHERE y IS NOT NULL",
    "q_synthetic_series": f"WITH RECURSIVE {known()} SELECT 'all' AS series_id, t::BIGINT AS t, CAST(DATE '2000-01-01' + (t - 1) AS VARCHAR) AS date, " + ", ".join(r(c, c) for c in synthetic.COLUMNS) + " FROM syn",
    "q_synthetic_recovery": f"WITH RECURSIVE {known()} {recovered('x1', 'true_alpha')} UNION ALL {recovered('x2', 'true_beta')}",
    "q_cliffs_delta": "WITH v AS (SELECT n_chars::DOUBLE AS v, toxic FROM labels JOIN documents USING (doc_id)), a AS (SELECT v FROM v WHERE toxic = 1), b AS (SELECT v FROM v WHERE toxic = 0) SELECT (SELECT count(*) FROM a) AS n_high, (SELECT count(*) FROM b) AS n_low, round(avg(sign(a.v - b.v)::DOUBLE), 6) + 0.0 AS delta FROM a, b",
    "q_bootstrap_ci": f"WITH v AS (SELECT toxic AS grp, n_chars::DOUBLE AS v, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) - 1 AS idx FROM labels JOIN documents USING (doc_id) WHERE toxic IN (0, 1)), s AS (SELECT grp, count(*) AS n FROM v GROUP BY 1), sl AS (SELECT grp, n, unnest(generate_series(0, n - 1)) AS slot FROM s), i AS (SELECT b, grp, {RANKS} % n AS idx FROM sl, range(200) AS q(b)), m AS (SELECT b, grp, avg(v) AS m FROM i JOIN v USING (grp, idx) GROUP BY 1, 2), dd AS (SELECT b, max(m) FILTER (grp = 1) - max(m) FILTER (grp = 0) AS d FROM m GROUP BY 1) SELECT (SELECT round(avg(v) FILTER (grp = 1) - avg(v) FILTER (grp = 0), 4) + 0.0 FROM v) AS mean_difference, {r('quantile_cont(d, 0.025)', 'ci_low', 4)}, {r('quantile_cont(d, 0.975)', 'ci_high', 4)} FROM dd",
}
