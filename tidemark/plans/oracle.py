"""The queries in DuckDB SQL, from named parts that are put together as common table expressions."""

from __future__ import annotations

import math
import re

from tidemark.config import FIXTURE as CFG
from tidemark.functions.stats import max_of_normals, normal_cdf_sql, uniform_sql
from tidemark.operators.calibration import INTERPRETATION, TARGETS
from tidemark.operators.gate import CROSS, PORTFOLIO
from tidemark.plans.review import DIGITS, EXACT, TRAINING, TRIALS

END, START, OOT = (f"DATE '{d}'" for d in (CFG.end, CFG.start, CFG.oot_start))
WEEKS, BACK, AHEAD, SPLIT = TRAINING
R52 = f"{math.sqrt(52)!r}::DOUBLE"
W, DEV, N = CFG.monitor_window, CFG.dev_weeks, CFG.top_n
FIRST = max(W + 1, DEV)  # as-of weeks come after this one

PARTS: dict[str, str] = {
    "li": """SELECT 'S' || l_suppkey AS ticker, l_shipdate::DATE AS date, l_extendedprice::DECIMAL(18,2) AS ext, l_quantity::DECIMAL(18,2) AS qty,
        l_discount::DECIMAL(18,2) AS disc, l_extendedprice / l_quantity AS unit FROM lineitem""",
    "bars": """SELECT ticker, date, sum(ext) AS ext, sum(qty) AS qty, sum(disc) AS disc, count(*) AS n, max(unit) AS hi, min(unit) AS lo
        FROM (SELECT * FROM li UNION ALL SELECT 'SPY', * EXCLUDE ticker FROM li) GROUP BY ticker, date""",
    "seen": """SELECT ticker, date, qty::DOUBLE AS volume, max(hi) OVER w AS high, min(lo) OVER w AS low,
        (sum(ext) OVER w)::DOUBLE / (sum(qty) OVER w)::DOUBLE AS close, 1 - (sum(disc) OVER w)::DOUBLE / (sum(n) OVER w)::DOUBLE AS factor
        FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    "sparse": "SELECT date, ticker, (high + low) / 2 AS open, high, low, close, close * factor AS adj_close, volume FROM seen",
    "filled": """SELECT g.ticker, g.date, coalesce(s.volume, 0) AS volume, last_value(s.high IGNORE NULLS) OVER z AS high, last_value(s.low IGNORE NULLS) OVER z AS low,
        last_value(s.close IGNORE NULLS) OVER z AS close, last_value(s.factor IGNORE NULLS) OVER z AS factor
        FROM (SELECT k.ticker, c.date FROM (SELECT DISTINCT ticker FROM bars) k CROSS JOIN (SELECT date FROM bars WHERE ticker = 'SPY') c) g
        LEFT JOIN seen s ON s.ticker = g.ticker AND s.date = g.date
        WINDOW z AS (PARTITION BY g.ticker ORDER BY g.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "prices": "SELECT date, ticker, (high + low) / 2 AS open, high, low, close, close * factor AS adj_close, volume FROM filled WHERE close IS NOT NULL",
}


def _panel(src: str, p: str = "") -> None:
    """The panel of a price table: names get the prefix p."""
    PARTS[f"{p}avail"] = f"SELECT * FROM {src} WHERE date <= {END}"
    PARTS[f"{p}cal"] = f"SELECT date, lead(date) OVER w AS next_session, lead(date, 5) OVER w AS day5, lead(date, 65) OVER w AS day65 FROM {p}avail WHERE ticker = 'SPY' WINDOW w AS (ORDER BY date)"
    PARTS[f"{p}sched"] = f"""SELECT date, next_session AS entry_date, day5, day65, lead(date) OVER w AS next_date, lead(next_session) OVER w AS exit_date
        FROM (SELECT arg_max(c, c.date) AS s FROM {p}cal c GROUP BY date_trunc('week', date)) q, LATERAL (SELECT unnest(q.s)) WINDOW w AS (ORDER BY date)"""
    PARTS[f"{p}weekly"] = f"""SELECT d.*, s.* EXCLUDE date FROM (SELECT date, ticker, close, adj_close, avg(close * volume) OVER w AS adv, count(*) OVER w AS n20 FROM {p}avail
        WHERE close > 0 AND adj_close > 0 WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) d JOIN {p}sched s USING (date) WHERE d.date >= {START}"""
    PARTS[f"{p}told"] = f"""SELECT a.date, a.ticker, max(q.adj_close) FILTER (kind = 'n') AS n, max(q.adj_close) FILTER (kind = 'e') AS e, max(q.adj_close) FILTER (kind = 'x') AS x,
        max(q.adj_close) FILTER (kind = 'h') AS h FROM (UNPIVOT (SELECT date, ticker, next_date AS n, entry_date AS e, exit_date AS x, day65 AS h FROM {p}weekly) ON n, e, x, h INTO NAME kind VALUE at_date) a
        JOIN {p}avail q ON q.ticker = a.ticker AND q.date = a.at_date AND q.adj_close > 0 GROUP BY ALL"""
    PARTS[f"{p}panel"] = f"""SELECT w.date, w.ticker, w.close, w.adj_close, w.adv AS adv20_usd, w.close >= {CFG.min_price} AND w.adv >= {CFG.min_adv} AND w.n20 = 20 AS tradable,
        n / w.adj_close - 1 AS ret_fwd_1w, x / e - 1 AS ret_fwd_1w_lag1, h / w.adj_close - 1 AS ret_fwd_13w FROM {p}weekly w LEFT JOIN {p}told USING (date, ticker)"""


_panel("prices")
_panel("sparse", "sp_")

PARTS |= {
    "sess": "SELECT date, row_number() OVER (ORDER BY date) AS t FROM (SELECT DISTINCT date FROM avail)",
    "dates": "SELECT DISTINCT date FROM panel",
    "mat": "SELECT a.date, t, ticker, adj_close AS value FROM avail a JOIN sess USING (date) WHERE adj_close > 0",
    "dense": """SELECT date, t, ticker, value FROM mat UNION ALL SELECT date, s.t, k.ticker, NULL FROM dates JOIN sess s USING (date)
        CROSS JOIN (SELECT DISTINCT ticker FROM mat) k WHERE (s.t, k.ticker) NOT IN (SELECT (t, ticker) FROM mat)""",
    "momentum": f"""SELECT d.date, d.ticker, 'momentum' AS model, a.value / b.value - 1 AS score FROM dense d JOIN dates USING (date)
        JOIN mat a ON a.ticker = d.ticker AND a.t = d.t - {CFG.mom_skip} JOIN mat b ON b.ticker = d.ticker AND b.t = d.t - {CFG.mom_lookback}""",
    "lr": "SELECT d.*, ln(d.value / p.value) AS lr FROM dense d LEFT JOIN mat p ON p.ticker = d.ticker AND p.t = d.t - 1",
    "mus": f"""SELECT date, ticker, mu, sigma FROM (SELECT date, ticker, avg(lr) OVER w * 252 AS mu, stddev_samp(lr) OVER w * sqrt(252) AS sigma, count(lr) OVER w AS n FROM lr
        WINDOW w AS (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL {CFG.gbm_days - 1} DAYS PRECEDING AND CURRENT ROW)) JOIN dates USING (date) WHERE n >= {CFG.gbm_min_obs} AND sigma IS NOT NULL""",
    "gexp": f"SELECT date, ticker, 'gbm_expected' AS model, list_sum([exp(mu * (i * {CFG.gbm_years / CFG.gbm_steps!r}::DOUBLE)) FOR i IN range(0, {CFG.gbm_steps + 1})]) / {CFG.gbm_steps + 1} - 1 AS score FROM mus",
    "gsteps": f"""SELECT date, ticker, mu, sigma, i, sum(sqrt({CFG.gbm_years / CFG.gbm_steps!r}::DOUBLE) * sqrt(-2 * ln(u1)) * CASE WHEN (i - 1) % 2 = 0 THEN cos({2 * math.pi!r}::DOUBLE * u2) ELSE sin({2 * math.pi!r}::DOUBLE * u2) END)
        OVER (PARTITION BY date, ticker ORDER BY i) AS w FROM (SELECT *, {' , '.join(f"CASE WHEN (i - 1) % 4 < 2 THEN {uniform_sql(f'{chr(39)}g{CFG.seed}{chr(39)}', 'date', 'ticker', '(i - 1) // 4', at=a)} ELSE {uniform_sql(f'{chr(39)}g{CFG.seed}{chr(39)}', 'date', 'ticker', '(i - 1) // 4', at=a + 16)} END AS u{k}" for k, a in ((1, 1), (2, 9)))}
        FROM mus, range(1, {CFG.gbm_steps + 1}) r(i))""",
    "gpath": f"""SELECT date, ticker, 'gbm' AS model, (1 + sum(exp((mu - 0.5::DOUBLE * sigma * sigma) * (i * {CFG.gbm_years / CFG.gbm_steps!r}::DOUBLE) + sigma * w))) / {CFG.gbm_steps + 1} - 1 AS score FROM gsteps GROUP BY date, ticker""",
}
_variants = []
for lb in CFG.weekly_lookbacks:
    PARTS[f"gw{lb}"] = f"""SELECT date, ticker, mu, sd FROM (SELECT date, ticker, avg(lr) OVER w AS mu, stddev_samp(lr) OVER w AS sd, count(lr) OVER w AS n FROM lr
        WINDOW w AS (PARTITION BY ticker ORDER BY t RANGE BETWEEN {lb - 1} PRECEDING AND CURRENT ROW)) JOIN dates USING (date) WHERE n >= {int(lb * 0.9)}"""
    up = normal_cdf_sql("z")
    _variants += [
        f"SELECT date, ticker, 'gbm_w_{lb}_expected' AS model, exp(mu * 5) - 1 AS score FROM gw{lb}",
        f"SELECT date, ticker, 'gbm_w_{lb}_prob_up' AS model, {up} AS score FROM (SELECT *, (mu - 0.5::DOUBLE * sd * sd) * {math.sqrt(5)!r}::DOUBLE / sd AS z FROM gw{lb} WHERE sd > 0)",
    ]
PARTS["variants"] = " UNION ALL ".join(_variants)
PARTS["signals"] = "SELECT * FROM momentum UNION ALL SELECT * FROM gexp"
PARTS["bt"] = f"SELECT date, ticker, ret_fwd_1w, ret_fwd_1w_lag1 FROM panel WHERE tradable AND date <= {END} AND date IN (SELECT date FROM panel WHERE ticker = 'SPY' AND ret_fwd_1w_lag1 IS NOT NULL)"


def _weights(name: str, scores: str) -> None:
    PARTS[name] = f"""SELECT strategy, date, ticker, 1 / count(*) OVER (PARTITION BY strategy, date) AS w, ret_fwd_1w, ret_fwd_1w_lag1 FROM (
        SELECT s.model AS strategy, b.* FROM bt b JOIN {scores} s USING (date, ticker) QUALIFY row_number() OVER (PARTITION BY s.model, b.date ORDER BY score DESC, ticker) <= {N})"""


def _returns(name: str, weights: str, ret: str = "ret_fwd_1w_lag1", suffix: str = "") -> None:
    PARTS[f"{name}_wk"] = f"""SELECT strategy, date, sum(w * coalesce({ret}, 0)) AS gross, (count(*) FILTER (w > 0))::INT AS n_held,
        lead(date) OVER (PARTITION BY strategy ORDER BY date) AS nxt FROM {weights} GROUP BY strategy, date"""
    PARTS[f"{name}_tr"] = f"""SELECT strategy, date, sum(moved) AS traded FROM (SELECT strategy, date, ticker, abs(sum(leg)) AS moved FROM (
        SELECT strategy, date, ticker, w AS leg FROM {weights} UNION ALL
        SELECT strategy, nxt, ticker, coalesce(-w * (1 + coalesce({ret}, 0)) / nullif(1 + gross, 0), 0) FROM {weights} JOIN {name}_wk USING (strategy, date) WHERE nxt IS NOT NULL) GROUP BY ALL) GROUP BY ALL"""
    PARTS[name] = f"SELECT date, strategy || '{suffix}' AS strategy, gross AS ret_gross, gross - traded * {CFG.cost_bps} / 1e4 AS ret_net, traded / 2 AS turnover, n_held FROM {name}_wk JOIN {name}_tr USING (strategy, date)"


_weights("w_models", "signals")
_weights("w_mom", "momentum")
_weights("w_var", "variants")
PARTS["w_bench"] = """SELECT 'universe_ew' AS strategy, date, ticker, 1 / count(*) OVER (PARTITION BY date) AS w, ret_fwd_1w, ret_fwd_1w_lag1 FROM bt
        UNION ALL SELECT 'benchmark_spy', date, ticker, 1.0, ret_fwd_1w, ret_fwd_1w_lag1 FROM bt WHERE ticker = 'SPY'"""
PARTS["w_gated"] = "SELECT strategy, date, ticker, CASE WHEN coalesce(gate_on, false) THEN w ELSE 0 END AS w, ret_fwd_1w, ret_fwd_1w_lag1 FROM w_mom LEFT JOIN gate USING (date)"
_returns("models", "w_models")
_returns("sameclose", "w_mom", "ret_fwd_1w", "_same_close")
_returns("varrets", "w_var")
_returns("bench", "w_bench")
_returns("challenger", "w_gated", suffix="_gated")
PARTS |= {
    "rets": "SELECT * FROM models UNION ALL SELECT * FROM bench",
    "act": f"SELECT s.strategy, s.date, s.ret_net - b.ret_net AS active FROM rets s JOIN bench b ON b.date = s.date AND b.strategy = 'universe_ew' WHERE s.date >= {OOT} AND s.strategy IN ('momentum', 'gbm_expected')",
    # monitoring
    "scored": f"""SELECT 'momentum' AS model, p.date, p.ticker, score, p.ret_fwd_1w_lag1 AS r1, p.ret_fwd_13w AS r13, (p.ret_fwd_1w_lag1 > median(p.ret_fwd_1w_lag1) OVER d)::INT AS y1,
        (p.ret_fwd_13w > median(p.ret_fwd_13w) OVER d)::INT AS y13 FROM panel p JOIN momentum USING (date, ticker) WHERE tradable AND p.date <= {END} WINDOW d AS (PARTITION BY p.date)""",
    "wks": "SELECT date, row_number() OVER (ORDER BY date) AS week FROM (SELECT DISTINCT date FROM scored)",
    "sw": "SELECT s.*, week FROM scored s JOIN wks USING (date)",
    "vol": """SELECT p.date, p.ticker, vol252 FROM panel p JOIN (SELECT ticker, date, sqrt(252 * greatest(avg(r * r) OVER w - avg(r) OVER w * avg(r) OVER w, 0)) AS vol252, count(r) OVER w AS n
        FROM (SELECT ticker, date, ln(adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY date)) AS r FROM avail WHERE adj_close > 0)
        WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)) v USING (ticker, date) WHERE tradable AND n >= 200""",
    "back1": f"SELECT a.date AS ad, w.week FROM wks a JOIN wks w ON w.week BETWEEN a.week - {W + 1} AND a.week - 2 WHERE a.week > {FIRST}",
    "ripe": f"""SELECT a.date AS ad, w.week FROM wks a JOIN wks w ON w.week < a.week JOIN cal c ON c.date = w.date AND c.day65 <= a.date WHERE a.week > {FIRST}
        QUALIFY row_number() OVER (PARTITION BY a.date ORDER BY w.week DESC) <= {W}""",
    "win1": "SELECT model, ad AS date, score, r1 AS r, y1 AS y FROM sw JOIN back1 USING (week) WHERE r1 IS NOT NULL",
    "win13": "SELECT model, ad AS date, score, r13 AS r, y13 AS y FROM sw JOIN ripe USING (week) WHERE r13 IS NOT NULL",
}


def _psi(name: str, values: str, metric: str) -> None:
    """values: (week, x)."""
    PARTS[f"{name}_ed"] = f"SELECT list_distinct(es)[1:] AS es FROM (SELECT quantile_cont(x, [k / 10.0 FOR k IN range(0, 11)]) AS es FROM {values} WHERE week <= {DEV})"
    PARTS[f"{name}_in"] = f"SELECT list_sort(es)[2:len(es) - 1] AS es FROM {name}_ed"
    PARTS[f"{name}_k"] = f"SELECT week, len(list_filter(es, lambda e: x >= e)) AS k, count(*) AS n FROM {values}, {name}_in GROUP BY ALL"
    PARTS[f"{name}_e"] = f"SELECT b.k, coalesce(sum(n), 0) / (SELECT sum(n) FROM {name}_k WHERE week <= {DEV}) AS e FROM range(0, 10) b(k) LEFT JOIN (SELECT * FROM {name}_k WHERE week <= {DEV}) q USING (k) GROUP BY b.k"
    PARTS[f"{name}_a"] = f"SELECT ad, k, sum(n) AS n FROM back1 JOIN {name}_k USING (week) GROUP BY ALL"
    PARTS[name] = f"""SELECT ad AS date, 'momentum' AS model, '{metric}' AS metric, sum((greatest(a, 1e-4) - greatest(e, 1e-4)) * ln(greatest(a, 1e-4) / greatest(e, 1e-4))) AS value
        FROM (SELECT t.ad, b.k, coalesce(q.n, 0) / t.total AS a FROM (SELECT ad, sum(n) AS total FROM {name}_a GROUP BY ad) t CROSS JOIN range(0, 10) b(k) LEFT JOIN {name}_a q ON q.ad = t.ad AND q.k = b.k)
        JOIN {name}_e USING (k) GROUP BY ad"""


PARTS["scoreval"] = "SELECT week, score AS x FROM sw"
PARTS["volval"] = "SELECT week, vol252 AS x FROM vol JOIN wks USING (date) WHERE vol252 IS NOT NULL"
_psi("psis", "scoreval", "psi_score")
_psi("psii", "volval", "psi_input")


def auc_of(src: str, keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS n, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) END AS auc
        FROM (SELECT {keys}, y, rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2 AS rk FROM {src}) GROUP BY {keys}"""


def ks_of(src: str, keys: str) -> str:
    return f"""SELECT {keys}, max(abs(c1 - c0)) AS ks FROM (SELECT {keys}, (sum(y) OVER u)::DOUBLE / nullif(sum(y) OVER k, 0) AS c1, (sum(1 - y) OVER u)::DOUBLE / nullif(sum(1 - y) OVER k, 0) AS c0
        FROM {src} WINDOW k AS (PARTITION BY {keys}), u AS (PARTITION BY {keys} ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY {keys}"""


def _metric(name: str, inner: str, col: str, metric: str) -> None:
    PARTS[name] = f"SELECT date, 'momentum' AS model, '{metric}' AS metric, {col} AS value FROM ({inner})"


for sfx, src in (("1w", "win1"), ("13w", "win13")):
    _metric(f"auc{sfx}", auc_of(src, "date"), "auc", f"auc_{sfx}")
    _metric(f"ks{sfx}", ks_of(src, "date"), "ks", f"ks_{sfx}")
_metric("slope13", "SELECT date, CASE WHEN stddev_pop(score) > 0 THEN regr_slope(r, score) END AS v FROM win13 GROUP BY date", "v", "association_slope_13w")
PARTS |= {
    "pm": f"""SELECT strategy AS model, date, rolling_sharpe, exp(le - greatest(max(le) OVER u, 0)) - 1 AS drawdown, exp(lq - greatest(max(lq) OVER u, 0)) - 1 AS active_drawdown
        FROM (SELECT s.strategy, s.date, CASE WHEN count(*) OVER w = {W} AND stddev_samp(s.ret_net - b.ret_net) OVER w > 0 THEN avg(s.ret_net - b.ret_net) OVER w / stddev_samp(s.ret_net - b.ret_net) OVER w * {R52} END AS rolling_sharpe,
          sum(ln(1 + s.ret_net)) OVER v AS le, sum(ln(1 + s.ret_net) - ln(1 + b.ret_net)) OVER v AS lq FROM rets s JOIN bench b ON b.date = s.date AND b.strategy = 'universe_ew'
          WINDOW w AS (PARTITION BY s.strategy ORDER BY s.date ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW), v AS (PARTITION BY s.strategy ORDER BY s.date))
        WINDOW u AS (PARTITION BY strategy ORDER BY date)""",
    "pml": "SELECT date, model, metric, value FROM (UNPIVOT pm ON rolling_sharpe, drawdown, active_drawdown INTO NAME metric VALUE value)",
    "mon": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT date, model, metric, value FROM {t}" for t in ("psis", "psii", "auc1w", "ks1w", "auc13w", "ks13w", "slope13")) + " UNION ALL SELECT date, model, metric, value FROM pml WHERE model = 'momentum') WHERE value IS NOT NULL",
    "piv": "SELECT model, date, " + ", ".join(f"max(value) FILTER (metric = '{m}') AS {m}" for m in (*CROSS, *PORTFOLIO)) + " FROM mon GROUP BY model, date",
    "wide": f"SELECT model, date, {', '.join(CROSS)}, " + ", ".join(f"lag({m}, 2) OVER (PARTITION BY model ORDER BY date) AS {m}" for m in PORTFOLIO) + " FROM piv",
    "why": "SELECT date, model, concat_ws(',', " + ", ".join([f"CASE WHEN {m} {op} {x} THEN '{m}' END" for m, op, x in CFG.rules] + [f"CASE WHEN {m} IS NULL THEN 'missing:{m}' END" for m, _, _ in CFG.rules]) + ") AS s FROM wide",
    "gate": "SELECT date, model, s = '' AS gate_on, nullif(s, '') AS reason FROM why",
    # statistics
    "num": "SELECT strategy, active, row_number() OVER (PARTITION BY strategy ORDER BY date) - 1 AS idx FROM act",
    "sharpes": f"SELECT strategy, count(*) AS n, avg(active) / nullif(stddev_samp(active), 0) * {R52} AS sr FROM act GROUP BY strategy",
    "mom4": """SELECT strategy, n, m / sqrt(m2 * n / (n - 1)) AS sr, m3 / m2 ** 1.5 AS skew, m4 / (m2 * m2) AS kurt FROM (
        SELECT strategy, count(*) AS n, any_value(m) AS m, avg((active - m) ** 2) AS m2, avg((active - m) ** 3) AS m3, avg((active - m) ** 4) AS m4
        FROM (SELECT *, avg(active) OVER (PARTITION BY strategy) AS m FROM act) GROUP BY strategy)""",
}


def boot_idx(lengths: str, draws: int) -> str:
    u1, u2 = (uniform_sql(f"'{c}0'", "draw", "i") for c in "sj")
    return f"""SELECT strategy, draw, i, (last_value(j IGNORE NULLS) OVER (PARTITION BY strategy, draw ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + i + n) % n AS idx FROM (
        SELECT strategy, n, draw, i, CASE WHEN i = 0 OR {u1} < {1.0 / CFG.bootstrap_block!r}::DOUBLE THEN floor({u2} * n)::BIGINT - i END AS j
        FROM ({lengths}) q, range(0, {draws}) d(draw), LATERAL (SELECT unnest(range(0, q.n)) AS i))"""


PARTS["bidx"] = boot_idx("SELECT strategy, count(*) AS n FROM act GROUP BY strategy", CFG.bootstrap_n)
PARTS["bsr"] = f"SELECT strategy, draw, avg(active) / nullif(stddev_samp(active), 0) * {R52} AS sr FROM bidx JOIN num USING (strategy, idx) GROUP BY strategy, draw"
PARTS["bci"] = f"""SELECT s.strategy AS model, 'bootstrap_sharpe_ci' AS test, s.sr AS statistic, lo AS ci_low, hi AS ci_high, p AS p_value, CASE WHEN lo > 0 THEN 'PASS' ELSE 'FAIL' END AS verdict,
        '{CFG.bootstrap_n} resamples of ' || s.n || ' weeks in blocks of {CFG.bootstrap_block} on average' AS detail
        FROM sharpes s JOIN (SELECT strategy, quantile_cont(sr, 0.025) AS lo, quantile_cont(sr, 0.975) AS hi, avg(coalesce((sr <= 0)::INT, 0)) AS p FROM bsr GROUP BY strategy) b USING (strategy)"""


def _dsr(name: str, trials: str, n: int) -> None:
    """trials: annual ratios sr."""
    at = f"sqrt((SELECT CASE WHEN count(*) > 1 THEN var_samp(sr / {R52}) ELSE NULL END FROM ({trials}))) * {max_of_normals(n)!r}::DOUBLE"
    PARTS[f"{name}_z"] = f"SELECT *, (sr - sr0) * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) AS z FROM (SELECT *, coalesce({at}, sqrt(1 / n) * {max_of_normals(n)!r}::DOUBLE) AS sr0 FROM mom4)"
    PARTS[name] = f"""SELECT strategy AS model, 'deflated_sharpe' AS test, v AS statistic, NULL::DOUBLE AS ci_low, NULL::DOUBLE AS ci_high, 1 - v AS p_value, CASE WHEN v >= 0.95 THEN 'PASS' ELSE 'FAIL' END AS verdict,
        printf('against the best of {n} trials (%.2f a year); %d weeks, skewness %.2f, kurtosis %.1f', sr0 * {R52}, n, skew, kurt) AS detail FROM (SELECT *, {normal_cdf_sql('z')} AS v FROM {name}_z)"""


_dsr("dsr", "SELECT sr FROM sharpes", CFG.n_trials)
PARTS["trialsr"] = f"""SELECT strategy, avg(active) / nullif(stddev_samp(active), 0) * {R52} AS sr FROM (SELECT s.strategy, s.ret_net - b.ret_net AS active FROM (SELECT * FROM models UNION ALL SELECT * FROM varrets) s
        JOIN bench b ON b.date = s.date AND b.strategy = 'universe_ew' WHERE s.date >= {OOT}) WHERE strategy IN ({', '.join(map(repr, TRIALS))}) GROUP BY strategy"""
_dsr("dsrall", "SELECT sr FROM trialsr", max(CFG.n_trials, len(TRIALS)))
PARTS |= {
    "prow": f"SELECT s.model AS strategy, b.date, b.ticker, ret_fwd_1w_lag1 AS r FROM bt b JOIN signals s USING (date, ticker) WHERE b.date >= {OOT}",
    "pnull": f"""SELECT strategy, perm, date, avg(r) AS r FROM (SELECT strategy, perm, date, r FROM prow, range(0, {CFG.n_perm}) p(perm)
        QUALIFY row_number() OVER (PARTITION BY strategy, date, perm ORDER BY md5('p0|' || perm || '|' || date || '|' || ticker), ticker) <= {N}) GROUP BY ALL""",
    "psr": f"""SELECT strategy, perm, avg(a) / nullif(stddev_samp(a), 0) * {R52} AS sr FROM (SELECT x.strategy, perm, x.r - b.ret_gross AS a FROM (SELECT * FROM pnull UNION ALL
        SELECT strategy, -1, date, ret_gross FROM models WHERE date >= {OOT}) x JOIN bench b ON b.date = x.date AND b.strategy = 'universe_ew') GROUP BY ALL""",
    "pn": f"""SELECT n.strategy AS model, 'permutation_null' AS test, max(o.sr) AS statistic, quantile_cont(n.sr, 0.025) AS ci_low, quantile_cont(n.sr, 0.975) AS ci_high,
        (1 + count(*) FILTER (n.sr >= o.sr)) / {CFG.n_perm + 1} AS p_value, CASE WHEN (1 + count(*) FILTER (n.sr >= o.sr)) / {CFG.n_perm + 1} < 0.05 THEN 'PASS' ELSE 'FAIL' END AS verdict,
        printf('{CFG.n_perm} random portfolios of as many names before costs: average %.2f, spread %.2f', avg(n.sr), stddev_pop(n.sr)) AS detail
        FROM psr n JOIN psr o ON o.strategy = n.strategy AND o.perm = -1 WHERE n.perm >= 0 GROUP BY n.strategy""",
    "pair": """SELECT a.strategy || ' - ' || b.strategy AS strategy, a.date, a.active - b.active AS active FROM act a JOIN act b ON a.date = b.date AND a.strategy <> b.strategy""",
    "pairidx": boot_idx("SELECT strategy, count(*) AS n FROM pair GROUP BY strategy", CFG.bootstrap_n),
    "pairci": """SELECT strategy, any_value(stat) AS statistic, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM (SELECT strategy, draw, avg(active) * 52 AS m FROM pairidx
        JOIN (SELECT strategy, active, row_number() OVER (PARTITION BY strategy ORDER BY date) - 1 AS idx FROM pair) USING (strategy, idx) GROUP BY ALL)
        JOIN (SELECT strategy, avg(active) * 52 AS stat FROM pair GROUP BY strategy) USING (strategy) GROUP BY strategy""",
    # calibration and training
    "calsig": "SELECT * FROM gexp UNION ALL SELECT date, ticker, 'gbm_weekly', score FROM variants WHERE model = 'gbm_w_126_expected'",
    "grid": "SELECT a.date, s, ticker, adj_close AS value FROM avail a JOIN (SELECT date, row_number() OVER (ORDER BY date) AS s FROM cal) USING (date) WHERE adj_close > 0",
    "fwd": """SELECT date, ticker, CASE WHEN count(*) OVER w = 64 THEN avg(value) OVER w END / value - 1 AS path, max(value) OVER p / value - 1 AS point, max(s) OVER () - s AS ahead FROM grid
        WINDOW w AS (PARTITION BY ticker ORDER BY s RANGE BETWEEN CURRENT ROW AND 63 FOLLOWING), p AS (PARTITION BY ticker ORDER BY s RANGE BETWEEN 5 FOLLOWING AND 5 FOLLOWING)""",
    "pairs": f"""SELECT c.model, CASE WHEN c.model = 'gbm_weekly' THEN 5 ELSE 63 END AS horizon, score, CASE WHEN c.model = 'gbm_weekly' THEN point ELSE path END AS actual
        FROM calsig c JOIN panel p USING (date, ticker) JOIN fwd f USING (date, ticker) WHERE tradable AND c.date BETWEEN {OOT} AND {END}""",
    "feat": """SELECT a.date, t, ticker, [ln(nullif(greatest(open, 0), 0) * f), ln(nullif(greatest(high, 0), 0) * f), ln(nullif(greatest(low, 0), 0) * f), ln(nullif(greatest(close, 0), 0) * f), ln(1 + volume)] AS l
        FROM (SELECT *, adj_close / close AS f FROM avail) a JOIN sess USING (date)""",
    "spsess": "SELECT date, row_number() OVER (ORDER BY date) AS t FROM (SELECT DISTINCT date FROM sp_avail)",
    "spok": """SELECT x.ticker, x.t, p.t IS NOT NULL AS ok FROM (SELECT a.ticker, t FROM sp_avail a JOIN spsess USING (date)) x LEFT JOIN (SELECT a.ticker, t FROM sp_avail a JOIN spsess USING (date)) p ON p.ticker = x.ticker AND p.t = x.t - 1""",
    "eq": """SELECT *, sum(ln(1 + ret_net)) OVER (PARTITION BY strategy ORDER BY date) AS le FROM rets""",
    "ccrows": f"""SELECT *, sum(ln(1 + ret_net)) OVER (PARTITION BY strategy ORDER BY date) AS le FROM (SELECT * FROM rets WHERE strategy <> 'gbm_expected' UNION ALL SELECT * FROM challenger) WHERE date >= {OOT}""",
}

PARTS |= {
    "adjq": "SELECT date, ticker, open * (adj_close / close) AS open, high * (adj_close / close) AS high, low * (adj_close / close) AS low, close * (adj_close / close) AS close, volume FROM avail WHERE close > 0 AND adj_close > 0",
    "wbars": """SELECT (date_trunc('week', date + 2)::DATE - 2) AS week, ticker, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume,
        max(date) AS last_date FROM adjq GROUP BY ALL""",
    "wlogs": "SELECT week, datediff('day', DATE '1970-01-03', week) // 7 AS t, ticker, [ln(open), ln(high), ln(low), ln(close), ln(1 + volume)] AS l FROM wbars",
    "wfeat": "SELECT week, t, ticker, CASE WHEN lag(t) OVER w = t - 1 THEN [l[k] - lag(l[k]) OVER w FOR k IN range(1, 6)] END AS f FROM wlogs WINDOW w AS (PARTITION BY ticker ORDER BY t)",
    "wfeat5": "SELECT week, t, ticker, " + ", ".join(f"CASE WHEN lag(t) OVER w = t - 1 THEN l[{k}] - lag(l[{k}]) OVER w END AS f{k}" for k in range(1, 6)) + " FROM wlogs WINDOW w AS (PARTITION BY ticker ORDER BY t)",
    "wz": "SELECT week, t, ticker, " + ", ".join(f"CASE WHEN f1 IS NOT NULL THEN greatest(-3.0::DOUBLE, least(3.0::DOUBLE, (f{k} - (SELECT avg(f{k}) FROM wfeat5 WHERE f1 IS NOT NULL)) / (SELECT stddev_pop(f{k}) FROM wfeat5 WHERE f1 IS NOT NULL))) END AS z{k}" for k in range(1, 6)) + " FROM wfeat5",
    "wwin": f"""SELECT ticker, week, avg(z2) OVER w AS m, count(z2) OVER w AS n FROM wz WINDOW w AS (PARTITION BY ticker ORDER BY t RANGE BETWEEN {WEEKS - 1} PRECEDING AND CURRENT ROW)""",
    "drow": "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS t FROM adjq",
    "dfeat": "SELECT ticker, date, t, " + ", ".join(f"{x} - lag({x}) OVER w AS f{k}" for k, x in enumerate(("ln(open)", "ln(high)", "ln(low)", "ln(close)", "ln(1 + volume)"), 1)) + " FROM drow WINDOW w AS (PARTITION BY ticker ORDER BY t)",
    "dz": "SELECT ticker, date, t, f4, f1 IS NOT NULL AS ok, " + ", ".join(f"CASE WHEN f1 IS NOT NULL THEN greatest(-3.0::DOUBLE, least(3.0::DOUBLE, (f{k} - (SELECT avg(f{k}) FROM dfeat WHERE f1 IS NOT NULL AND date < DATE '{SPLIT}')) / (SELECT stddev_pop(f{k}) FROM dfeat WHERE f1 IS NOT NULL AND date < DATE '{SPLIT}'))) END AS z{k}" for k in (2, 5)) + " FROM dfeat",
    "dwin": f"""SELECT ticker, date AS "end", t, lead(date, {AHEAD}) OVER o AS target_end, avg(z2) OVER b AS mean_high, avg(z5) OVER b AS mean_volume, count(z2) OVER b AS nb, sum(f4) OVER a AS ret, count(f4) OVER a AS na
        FROM dz WINDOW o AS (PARTITION BY ticker ORDER BY t), b AS (PARTITION BY ticker ORDER BY t ROWS BETWEEN {BACK - 1} PRECEDING AND CURRENT ROW), a AS (PARTITION BY ticker ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {AHEAD} FOLLOWING)""",
    "dsamp": f"""SELECT *, (rank() OVER (PARTITION BY "end" ORDER BY ret) + (count(*) OVER (PARTITION BY "end", ret) - 1) / 2) / count(*) OVER (PARTITION BY "end") - 0.5::DOUBLE AS y0,
        CASE WHEN target_end < DATE '{SPLIT}' THEN 'train' WHEN "end" >= DATE '{SPLIT}' THEN 'val' ELSE 'purged' END AS part
        FROM dwin WHERE nb = {BACK} AND na = {AHEAD} AND (t - {BACK}) % {AHEAD} = 0 AND target_end IS NOT NULL""",
}
del PARTS["wfeat"]

_METRIC = ["date", "model", "metric", "*value"]
_RESULT = ["model", "test", "*statistic", "*ci_low", "*ci_high", "*p_value", "verdict", "detail"]
_PR = ["date", "strategy", "*ret_gross", "*ret_net", "*turnover", "n_held"]
_SIG = ["date", "ticker", "model", "*score"]
_PANEL = ["date", "ticker", "*close", "*adj_close", "*adv20_usd", "tradable", "*ret_fwd_1w", "*ret_fwd_1w_lag1", "*ret_fwd_13w"]

#: name -> (columns, the rounded ones with a star; source)
FINALS: dict[str, tuple[list[str], str]] = {
    "universe_clean": (
        ["ticker", "name", "exchange", "sector", "*market_cap", "rank_by_mcap", "asof_date"],
        f"""(SELECT 'P' || p_partkey AS ticker, p_name AS name, p_brand AS exchange, p_type AS sector, p_retailprice AS market_cap,
        (row_number() OVER (ORDER BY p_retailprice DESC, 'P' || p_partkey))::INT AS rank_by_mcap, DATE '{CFG.universe_asof}' AS asof_date
        FROM (SELECT * FROM part WHERE p_retailprice > 0 QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, 'P' || p_partkey) = 1) QUALIFY rank_by_mcap <= {CFG.universe_size})""",
    ),
    "prices_quality": (["ticker", "n_rows", "first_date", "last_date", "quiet_days", "*avg_close"], "(SELECT ticker, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, (count(*) FILTER (volume = 0))::BIGINT AS quiet_days, avg(close) AS avg_close FROM prices GROUP BY ticker)"),
    "calendar_schedule": (["date", "entry_date", "day5", "day65", "next_date", "exit_date"], "sched"),
    "panel": (_PANEL, "panel"),
    "panel_sparse": (_PANEL, "sp_panel"),
    "panel_summary": (
        ["n_rows", "weeks", "tickers", "*tradable_share", "with_return", "with_13w", "last_complete"],
        "(SELECT count(*) AS n_rows, count(DISTINCT date) AS weeks, count(DISTINCT ticker) AS tickers, avg(tradable::INT) AS tradable_share, count(ret_fwd_1w_lag1) AS with_return, count(ret_fwd_13w) AS with_13w, max(date) FILTER (ticker = 'SPY' AND ret_fwd_1w_lag1 IS NOT NULL) AS last_complete FROM panel)",
    ),
    "rebalance_dates": (["date"], "dates"),
    "universe_coverage": (
        ["year", "with_prices", "tradable_any_week", "*tradable_share", "*median_adv_musd"],
        "(SELECT year(date) AS year, count(DISTINCT ticker) AS with_prices, count(DISTINCT ticker) FILTER (tradable) AS tradable_any_week, round(avg(tradable::INT), 3) AS tradable_share, round(median(adv20_usd) / 1e6, 8) AS median_adv_musd FROM panel GROUP BY ALL)",
    ),
    "names_by_year": (["year", "names", "n_rows"], "(SELECT year(date) AS year, count(DISTINCT ticker) AS names, count(*) AS n_rows FROM avail GROUP BY ALL)"),
    "price_matrix_long": (["date", "t", "ticker", "*value"], "(SELECT a.date, t::INT AS t, ticker, high AS value FROM avail a JOIN sess USING (date) WHERE high > 0)"),
    "stride_sample": (["date", "t", "ticker", "*value"], "(SELECT date, t::INT AS t, ticker, value FROM mat WHERE (t - 1) % 65 = 0)"),
    "first_names": (["ticker"], "(SELECT DISTINCT 'P' || p_partkey AS ticker FROM part ORDER BY ticker LIMIT 100)"),
    "realised_vol": (["date", "ticker", "*vol252"], "vol"),
    "momentum": (_SIG, "momentum"),
    "gbm_mu_sigma": (["date", "ticker", "*mu", "*sigma"], "mus"),
    "gbm_expected": (_SIG, "gexp"),
    "gbm_path": (_SIG, "gpath"),
    "gbm_weekly_variants": (_SIG, "variants"),
    "gbm_weekly_select": (
        ["model", "*sharpe", "chosen"],
        f"""(SELECT model, sharpe, row_number() OVER (ORDER BY sharpe DESC NULLS LAST, model) = 1 AS chosen FROM (SELECT s.strategy AS model, avg(s.ret_net - b.ret_net) / nullif(stddev_samp(s.ret_net - b.ret_net), 0) * {R52} AS sharpe
        FROM varrets s JOIN bench b ON b.date = s.date AND b.strategy = 'universe_ew' WHERE s.date < {OOT} GROUP BY ALL))""",
    ),
    "signal_alias": (_SIG, "(SELECT date, ticker, 'gbm_weekly' AS model, score FROM variants WHERE model = 'gbm_w_126_expected')"),
    "signal_inventory": (["model", "n_rows", "n_dates", "n_tickers", "first_date", "last_date"], "(SELECT model, count(*) AS n_rows, count(DISTINCT date) AS n_dates, count(DISTINCT ticker) AS n_tickers, min(date) AS first_date, max(date) AS last_date FROM (SELECT * FROM signals UNION ALL SELECT * FROM variants) GROUP BY model)"),
    "topn_weights": (["strategy", "date", "ticker", "*w"], "w_mom"),
    "portfolio_returns": (_PR, "models"),
    "same_close_returns": (_PR, "sameclose"),
    "benchmark_spy": (_PR, "(SELECT * FROM bench WHERE strategy = 'benchmark_spy')"),
    "universe_ew": (_PR, "(SELECT * FROM bench WHERE strategy = 'universe_ew')"),
    "performance_summary": (
        ["strategy", "weeks", "*cagr", "*vol", "*sharpe", "*max_dd", "*turnover_avg", "*active_ret", "*info_ratio"],
        f"""(SELECT strategy, count(*) AS weeks, exp(52 * avg(ln(1 + ret_net))) - 1 AS cagr, stddev_samp(ret_net) * {R52} AS vol, CASE WHEN stddev_samp(ret_net) > 0 THEN avg(ret_net) / stddev_samp(ret_net) * {R52} END AS sharpe,
        min(exp(le - pk) - 1) AS max_dd, avg(turnover) AS turnover_avg, avg(a) * 52 AS active_ret, CASE WHEN stddev_samp(a) > 0 THEN avg(a) / stddev_samp(a) * {R52} END AS info_ratio
        FROM (SELECT eq.*, greatest(max(le) OVER (PARTITION BY eq.strategy ORDER BY eq.date), 0) AS pk, eq.ret_net - b.ret_net AS a FROM eq LEFT JOIN bench b ON b.date = eq.date AND b.strategy = 'universe_ew') GROUP BY strategy)""",
    ),
    "champion_challenger": (
        ["strategy", "weeks", "*cagr", "*vol", "*sharpe", "*max_drawdown", "*total_return"],
        f"""(SELECT strategy, count(*) AS weeks, exp(52 * avg(ln(1 + ret_net))) - 1 AS cagr, stddev_samp(ret_net) * {R52} AS vol, avg(ret_net) / nullif(stddev_samp(ret_net), 0) * {R52} AS sharpe,
        min(exp(le - pk) - 1) AS max_drawdown, exp(sum(ln(1 + ret_net))) - 1 AS total_return FROM (SELECT *, greatest(max(le) OVER (PARTITION BY strategy ORDER BY date), 0) AS pk FROM ccrows) GROUP BY strategy)""",
    ),
    "growth_curve": (["strategy", "date", "*growth"], f"(SELECT strategy, date, exp(sum(ln(1 + ret_net)) OVER (PARTITION BY strategy ORDER BY date)) AS growth FROM rets WHERE date >= {OOT})"),
    "psi_by_year": (
        ["model", "year", "*psi"],
        f"""(WITH b AS (SELECT year(date) AS year, week <= {DEV} AS dev, len(list_filter((SELECT quantile_cont(score, [k / 10.0 FOR k IN range(1, 10)]) FROM sw WHERE week <= {DEV}), lambda e: score > e)) AS bucket FROM sw),
        e AS (SELECT bucket, count(*) / (SELECT count(*) FROM b WHERE dev) AS e FROM b WHERE dev GROUP BY bucket), y AS (SELECT year, count(*) AS total FROM b GROUP BY year), a AS (SELECT year, bucket, count(*) AS n FROM b GROUP BY ALL)
        SELECT 'momentum' AS model, y.year, sum((greatest(coalesce(n, 0) / total, 1e-4) - greatest(e, 1e-4)) * ln(greatest(coalesce(n, 0) / total, 1e-4) / greatest(e, 1e-4))) AS psi
        FROM y CROSS JOIN e LEFT JOIN a ON a.year = y.year AND a.bucket = e.bucket GROUP BY y.year)""",
    ),
    "psi_rolling": (_METRIC, "psis"),
    "psi_input_rolling": (_METRIC, "psii"),
    "auc_by_year": (["model", "year", "n", "*auc"], "(" + auc_of("(SELECT model, year(date) AS year, score, y1 AS y FROM sw WHERE r1 IS NOT NULL)", "model, year") + ")"),
    "auc_rolling": (_METRIC, "auc1w"),
    "ks_rolling": (_METRIC, "ks1w"),
    "auc_13w_rolling": (_METRIC, "auc13w"),
    "ks_13w_rolling": (_METRIC, "ks13w"),
    "association_slope_13w": (_METRIC, "slope13"),
    "portfolio_metrics": (_METRIC, "pml"),
    "latest_monitoring": (_METRIC, "(SELECT * FROM mon QUALIFY row_number() OVER (PARTITION BY model, metric ORDER BY date DESC) = 1)"),
    "metrics_wide": (["model", "date", *(f"*{m}" for m in (*CROSS, *PORTFOLIO))], "wide"),
    "gate_decisions": (["date", "model", "gate_on", "reason"], "gate"),
    "gate_reasons": (["model", "reason", "weeks"], "(SELECT model, reason, count(*) AS weeks FROM gate WHERE NOT gate_on GROUP BY ALL)"),
    "gate_off_share": (["model", "weeks", "*off_share"], f"(SELECT g.model, count(*) AS weeks, avg((NOT gate_on)::INT) AS off_share FROM gate g JOIN models m ON m.strategy = g.model AND m.date = g.date WHERE m.date >= {OOT} GROUP BY ALL)"),
    "challenger_returns": (_PR, "challenger"),
    "active_returns": (["strategy", "date", "*active"], "act"),
    "sharpe": (["strategy", "n", "*sharpe"], "(SELECT strategy, n, sr AS sharpe FROM sharpes)"),
    "bootstrap_indices": (["strategy", "draw", "i", "idx"], "(SELECT strategy, draw::INT AS draw, i, idx FROM bidx)"),
    "bootstrap_sharpe_ci": (_RESULT, "bci"),
    "probabilistic_sharpe": (["strategy", "n", "*sr", "*skew", "*kurt", "*psr"], f"(SELECT strategy, n, sr, skew, kurt, {normal_cdf_sql('z')} AS psr FROM (SELECT *, sr * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) AS z FROM mom4))"),
    "deflated_sharpe": (_RESULT, "dsr"),
    "permutation_null": (_RESULT, "pn"),
    "validation_results": (
        _RESULT,
        f"""(SELECT * REPLACE (detail || '; weeks from {CFG.oot_start}, traded at the next close' AS detail) FROM (SELECT * FROM bci UNION ALL SELECT * FROM pn)
        UNION ALL SELECT * REPLACE ('PROVISIONAL' AS verdict, detail || '; weeks from {CFG.oot_start}, traded at the next close; spread of {len(TRIALS) - 1} trials on record, none for never_run; at least {max(CFG.n_trials, len(TRIALS))} trials were made, so this does not approve' AS detail) FROM dsrall)""",
    ),
    "paired_bootstrap": (["strategy", "*statistic", "*ci_low", "*ci_high"], "(SELECT * FROM pairci WHERE strategy = 'momentum - gbm_expected')"),
    "contrast_verdict": (["strategy", "verdict"], "(SELECT strategy, CASE WHEN ci_low > 0 THEN 'better' WHEN ci_high < 0 THEN 'worse' ELSE 'not distinguishable' END AS verdict FROM pairci)"),
    "matched_calibration": (
        ["model", "horizon_sessions", "n", "*slope", "*intercept", "*mae", "target", "interpretation"],
        f"""(SELECT model, horizon::BIGINT AS horizon_sessions, count(*) AS n, regr_slope(actual, score) AS slope, regr_intercept(actual, score) AS intercept, avg(abs(actual - score)) AS mae,
        CASE model {' '.join(f"WHEN '{m}' THEN '{t[3]}'" for m, t in TARGETS.items())} END AS target, '{INTERPRETATION}' AS interpretation FROM pairs WHERE actual IS NOT NULL GROUP BY ALL)""",
    ),
    "direction_metric": (
        ["model", "n", "*legacy", "*corrected"],
        """(SELECT model, count(*) AS n, avg((sign((t - lo) / (hi - lo) * 2 - 1) = sign((score - lo) / (hi - lo) * 2 - 1))::INT) AS legacy, avg((sign(t) = sign(score))::INT) AS corrected
        FROM (SELECT model, ret_fwd_1w AS t, score, min(ret_fwd_1w) OVER (PARTITION BY model) AS lo, max(ret_fwd_1w) OVER (PARTITION BY model) AS hi FROM panel JOIN signals USING (date, ticker) WHERE ret_fwd_1w IS NOT NULL) GROUP BY model)""",
    ),
    "purged_split": (
        ["part", "n", "first_end", "last_target"],
        """(SELECT CASE WHEN day65 <= DATE '1999-12-31' THEN 'train' WHEN date > DATE '1999-12-31' THEN 'val' ELSE 'purged' END AS part, count(*) AS n, min(date) AS first_end, max(day65) AS last_target
        FROM panel JOIN cal USING (date) WHERE day65 IS NOT NULL GROUP BY ALL)""",
    ),
    "rank_target": (["date", "ticker", "*rank_pct"], "(SELECT date, ticker, (rank() OVER (PARTITION BY date ORDER BY ret_fwd_1w) + (count(*) OVER (PARTITION BY date, ret_fwd_1w) - 1) / 2) / count(*) OVER (PARTITION BY date) AS rank_pct FROM panel WHERE tradable AND ret_fwd_1w IS NOT NULL)"),
    "spearman_ic": (
        ["date", "n", "*ic"],
        """(SELECT date, count(*) AS n, CASE WHEN count(*) > 1 THEN corr(rx, ry) END AS ic FROM (SELECT date, rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2 AS rx,
        rank() OVER (PARTITION BY date ORDER BY ret_fwd_1w_lag1) + (count(*) OVER (PARTITION BY date, ret_fwd_1w_lag1) - 1) / 2 AS ry FROM panel JOIN momentum USING (date, ticker) WHERE tradable AND ret_fwd_1w_lag1 IS NOT NULL) GROUP BY date)""",
    ),
    "window_features": (["date", "ticker", "*d_open", "*d_high", "*d_low", "*d_close", "*d_volume"], "(SELECT date, ticker, " + ", ".join(f"CASE WHEN lag(t) OVER w = t - 1 THEN l[{k}] - lag(l[{k}]) OVER w END AS d_{c}" for k, c in enumerate(("open", "high", "low", "close", "volume"), 1)) + " FROM feat WINDOW w AS (PARTITION BY ticker ORDER BY t))"),
    "window_validity": (["ticker", "n", "whole"], "(SELECT ticker, count(*) AS n, (count(*) FILTER (k = 3))::BIGINT AS whole FROM (SELECT ticker, count(*) FILTER (ok) OVER (PARTITION BY ticker ORDER BY t RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS k FROM spok) GROUP BY ticker)"),
    "window_model": (
        _SIG,
        """(SELECT date, ticker, 'stub' AS model, exp(65 * m) - 1 AS score FROM (SELECT x.date, x.ticker, avg(x.h) OVER w AS m, count(x.h) OVER w AS n FROM (SELECT a.date, a.t, a.ticker, ln(a.high) - ln(b.high) AS h
        FROM (SELECT q.*, t FROM avail q JOIN sess USING (date)) a LEFT JOIN (SELECT q.*, t FROM avail q JOIN sess USING (date)) b ON b.ticker = a.ticker AND b.t = a.t - 1) x
        WINDOW w AS (PARTITION BY x.ticker ORDER BY x.t RANGE BETWEEN 251 PRECEDING AND CURRENT ROW)) JOIN dates USING (date) WHERE n = 252)""",
    ),
    "weekly_bars": (["week", "ticker", "*open", "*high", "*low", "*close", "*volume", "last_date"], "wbars"),
    "weekly_features": (["week", "ticker", *(f"*z_{c}" for c in ("open", "high", "low", "close", "volume"))], "(SELECT week, ticker, " + ", ".join(f"z{k} AS z_{c}" for k, c in enumerate(("open", "high", "low", "close", "volume"), 1)) + " FROM wz WHERE z1 IS NOT NULL)"),
    "weekly_model": (_SIG, f"(SELECT p.date, p.ticker, 'weekly_stub' AS model, exp(m) - 1 AS score FROM panel p JOIN wwin w ON w.ticker = p.ticker AND w.week = date_trunc('week', p.date + 2)::DATE - 2 WHERE tradable AND n = {WEEKS})"),
    "training_set": (["ticker", "end", "target_end", "part", "*y", "*mean_high", "*mean_volume"], """(SELECT *, y0 / (SELECT stddev_pop(y0) FROM dsamp WHERE part = 'train') AS y FROM dsamp)"""),
    "feature_scaler": ([f"*{c}_{s}" for c in ("ret_fwd_1w", "ret_fwd_13w") for s in ("mean", "sd")], "(SELECT avg(ret_fwd_1w) AS ret_fwd_1w_mean, stddev_pop(ret_fwd_1w) AS ret_fwd_1w_sd, avg(ret_fwd_13w) AS ret_fwd_13w_mean, stddev_pop(ret_fwd_13w) AS ret_fwd_13w_sd FROM panel WHERE tradable)"),
    "upsert_by_key": (["o_orderkey", "o_custkey", "*o_totalprice"], "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders)"),
    "resume_anti_join": (["k"], "(SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'))"),
    "dense_reindex": (["date", "ticker", "*value"], f"(SELECT d.date, k.ticker, a.adj_close AS value FROM dates d CROSS JOIN (SELECT DISTINCT ticker FROM sparse WHERE date <= {END}) k LEFT JOIN sparse a ON a.ticker = k.ticker AND a.date = d.date)"),
    "melt_metrics": (_METRIC, "(SELECT date, model, metric, value FROM (UNPIVOT wide ON " + ", ".join((*CROSS, *PORTFOLIO)) + " INTO NAME metric VALUE value))"),
    "events_psi": (
        ["model", "year", "*psi"],
        """(WITH s AS (SELECT year(ts) AS year, value AS score, dense_rank() OVER (ORDER BY date_trunc('week', ts)) <= 2 AS dev FROM events),
        b AS (SELECT year, dev, len(list_filter((SELECT quantile_cont(score, [k / 10.0 FOR k IN range(1, 10)]) FROM s WHERE dev), lambda e: score > e)) AS bucket FROM s),
        e AS (SELECT bucket, count(*) / (SELECT count(*) FROM b WHERE dev) AS e FROM b WHERE dev GROUP BY bucket), y AS (SELECT year, count(*) AS total FROM b GROUP BY year), a AS (SELECT year, bucket, count(*) AS n FROM b GROUP BY ALL)
        SELECT 'events' AS model, y.year, sum((greatest(coalesce(n, 0) / total, 1e-4) - greatest(e, 1e-4)) * ln(greatest(coalesce(n, 0) / total, 1e-4) / greatest(e, 1e-4))) AS psi
        FROM y CROSS JOIN e LEFT JOIN a ON a.year = y.year AND a.bucket = e.bucket GROUP BY y.year)""",
    ),
    "events_auc": (["date", "n", "*auc"], "(" + auc_of("(SELECT ts::DATE AS date, value AS score, (event_type = 'purchase')::INT AS y FROM events)", "date") + ")"),
    "events_ks": (["date", "*ks"], "(" + ks_of("(SELECT ts::DATE AS date, value AS score, (event_type = 'purchase')::INT AS y FROM events)", "date") + ")"),
}


def _needed(sql: str) -> set[str]:
    """The parts that a text names, and those that they name, in the order of PARTS."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\w+", re.sub(r"'[^']*'", "", todo.pop())))
        new = {p for p in PARTS if p in words} - found
        found |= new
        todo += [PARTS[p] for p in new]
    return found


def _ordered(names: set[str]) -> list[str]:
    """Parts after those they name."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name in out:
            return
        for p in sorted(set(re.findall(r"\w+", re.sub(r"'[^']*'", "", PARTS[name]))) & names - {name}):
            visit(p)
        out.append(name)

    for n in sorted(names):
        visit(n)
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (cols, src) in FINALS.items():
        exact = {f"*{c}" for c in EXACT.get(name, ())}
        quoted = {"end": '"end"'}
        picked = ", ".join(f"round({c[1:]}, {DIGITS.get(c[1:], 8)}) + 0.0::DOUBLE AS {c[1:]}" if c[0] == "*" and c not in exact else quoted.get(c, c.lstrip("*")) for c in cols)
        final = f"SELECT {picked} FROM {src}"
        parts = _ordered(_needed(final))
        out[name] = ("WITH " + ",\n".join(f"{p} AS MATERIALIZED ({PARTS[p]})" for p in parts) + "\n" if parts else "") + final
    return out
