"""Behaviour on small inputs."""

from __future__ import annotations

import datetime as dt
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import ReviewConfig
from tidemark.functions import stats
from tidemark.operators import backtest as B
from tidemark.operators import calibration as K
from tidemark.operators import gate as G
from tidemark.operators import monitoring as M
from tidemark.operators import overfit as O
from tidemark.operators import panel as P
from tidemark.operators import training as T

D = dt.date
CFG = ReviewConfig()


def weights(spark, rows):
    return spark.createDataFrame([("s", *r, 0.0) for r in rows], "strategy string, date date, ticker string, w double, ret_fwd_1w_lag1 double, ret_fwd_1w double")


def test_turnover_drifts_and_costs(spark):
    a, b = D(2022, 1, 7), D(2022, 1, 14)
    w = weights(spark, [(a, "A", 0.5, 1.0), (a, "B", 0.5, 0.0), (b, "A", 0.5, 0.0), (b, "B", 0.5, 0.0)])
    rows = B.portfolio_returns(w, CFG).orderBy("date").collect()
    assert rows[1].turnover == pytest.approx(1 / 6)
    assert rows[1].ret_net == pytest.approx(-0.001 / 3)


def test_missing_held_return_raises(spark):
    w = weights(spark, [(D(2022, 1, 7), "A", 1.0, None)])
    with pytest.raises(Exception, match="missing return"):
        B.portfolio_returns(w, CFG).collect()


def test_unheld_missing_return_is_zero(spark):
    w = weights(spark, [(D(2022, 1, 7), "A", 1.0, 0.1), (D(2022, 1, 7), "B", 0.0, None)])
    assert B.portfolio_returns(w, CFG).first().ret_gross == pytest.approx(0.1)


def psi(spark, dev, late):
    """The last value of the rolling index: development weeks hold dev, later ones late."""
    cfg = CFG.with_(dev_weeks=2, monitor_window=1, monitor_lag=2)
    rows = [("m", k, float(x)) for k in (1, 2) for x in dev] + [("m", k, float(x)) for k in (3, 4, 5) for x in late]
    wk = spark.createDataFrame([("m", k, D(2020, 1, k)) for k in range(1, 6)], "model string, week int, date date")
    out = M.psi_rolling(spark.createDataFrame(rows, "model string, week int, x double"), wk, cfg)
    return out.orderBy(F.col("date").desc()).first().value


def test_psi_tails(spark):
    x = np.linspace(-1, 1, 1000)
    assert psi(spark, x, x + 100) > 5
    assert psi(spark, x, x) == pytest.approx(0.0)


def test_gate_is_off_without_a_metric(spark):
    wide = spark.createDataFrame([("m", D(2022, 1, 7), 0.6)], "model string, date date, auc_1w double")
    row = G.decide(wide).first()
    assert not row.gate_on
    assert row.reason == "missing:psi_score,missing:rolling_sharpe,missing:active_drawdown"


def test_gate_reasons_keep_rule_order(spark):
    wide = spark.createDataFrame([("m", D(2022, 1, 7), 0.3, 1.0, 0.4, None)], "model string, date date, psi_score double, rolling_sharpe double, auc_1w double, active_drawdown double")
    assert G.decide(wide).first().reason == "psi_score,auc_1w,missing:active_drawdown"


def test_reentry_costs(spark):
    days = [D(2022, 1, 7), D(2022, 1, 14), D(2022, 1, 21)]
    panel = spark.createDataFrame([(d, t, True, 0.0, 0.0) for d in days for t in ("A", "SPY")], "date date, ticker string, tradable boolean, ret_fwd_1w double, ret_fwd_1w_lag1 double")
    signals = spark.createDataFrame([(d, "A", "m", 1.0) for d in days], "date date, ticker string, model string, score double")
    gate = spark.createDataFrame([(days[0], "m", True, None), (days[1], "m", False, "x"), (days[2], "m", True, None)], "date date, model string, gate_on boolean, reason string")
    rows = G.challenger_returns(panel, signals, gate, CFG).orderBy("date").collect()
    assert [r.ret_net for r in rows] == pytest.approx([-0.001] * 3)
    assert [r.n_held for r in rows] == [1, 0, 1]
    assert rows[0].strategy == "m_gated"


def business_days(a, b):
    return [a + dt.timedelta(k) for k in range((b - a).days + 1) if (a + dt.timedelta(k)).weekday() < 5]


def bars(spark, rows):
    return spark.createDataFrame([(d, t, p, p, p, p, p, 1e6) for d, t, p in rows], "date date, ticker string, open double, high double, low double, close double, adj_close double, volume double")


def test_missing_exit_quote_gives_no_return(spark):
    days = business_days(D(2021, 12, 1), D(2022, 2, 1))
    gap = D(2022, 1, 17)
    rows = [(d, t, 100.0 + k) for k, d in enumerate(days) for t in ("SPY", "A") if (t, d) != ("A", gap)]
    panel = P.build_panel(bars(spark, rows), CFG.with_(start="2022-01-07"))
    got = {(r.date, r.ticker): r for r in panel.collect()}
    assert got[D(2022, 1, 7), "A"].ret_fwd_1w_lag1 is None
    price = {d: 100.0 + k for k, d in enumerate(days)}
    assert got[D(2022, 1, 7), "SPY"].ret_fwd_1w_lag1 == pytest.approx(price[gap] / price[D(2022, 1, 10)] - 1)


def test_nothing_after_the_cutoff_matters(spark):
    days = business_days(D(2026, 7, 1), D(2026, 9, 15))
    cfg = CFG.with_(start="2026-07-01")
    flat = P.build_panel(bars(spark, [(d, "SPY", 100.0) for d in days]), cfg).orderBy("date").collect()
    moved = P.build_panel(bars(spark, [(d, "SPY", 100.0 if d <= D(2026, 8, 28) else 10000.0) for d in days]), cfg).orderBy("date").collect()
    assert flat == moved
    assert max(r.date for r in flat if r.ret_fwd_1w_lag1 is not None) == D(2026, 8, 14)
    last = flat[-1]
    assert last.date == D(2026, 8, 28)
    assert last.ret_fwd_1w is last.ret_fwd_1w_lag1 is last.ret_fwd_13w is None


def test_active_returns_start_out_of_time(spark):
    rows = [(D(2021, 12, 31), "m", 0.5), (D(2021, 12, 31), "universe_ew", 0.1), (D(2022, 1, 7), "m", 0.1), (D(2022, 1, 7), "universe_ew", 0.02)]
    r = spark.createDataFrame(rows, "date date, strategy string, ret_net double")
    act = B.active_returns(r, "2022-01-03").filter("strategy = 'm'").collect()
    assert [a.active for a in act] == pytest.approx([0.08])


def test_purged_split(spark):
    rows = [(D(2019, 6, 1), D(2019, 9, 1)), (D(2019, 12, 1), D(2020, 3, 1)), (D(2020, 1, 2), D(2020, 4, 1))]
    got = K.purged_split(spark.createDataFrame(rows, "end date, target_end date"), "2019-12-31").orderBy("end").collect()
    assert [r.part for r in got] == ["train", "purged", "val"]


def test_direction_threshold(spark):
    pairs = spark.createDataFrame([("m", -0.01, 0.01), ("m", 0.01, 0.01)], "model string, true double, predicted double")
    row = K.direction_metric(pairs, -0.1, 0.3).first()
    assert (row.legacy, row.corrected) == (1.0, 0.5)


def test_normal_cdf(spark):
    xs = [-5.0, -1.3, -0.2, 0.0, 0.7, 2.5, 6.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.normal_cdf(F.col("x")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(NormalDist().cdf(r.x), abs=2e-7)


def test_auc_and_ks_with_ties(spark):
    rng = np.random.default_rng(3)
    s, y = rng.integers(0, 6, 200).astype(float), rng.integers(0, 2, 200)
    df = spark.createDataFrame([("k", float(a), int(b)) for a, b in zip(s, y, strict=True)], "k string, score double, y int")
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None]))
    assert M.auc(df, "k").first().auc == pytest.approx(want)
    grid = np.unique(s)
    assert M.ks(df, "k").first().ks == pytest.approx(max(abs((pos <= g).mean() - (neg <= g).mean()) for g in grid))
    one = df.filter("y = 1")
    assert M.auc(one, "k").first().auc is None
    assert M.ks(one, "k").first().ks is None


def test_bootstrap_indices_follow_the_recursion(spark):
    n, block = 37, 5
    lengths = spark.createDataFrame([("s", n)], "strategy string, n long")
    rows = O.bootstrap_indices(lengths, 3, block).collect()
    u = spark.range(n).crossJoin(spark.range(3).withColumnRenamed("id", "draw")).select(
        "draw", "id", stats.uniform(F.lit("s0"), F.col("draw"), F.col("id")).alias("a"), stats.uniform(F.lit("j0"), F.col("draw"), F.col("id")).alias("b")
    ).collect()
    draws = {(r.draw, r.id): (r.a, r.b) for r in u}
    got = {(r.draw, r.i): r.idx for r in rows}
    for d in range(3):
        at = None
        for i in range(n):
            a, b = draws[d, i]
            at = int(b * n) if i == 0 or a < 1 / block else (at + 1) % n
            assert got[d, i] == at


def test_results_do_not_depend_on_partitions(spark):
    rows = [("s", D(2020, 1, 1) + dt.timedelta(7 * k), float(np.sin(k)) / 50) for k in range(80)]
    df = spark.createDataFrame(rows, "strategy string, date date, active double")
    cfg = CFG.with_(bootstrap_n=50)
    one, many = (O.bootstrap_sharpe_ci(df.repartition(n), cfg).first() for n in (1, 7))
    assert one.ci_low == pytest.approx(many.ci_low) and one.p_value == many.p_value


def test_expected_max_sharpe():
    assert stats.expected_max_sharpe(0.04, 1) == 0.0
    assert stats.expected_max_sharpe(0.04, 10) < stats.expected_max_sharpe(0.04, 100)


def test_clean_universe_rules(spark):
    rows = [("A", "x", 10.0, "EQUITY"), ("B", "x", 20.0, "EQUITY"), ("C-D", "y", 30.0, "EQUITY"), ("E", "z", 20.0, "EQUITY"), ("F", "q", 0.0, "EQUITY"), ("G", "w", 9.0, "ETF")]
    df = spark.createDataFrame([(t, n, "NYQ", None, None, m, q) for t, n, m, q in rows], "ticker string, name string, exchange string, sector string, industry string, market_cap double, quote_type string")
    got = P.clean_universe(df, 10, "2026-09-15").orderBy("rank_by_mcap").collect()
    assert [(r.ticker, r.rank_by_mcap) for r in got] == [("B", 1), ("E", 2)]


def test_momentum_does_not_bridge_gaps(spark):
    from tidemark.operators import candidates as C

    days = business_days(D(2020, 1, 1), D(2020, 1, 14))
    cfg = CFG.with_(mom_lookback=3, mom_skip=1)
    rows = [(d, "SPY", 1.0) for d in days] + [(d, "A", float(k + 1)) for k, d in enumerate(days) if k != 4]
    prices = bars(spark, rows)
    dates = spark.createDataFrame([(days[7],), (days[5],), (days[4],)], "date date")
    out = C.momentum(P.price_matrix(prices, cfg), dates, P.sessions(prices, cfg), cfg).filter("ticker = 'A'")
    got = {r.date: r.score for r in out.collect()}
    assert got == {days[4]: pytest.approx(4 / 2 - 1)}  # no quote that day, but both quotes it needs


# Window models -------------------------------------------------------------------------------------


def quotes(spark, rows):
    return spark.createDataFrame([(*r[:2], *map(float, r[2:])) for r in rows], "date date, ticker string, open double, high double, low double, close double, adj_close double, volume double")


def test_weeks_run_from_saturday_to_friday(spark):
    days = [(D(2022, 1, 1) + dt.timedelta(k),) for k in range(20)]
    got = {r.d: r.w for r in spark.createDataFrame(days, "d date").select("d", T.week_of(F.col("d")).alias("w")).collect()}
    for day, week in got.items():
        assert week.weekday() == 5 and 0 <= (day - week).days < 7


def test_weekly_bar(spark):
    rows = [(D(2022, 1, 3), "A", 10, 12, 9, 11, 22, 5), (D(2022, 1, 7), "A", 11, 15, 10, 14, 28, 7), (D(2022, 1, 8), "A", 1, 1, 1, 1, 1, 1), (D(2022, 1, 5), "A", 1, 99, 1, 0, 1, 1)]
    bar = T.weekly_bars(quotes(spark, rows), CFG).orderBy("week").first()
    assert tuple(bar) == (D(2022, 1, 1), "A", 20.0, 30.0, 18.0, 28.0, 12.0, D(2022, 1, 7))


def test_a_missing_week_gives_no_change(spark):
    rows = [(D(2022, 1, 7) + dt.timedelta(7 * k), "A", *[10 * 2**k] * 5, 1) for k in (0, 1, 3, 4)]
    got = [r.f[3] for r in T.weekly_features(quotes(spark, rows), CFG).orderBy("date").collect()]
    assert got == [None, pytest.approx(np.log(2)), None, pytest.approx(np.log(2))]


def test_scaled_and_clipped(spark):
    rows = [(D(2022, 1, k + 1), k, "A", [float(x), 1.0, 1.0, 1.0, 1.0]) for k, x in enumerate([0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 100])]
    df = spark.createDataFrame([*rows, (D(2022, 2, 1), 99, "A", [None] * 5)], "date date, t int, ticker string, f array<double>")
    out = {r.t: r.f for r in T.scaled(df, T.scaler(df), clip=2.0).collect()}
    x = np.array([0.0] * 11 + [100.0])
    assert out[0][0] == pytest.approx(-x.mean() / x.std()) and out[11][0] == 2.0 and out[11][1] == 0.0 and out[99] == [None] * 5


def test_training_set_is_brute_force(spark):
    rng = np.random.default_rng(5)
    start, n, length, horizon = D(2020, 1, 1), 60, 5, 3
    paths = {t: 100 * np.exp(np.cumsum(rng.normal(scale=0.02, size=n))) for t in "ABC"}
    rows = [(start + dt.timedelta(k), t, p * 0.99, p * 1.01, p * 0.98, p, p / 2, 0 if t == "B" and k == 30 else 10 + k) for t, path in paths.items() for k, p in enumerate(path)]
    rows = [r if not (r[1] == "C" and r[0] == start + dt.timedelta(20)) else (*r[:3], float("nan"), *r[4:]) for r in rows]
    split = "2020-02-05"
    got = {(r.ticker, r.end): r for r in T.training_set(quotes(spark, rows), CFG, split, length, horizon, 4, 2.0).collect()}
    own = {}
    for t in paths:
        q = np.array([[*(x * r[6] / r[5] for x in r[2:6]), r[7]] for r in sorted(r for r in rows if r[1] == t)])
        logs = np.column_stack([np.log(q[:, :4]), np.log1p(q[:, 4])])
        own[t] = np.vstack([[np.nan] * 5, np.diff(logs, axis=0)])
    days = [start + dt.timedelta(k) for k in range(n)]
    fit = np.vstack([f[[d < D(2020, 2, 5) for d in days]] for f in own.values()])
    fit = fit[np.isfinite(fit).all(axis=1)]
    want = {}
    for t, f in own.items():
        for e in range(length - 1, n - horizon, 4):
            if np.isfinite(f[e - length + 1 : e + horizon + 1]).all():
                z = np.clip((f[e - length + 1 : e + 1] - fit.mean(axis=0)) / fit.std(axis=0), -2, 2)
                want[t, days[e]] = (z, f[e + 1 : e + horizon + 1, 3].sum(), days[e + horizon])
    assert set(got) == set(want) and len(want) > 20
    parts = {}
    for (t, end), (z, _, last) in want.items():
        r = got[t, end]
        assert np.allclose(np.array(r.window), z) and r.target_end == last
        assert r.part == ("train" if last < D(2020, 2, 5) else "val" if end >= D(2020, 2, 5) else "purged")
        parts[t, end] = r.part
    rank = {k: (sum(x[1] <= v[1] for j, x in want.items() if j[1] == k[1]) / sum(j[1] == k[1] for j in want)) - 0.5 for k, v in want.items()}
    sd = np.std([v for k, v in rank.items() if parts[k] == "train"])
    assert all(got[k].y == pytest.approx(rank[k] / sd) for k in want) and set(parts.values()) == {"train", "val", "purged"}
