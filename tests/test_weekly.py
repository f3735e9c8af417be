"""Weekly facts, rank metrics and draws against their long forms."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import FIXTURE
from tidemark.operators import weekly
from tidemark.plans.review import Review
from tidemark.sources import fixtures

ALL = ("quoted", "tradable", "ret_fwd_1w", "ret_fwd_1w_lag1", "ret_fwd_13w", "momentum", "mu", "sigma", "gbm_expected", *weekly.variants(FIXTURE), "vol252")


@pytest.fixture(scope="module")
def review(spark, sf_dir):
    return Review(spark, sf_dir)


def _near(got, want):
    assert len(got) == len(want) > 0
    want = {r[:2]: r[2:] for r in map(tuple, want)}
    for r in map(tuple, got):
        for a, b in zip(r[2:], want[r[:2]], strict=True):
            assert (a is None) == (b is None) and (a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-11)), (r, want[r[:2]])


def test_weekly_facts_are_those_of_the_long_operators(review):
    li = review.table("lineitem")
    facts = fixtures.weekly_facts(li, FIXTURE, ALL, fixtures.market_days(li)).cache()
    cols = ("tradable", "ret_fwd_1w", "ret_fwd_1w_lag1", "ret_fwd_13w")
    rows = weekly.by_week(facts, *ALL)
    _near(rows.filter("quoted").select("ticker", "date", *cols).collect(), review.panel.select("ticker", "date", *cols).collect())
    _near(rows.filter("momentum is not null").select("ticker", "date", "momentum").collect(), review.momentum.select("ticker", "date", "score").collect())
    _near(rows.filter("mu is not null and sigma is not null").select("ticker", "date", "mu", "sigma").collect(), review.mu_sigma.select("ticker", "date", "mu", "sigma").collect())
    _near(rows.filter("gbm_expected is not null").select("ticker", "date", "gbm_expected").collect(), review.gbm_expected.select("ticker", "date", "score").collect())
    _near(rows.filter("vol252 is not null").select("ticker", "date", "vol252").collect(), review.vol.select("ticker", "date", "vol252").collect())
    for m in weekly.variants(FIXTURE):
        _near(rows.filter(F.col(m).isNotNull()).select("ticker", "date", m).collect(), review.variants.filter(F.col("model") == m).select("ticker", "date", "score").collect())


def test_cents_round_halves_as_decimals_do():
    x = np.array([0.05, 1.005, 2.675, 0.125, 12345.67, float("nan")])
    assert fixtures._cents(x).tolist() == [5, 101, 268, 13, 1234567, 0]


def _ranks(spark, rows, spans):
    """window_ranks and auc_and_ks of the same windows: (span, auc, ks)."""
    from tidemark.operators import monitoring as M

    df = spark.createDataFrame(rows, "model string, week int, score double, r1 double, y1 int, r13 double, y13 int")
    got = {r["span"]: (r["auc"], r["ks"]) for r in M.window_ranks(df, spans, M.weekly_sums(df).toPandas()).collect()}
    want = {}
    for s, model, kind, lo, hi in spans:
        win = df.filter((F.col("model") == model) & F.col("week").between(lo, hi) & F.col(f"r{kind}").isNotNull())
        for r in M.auc_and_ks(win.select("model", "score", F.col(f"r{kind}").alias("r"), F.col(f"y{kind}").alias("y")), "model").collect():
            if r["auc"] is not None:
                want[s] = (r["auc"], r["ks"])
    return got, want


def test_window_ranks_are_those_of_each_window_alone(spark):
    rng, rows = np.random.default_rng(1), []
    for week in range(1, 13):
        for i in range(40):
            score = float(rng.integers(0, 30)) / 7.0 if i % 2 else float(rng.normal())  # ties within and between weeks
            r13 = None if i % 5 == 0 else float(rng.normal())
            rows.append(("a" if i % 3 else "b", week, score, float(rng.normal()), int(rng.integers(0, 2)), r13, int(rng.integers(0, 2))))
    rows += [("b", 13, 0.5, 0.1, 1, None, None), ("b", 13, 0.7, 0.1, 1, None, None)]  # one class only
    spans = [(i, m, k, lo, lo + 4) for i, (m, k, lo) in enumerate((m, k, lo) for m in "ab" for k in ("1", "13") for lo in range(1, 9))]
    spans.append((len(spans), "b", "1", 13, 13))
    got, want = _ranks(spark, rows, spans)
    assert set(got) == set(want) == set(range(len(spans) - 1))
    for s, pair in want.items():
        assert got[s] == pytest.approx(pair, rel=1e-12)


def test_window_ranks_of_one_common_score(spark):
    rows = [("a", w, 1.0, 0.1, i % 2, 0.1, i % 2) for w in (1, 2) for i in range(20)] + [("a", 1, 2.0, 0.1, 1, 0.1, 1), ("a", 2, 0.0, 0.1, 0, 0.1, 0)]
    got, want = _ranks(spark, rows, [(0, "a", "1", 1, 2), (1, "a", "13", 2, 2)])
    assert set(got) == {0, 1} and all(got[s] == pytest.approx(want[s], rel=1e-12) for s in got)


def test_digests_are_md5(spark):
    import hashlib

    from tidemark.functions.digests import md5_words, packed

    names = ["S1", "S12345", "", "Ü-9", "x" * 60]
    for some in (names[:4], names):
        words = md5_words("p0|7|1998-01-05|", packed(some), ("", "|12"))
        for i, name in enumerate(some):
            for k, end in enumerate(("", "|12")):
                assert "".join(f"{int(w):08x}" for w in words[:, k, i]) == hashlib.md5(f"p0|7|1998-01-05|{name}{end}".encode()).hexdigest()


#: Queries that must not store daily prices or the long weekly panel.
LEAN = (
    "latest_monitoring", "melt_metrics", "metrics_wide", "validation_results", "challenger_returns", "champion_challenger", "gate_decisions", "gate_off_share", "gbm_path",
    "gate_reasons", "permutation_null",
)


@pytest.mark.parametrize("name", LEAN)
def test_daily_rows_are_not_stored(name, spark, sf_dir, lean):
    from tidemark.plans.review import QUERIES

    QUERIES[name](lean)
    assert not {"prices", "panel", "momentum", "mu_sigma", "variants", "vol", "scored"} & set(vars(lean))


@pytest.fixture(scope="module")
def lean(spark, sf_dir):
    return Review(spark, sf_dir)


def test_grid_has_what_the_long_operators_find(review):
    from tidemark.operators import backtest as B
    from tidemark.operators import monitoring as M
    from tidemark.operators import panel as P

    grid, cfg = review.reviewed, review.cfg
    cols = ("strategy", "date", "ticker", "w", "ret_fwd_1w_lag1")
    by_name = lambda df: [((*r[1:3],), *r[3:]) for r in map(tuple, df.select(*cols).collect())]
    got, want = (dict((r[0], r[1:]) for r in by_name(df)) for df in (grid.held(), B.top_n_weights(B.scored_panel(review.panel, review.momentum, cfg), cfg.top_n)))
    assert got.keys() == want.keys() and all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-11) for k in got for a, b in zip(got[k], want[k], strict=True))
    cols = ("strategy", "date", "ret_gross", "ret_net", "turnover", "n_held")
    _near(grid.equal_weight().unionByName(grid.benchmark()).select(*cols).collect(), review.bench.select(*cols).collect())
    key = F.concat_ws("|", "model", "metric").alias("key")
    metrics = (grid.rolling_metrics(P.calendar(review.prices, cfg)), M.rolling_metrics(review.scored, review.prices, review.vol, cfg))
    _near(*(df.select(key, "date", "value").collect() for df in metrics))


def test_weights_refuse_a_name_without_a_return(review, spark):
    from dataclasses import replace

    from tidemark.operators import grid as Gr

    g = review.reviewed
    weeks = weekly.Weeks.of(review.market[:, 0], FIXTURE)
    w = len(weeks.at)
    bare = {"tradable": np.ones((1, w), bool)} | {k: np.full((1, w), np.nan) for k in ("ret_fwd_1w_lag1", "ret_fwd_13w", "momentum", "vol252")}
    one = Gr.as_grid(["S1"], bare, weeks)
    table = spark.createDataFrame([tuple(one.column(i)[0].as_py() for i in range(one.num_columns))], Gr.SCHEMA)
    with pytest.raises(ValueError, match="missing return"):
        Gr.Grid(table, weeks, g.market, replace(FIXTURE), "momentum").equal_weight()


def test_packing_keeps_every_number():
    rng = np.random.default_rng(0)
    for x in (rng.normal(size=(3, 7)), rng.integers(-(2**62), 2**62, (2, 5)), np.array([[np.nan, -0.0, np.inf]]), np.zeros((2, 0))):
        import pyarrow as pa

        assert weekly.unpack(pa.py_buffer(weekly.pack(x)), len(x), x.dtype.name).tobytes() == x.tobytes()


def test_melt_metrics_moves_few_bytes_a_shipment(spark, review):
    """Shipments are dealt out packed, and what is stored has a row a block of tickers."""
    li = review.table("lineitem")
    moved = fixtures._dealt(li).select(F.sum(F.length("blob"))).first()[0]
    assert moved < 10 * li.count()
    tickers = li.select("l_suppkey").distinct().count() + 1
    assert review.reviewed.table.count() <= tickers / 2


def test_market_sums_round_halves_as_decimals_do(spark):
    x = [0.05, 1.005, 2.675, 0.125, 12345.67, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    assert [r[0] for r in df.select(fixtures._cents_of("x")).collect()] == [5, 101, 268, 13, 1234567, 0, 0]


def _grid_of(spark, values):
    """A grid of one score; values: tickers by weeks, one frame a block."""
    from tidemark.operators import grid as Gr

    w = values[0].shape[1]
    weeks = weekly.Weeks(np.arange(w) * 7, np.arange(w))
    rows = []
    for k, x in enumerate(values):
        found = {"tradable": np.ones(x.shape, bool)} | {c: x * s for c, s in (("ret_fwd_1w_lag1", 1.0), ("ret_fwd_13w", -2.0), ("momentum", 1.0), ("vol252", 3.0))}
        one = Gr.as_grid([f"S{k}_{i}" for i in range(len(x))], found, weeks)
        rows.append(tuple(one.column(i)[0].as_py() for i in range(one.num_columns)))
    table = spark.createDataFrame(rows, Gr.SCHEMA).repartition(3)
    return Gr.Grid(table, weeks, {"quoted": np.ones(w), "ret_fwd_1w_lag1": np.zeros(w), "tradable": np.ones(w)}, FIXTURE, "momentum")


def test_metrics_wide_finds_exact_deciles_and_medians(spark, monkeypatch):
    """Deciles and medians without a sort of all values in one task, from few values of each task."""
    from tidemark.operators import grid as Gr

    rng = np.random.default_rng(3)
    ties = rng.integers(0, 4, (40, 30)) / 4.0
    for values in ([rng.normal(size=(50, 30)) ** 3 for _ in range(7)], [ties, ties, ties[:3]], [np.full((9, 30), 0.5)], [np.arange(30.0)[None, :]]):
        grid, every = _grid_of(spark, values), np.concatenate(values)
        for sent in (7, 1024):
            monkeypatch.setattr(Gr, "SENT", sent)
            dev = np.arange(20)
            got = grid._psi_edges(dev)
            for c, s in (("score", 1.0), ("vol", 3.0)):
                df = spark.createDataFrame([(float(v) * s,) for v in every[:, dev].ravel()], "x double")
                want = df.agg(F.array_distinct(F.percentile("x", F.array(*(F.lit(k / 10) for k in range(11)))))).first()[0][1:-1]
                assert got[c].tolist() == want
        medians = grid._medians()
        assert medians["m1"].tolist() == np.median(every, axis=0).tolist() and medians["m13"].tolist() == np.median(-2.0 * every, axis=0).tolist()


def _shuffles(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.length()) if (name := files.apply(k).getName()).startswith("shuffle_") and name.endswith(".data")}


def test_gate_decisions_leaves_no_shuffle_of_what_is_stored(spark):
    from tidemark.sources import warehouse

    before = _shuffles(spark)
    out = warehouse.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    medians = _grid_of(spark, [np.arange(60.0).reshape(6, 10)])._medians()
    assert out.count() == 7 and len(medians) == 10
    kept = {name.split("_")[1] for name in _shuffles(spark) - before}
    assert len(kept) <= 1  # of the count above
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_gate_reasons_stores_scores_packed_alone(spark, sf_dir, monkeypatch):
    from tidemark.plans.review import QUERIES

    stored, keep = [], Review._keep
    monkeypatch.setattr(Review, "_keep", lambda self, df: stored.append(dict(df.dtypes)) or keep(self, df))
    QUERIES["gate_reasons"](Review(spark, sf_dir))
    assert [t["score"] for t in stored if "score" in t] == ["binary"]


def test_gate_reasons_keeps_shipping_days_instead_of_facts(spark, sf_dir):
    """Facts of a block are found from its shipping days bit for bit; a block with a day without a price keeps its facts."""
    from tidemark.operators import grid as Gr

    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    odd = li.withColumn("l_discount", F.when(F.col("l_suppkey") == 3, F.lit(1.0)).otherwise(F.col("l_discount")))
    late = li.limit(40).withColumn("l_suppkey", F.lit(77_777)).withColumn("l_shipdate", F.to_timestamp(F.lit("2004-02-01")))
    wanted = Gr.wanted("momentum")
    for df, least in ((li, 1.0), (odd, 0.0), (li.unionByName(late), 1.0)):
        market = fixtures.market_days(df)
        weeks = weekly.Weeks.of(market[:, 0], FIXTURE)
        stored = fixtures.weekly_grid(df, FIXTURE, "momentum", market).toArrow().to_batches()
        dense = fixtures._facts(df, FIXTURE, market, weekly.SPAN, lambda names, _, facts, weeks=weeks: Gr.as_grid(names, facts(wanted), weeks), Gr.SCHEMA).toArrow().to_batches()
        with_cells = sum(x.column("cells").null_count == 0 for x in stored) / len(stored)
        assert with_cells >= least and (least == 1.0 or any(x.column("r1").null_count == 0 for x in stored))
        got, want = ({b["tickers"][0].as_py(): b for b in Gr._blocks(side, weeks, FIXTURE)} for side in (stored, dense))
        assert got.keys() == want.keys() and len(got) > 1
        for first, b in got.items():
            assert b["tickers"].to_pylist() == want[first]["tickers"].to_pylist()
            for c in ("tradable", "r1", "r13", "score", "vol"):
                assert b[c].tobytes() == want[first][c].tobytes(), (first, c)
        size = [sum(len(v) for x in side for c in x.schema.names[1:] for v in x.column(c).to_pylist() if v) for side in (stored, dense)]
        assert least < 1.0 or size[0] < 0.6 * size[1]
