"""The review as one lazily built set of frames over the star-schema fixture, and its queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import FIXTURE, ReviewConfig
from tidemark.functions.stats import sharpe
from tidemark.operators import backtest as B
from tidemark.operators import calibration as K
from tidemark.operators import candidates as C
from tidemark.operators import gate as G
from tidemark.operators import monitoring as M
from tidemark.operators import overfit as O
from tidemark.operators import panel as P
from tidemark.operators import training as T
from tidemark.operators import weekly as W
from tidemark.operators.grid import Grid
from tidemark.sources import fixtures, warehouse

VARIANT_TRIALS = tuple(f"gbm_w_{lb}_{m}" for lb in (63, 126, 252) for m in ("expected", "prob_up"))
TRIALS = ("momentum", "gbm_expected", *VARIANT_TRIALS, "never_run")
#: The two models that the review tests.
MODELS = ("momentum", "gbm_expected")
#: Of the training queries: weeks of a weekly window, sessions of a daily one, sessions to the target, first day after training.
TRAINING = (13, 252, 65, "1999-12-31")


class Review:
    """Frames that several queries share. Tables of the review (prices, panel, scores, returns, metrics) are
    written when first used and read back, which cuts the plans that build on them and survives lost executors."""

    def __init__(self, spark: SparkSession, sf_dir: str, cfg: ReviewConfig = FIXTURE):
        self.spark, self.dir, self.cfg = spark, sf_dir, cfg

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _keep(self, df: DataFrame) -> DataFrame:
        return warehouse.written(df)

    @cached_property
    def prices(self) -> DataFrame:
        return self._keep(fixtures.dense_prices(self.table("lineitem"), self.cfg.benchmark))

    @cached_property
    def sparse(self) -> DataFrame:
        return fixtures.sparse_prices(self.table("lineitem"), self.cfg.benchmark)

    @cached_property
    def panel(self) -> DataFrame:
        return self._keep(P.build_panel(self.prices, self.cfg))

    @cached_property
    def dates(self) -> DataFrame:
        return P.rebalance_dates(self.panel)

    @cached_property
    def sess(self) -> DataFrame:
        return P.sessions(self.prices, self.cfg)

    @cached_property
    def matrix(self) -> DataFrame:
        return P.price_matrix(self.prices, self.cfg)

    @cached_property
    def momentum(self) -> DataFrame:
        return self._keep(C.momentum(self.matrix, self.dates, self.sess, self.cfg))

    @cached_property
    def mu_sigma(self) -> DataFrame:
        return self._keep(C.gbm_mu_sigma(self.matrix, self.dates, self.sess, self.cfg))

    @cached_property
    def gbm_expected(self) -> DataFrame:
        return C.gbm_expected(self.mu_sigma, self.cfg)

    @cached_property
    def variants(self) -> DataFrame:
        return self._keep(C.gbm_weekly_variants(self.matrix, self.dates, self.sess, self.cfg))

    @cached_property
    def signals(self) -> DataFrame:
        """The two models that the review tests."""
        return self.momentum.unionByName(self.gbm_expected)

    @cached_property
    def bench(self) -> DataFrame:
        return self._keep(B.benchmarks(self.panel, self.cfg))

    @cached_property
    def models(self) -> DataFrame:
        return self._keep(B.run_models(self.panel, self.signals, self.cfg))

    @cached_property
    def returns(self) -> DataFrame:
        return self.models.unionByName(self.bench)

    @cached_property
    def active(self) -> DataFrame:
        return B.active_returns(self.returns, self.cfg.oot_start).filter(F.col("strategy").isin("momentum", "gbm_expected"))

    @cached_property
    def scored(self) -> DataFrame:
        return self._keep(M.scored(self.panel, self.momentum, self.cfg))

    @cached_property
    def vol(self) -> DataFrame:
        return self._keep(P.realised_vol(self.prices, self.panel, self.cfg))

    @cached_property
    def monitoring(self) -> DataFrame:
        own = M.portfolio_metrics(self.champion.filter(F.col("strategy").isin("momentum", "universe_ew")), self.cfg).filter("model = 'momentum'")
        return self._keep(self.reviewed.rolling_metrics(P.calendar(self.sessions_known, self.cfg)).unionByName(own))

    @cached_property
    def market(self):
        """Sums of each session; a few thousand rows on the driver."""
        return fixtures.market_days(self.table("lineitem"))

    def facts(self, *want: str) -> DataFrame:
        """Weekly facts, a row a ticker, straight from the shipments."""
        return fixtures.weekly_facts(self.table("lineitem"), self.cfg, ("quoted", "tradable", "ret_fwd_1w", "ret_fwd_1w_lag1", *want), self.market)

    @cached_property
    def reviewed(self) -> Grid:
        """What monitoring and the gate ask of prices."""
        weeks, own = fixtures.market_facts(self.market, self.cfg, ("quoted", "tradable", "ret_fwd_1w_lag1"))
        return Grid(self._keep(fixtures.weekly_grid(self.table("lineitem"), self.cfg, "momentum", self.market)), weeks, own, self.cfg, "momentum")

    @cached_property
    def tested(self) -> DataFrame:
        """What the tests of the models and trials ask of prices."""
        return self._keep(self.facts("momentum", "gbm_expected", *W.variants(self.cfg)))

    @cached_property
    def sessions_known(self) -> DataFrame:
        days = [(int(d),) for d in self.market[:, 0]]
        dates = self.spark.createDataFrame(days, "d int").select(F.date_from_unix_date("d").alias("date"))
        return dates.withColumn("ticker", F.lit(self.cfg.benchmark))

    @cached_property
    def held(self) -> DataFrame:
        """The names that momentum holds."""
        return self._keep(self.reviewed.held())

    @cached_property
    def champion(self) -> DataFrame:
        """Returns of momentum and of the benchmarks."""
        return self._keep(B.portfolio_returns(self.held, self.cfg).unionByName(self.reviewed.equal_weight()).unionByName(self.reviewed.benchmark()))

    @cached_property
    def tested_models(self) -> DataFrame:
        """What the permutation test asks of prices."""
        return self._keep(self.facts(*MODELS))

    @cached_property
    def tested_returns(self) -> DataFrame:
        rows = B.scored_facts(self.tested_models, self.cfg, *MODELS)
        return self._keep(B.portfolio_returns(self._keep(B.top_n_weights(rows, self.cfg.top_n)), self.cfg).unionByName(B.bench_of(self.tested_models, self.cfg)))

    @cached_property
    def trial_returns(self) -> DataFrame:
        """Returns of models, trials and benchmarks."""
        rows = B.scored_facts(self.tested, self.cfg, "momentum", "gbm_expected", *W.variants(self.cfg))
        return self._keep(B.portfolio_returns(self._keep(B.top_n_weights(rows, self.cfg.top_n)), self.cfg).unionByName(B.bench_of(self.tested, self.cfg)))

    @cached_property
    def wide(self) -> DataFrame:
        return G.metrics_wide(self.monitoring, self.cfg)

    @cached_property
    def gate(self) -> DataFrame:
        return self._keep(G.decide(self.wide, self.cfg.rules))

    @cached_property
    def weekly(self) -> DataFrame:
        """Weekly features, scaled over all weeks and clipped."""
        features = T.weekly_features(self.prices, self.cfg)
        return T.scaled(features, T.scaler(features))

    @cached_property
    def challenger(self) -> DataFrame:
        return G.gated_returns(self.held, self.gate, self.cfg)


_REVIEWS: dict[tuple, tuple[tuple, Review]] = {}


def _state(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of what the folder holds."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in found))


def review(spark: SparkSession, sf_dir: str) -> Review:
    """The review of a data folder. The tables it has written serve later queries of the application, until the folder changes."""
    key, state = (spark.sparkContext.applicationId, sf_dir), _state(spark, sf_dir)
    if _REVIEWS.get(key, (None,))[0] != state:
        _REVIEWS[key] = (state, Review(spark, sf_dir))
    return _REVIEWS[key][1]


#: Prices come out bit for bit alike in any engine, as their sums are decimal; they are not rounded.
EXACT = {
    "panel": ("close", "adj_close"), "panel_sparse": ("close", "adj_close"), "price_matrix_long": ("value",), "stride_sample": ("value",), "dense_reindex": ("value",),
    "weekly_bars": ("open", "high", "low", "close", "volume"), "universe_clean": ("market_cap",), "upsert_by_key": ("o_totalprice",),
}
#: Digits where 8 are more than a double of that size holds.
DIGITS = {"adv20_usd": 2}


def rounded(df: DataFrame, exact: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded for comparison with another engine, which sums in another order."""
    doubles = [c for c, t in df.dtypes if t == "double" and c not in exact]
    return df.withColumns({c: F.round(c, DIGITS.get(c, 8)) + F.lit(0.0) for c in doubles})


Q = Callable[[Review], DataFrame]
#: name -> query; doubles are rounded to 8 digits on the way out.
QUERIES: dict[str, Q] = {
    # universe, calendar, panel
    "universe_clean": lambda r: P.clean_universe(fixtures.listing(r.table("part")), r.cfg.universe_size, r.cfg.universe_asof).select(
        "ticker", "name", "exchange", "sector", "market_cap", "rank_by_mcap", "asof_date"
    ),
    "prices_quality": lambda r: r.prices.groupBy("ticker").agg(
        F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum((F.col("volume") == 0).cast("int")).alias("quiet_days"),
        F.avg("close").alias("avg_close"),
    ),
    "calendar_schedule": lambda r: P.schedule(P.calendar(r.prices, r.cfg)),
    "panel": lambda r: r.panel,
    "panel_sparse": lambda r: P.build_panel(r.sparse, r.cfg),
    "panel_summary": lambda r: r.panel.agg(
        F.count("*").alias("n_rows"), F.countDistinct("date").alias("weeks"), F.countDistinct("ticker").alias("tickers"), F.avg(F.col("tradable").cast("int")).alias("tradable_share"),
        F.count("ret_fwd_1w_lag1").alias("with_return"), F.count("ret_fwd_13w").alias("with_13w"),
        F.max(F.when((F.col("ticker") == r.cfg.benchmark) & F.col("ret_fwd_1w_lag1").isNotNull(), F.col("date"))).alias("last_complete"),
    ),
    "rebalance_dates": lambda r: r.dates,
    "universe_coverage": lambda r: P.coverage(r.panel),
    "names_by_year": lambda r: P.available(r.prices, r.cfg).groupBy(F.year("date").cast("long").alias("year")).agg(F.countDistinct("ticker").alias("names"), F.count("*").alias("n_rows")),
    "price_matrix_long": lambda r: P.price_matrix(r.prices, r.cfg, "high"),
    "stride_sample": lambda r: P.stride_sample(r.matrix),
    "first_names": lambda r: P.first_names(fixtures.listing(r.table("part"))),
    "realised_vol": lambda r: r.vol,
    # candidates
    "momentum": lambda r: r.momentum,
    "gbm_mu_sigma": lambda r: r.mu_sigma,
    "gbm_expected": lambda r: r.gbm_expected,
    "gbm_path": lambda r: C.gbm_path(r.facts("mu", "sigma"), r.cfg),
    "gbm_weekly_variants": lambda r: r.variants,
    "gbm_weekly_select": lambda r: B.select_variant(r.panel, r.variants, r.bench, r.cfg),
    "signal_alias": lambda r: C.as_model(r.variants, "gbm_w_126_expected", "gbm_weekly"),
    "signal_inventory": lambda r: C.inventory(r.signals.unionByName(r.variants)),
    # backtest
    "topn_weights": lambda r: B.top_n_weights(B.scored_panel(r.panel, r.momentum, r.cfg), r.cfg.top_n).select("strategy", "date", "ticker", "w"),
    "portfolio_returns": lambda r: r.models,
    "same_close_returns": lambda r: B.same_close(r.panel, r.momentum, r.cfg),
    "benchmark_spy": lambda r: r.bench.filter("strategy = 'benchmark_spy'"),
    "universe_ew": lambda r: r.bench.filter("strategy = 'universe_ew'"),
    "performance_summary": lambda r: B.summary(r.returns),
    "champion_challenger": lambda r: B.champion_challenger(r.champion.unionByName(r.challenger), r.cfg.oot_start),
    "growth_curve": lambda r: B.growth_curve(r.returns.filter(F.col("date") >= F.lit(r.cfg.oot_start).cast("date"))),
    # monitoring
    "psi_by_year": lambda r: M.psi_by_year(r.scored, r.cfg),
    "psi_rolling": lambda r: M.psi_score(r.scored, r.cfg),
    "psi_input_rolling": lambda r: M.psi_input(r.scored, r.vol, r.cfg),
    "auc_by_year": lambda r: M.auc_by_year(r.scored),
    "auc_rolling": lambda r: M.auc_rolling(M.windowed(r.scored, M.lookback(r.scored, r.cfg), "r1", "y1"), "1w"),
    "ks_rolling": lambda r: M.ks_rolling(M.windowed(r.scored, M.lookback(r.scored, r.cfg), "r1", "y1"), "1w"),
    "auc_13w_rolling": lambda r: M.auc_rolling(M.windowed(r.scored, M.matured(r.scored, r.prices, r.cfg), "r13", "y13"), "13w"),
    "ks_13w_rolling": lambda r: M.ks_rolling(M.windowed(r.scored, M.matured(r.scored, r.prices, r.cfg), "r13", "y13"), "13w"),
    "association_slope_13w": lambda r: M.association_slope(M.windowed(r.scored, M.matured(r.scored, r.prices, r.cfg), "r13", "y13")),
    "portfolio_metrics": lambda r: M.portfolio_metrics(r.returns, r.cfg),
    "latest_monitoring": lambda r: M.latest(r.monitoring),
    # gate
    "metrics_wide": lambda r: r.wide,
    "gate_decisions": lambda r: r.gate,
    "gate_reasons": lambda r: G.reasons(r.gate),
    "gate_off_share": lambda r: G.off_share(r.gate, r.champion, r.cfg.oot_start),
    "challenger_returns": lambda r: r.challenger,
    # statistics
    "active_returns": lambda r: r.active,
    "sharpe": lambda r: r.active.groupBy("strategy").agg(F.count("*").alias("n"), sharpe(F.avg("active"), F.stddev_samp("active"), r.cfg.weeks_per_year).alias("sharpe")),
    "bootstrap_indices": lambda r: O.bootstrap_indices(r.active.groupBy("strategy").agg(F.count("*").alias("n")), r.cfg.bootstrap_n, r.cfg.bootstrap_block),
    "bootstrap_sharpe_ci": lambda r: O.bootstrap_sharpe_ci(r.active, r.cfg),
    "probabilistic_sharpe": lambda r: O.probabilistic(r.active),
    "deflated_sharpe": lambda r: O.deflated_sharpe(r.active, r.active.groupBy("strategy").agg(sharpe(F.avg("active"), F.stddev_samp("active")).alias("sr")), r.cfg),
    "permutation_null": lambda r: O.permutation_null(None, None, r.tested_returns, r.cfg, scored=B.scored_facts(r.tested_models, r.cfg, *MODELS)),
    "validation_results": lambda r: O.run_all(
        r.spark, None, r.spark.createDataFrame([(m,) for m in MODELS], "model string"), r.trial_returns, list(TRIALS), r.cfg, r.cfg.n_trials, B.scored_facts(r.tested, r.cfg, *MODELS)
    ),
    "paired_bootstrap": lambda r: O.paired_bootstrap(r.active, [("momentum", "gbm_expected")], r.cfg),
    "contrast_verdict": lambda r: O.paired_bootstrap(r.active, [("momentum", "gbm_expected"), ("gbm_expected", "momentum")], r.cfg).select(
        "strategy", B.verdict(F.col("ci_low"), F.col("ci_high")).alias("verdict")
    ),
    # calibration and training
    "matched_calibration": lambda r: K.matched_calibration(K.calibration_pairs(r.prices, r.panel, r.gbm_expected.unionByName(C.as_model(r.variants, "gbm_w_126_expected", "gbm_weekly")), r.cfg)),
    "direction_metric": lambda r: K.direction_metric(
        r.panel.join(r.signals, ["date", "ticker"]).filter("ret_fwd_1w is not null").select("model", F.col("ret_fwd_1w").alias("true"), F.col("score").alias("predicted"))
    ),
    "purged_split": lambda r: K.purged_split(
        r.panel.select("ticker", F.col("date").alias("end")).join(F.broadcast(P.calendar(r.prices, r.cfg).select(F.col("date").alias("end"), F.col("day65").alias("target_end"))), "end").filter("target_end is not null"),
        "1999-12-31",
    ).groupBy("part").agg(F.count("*").alias("n"), F.min("end").alias("first_end"), F.max("target_end").alias("last_target")),
    "rank_target": lambda r: K.rank_target(r.panel.filter("tradable")).select("date", "ticker", "rank_pct"),
    "spearman_ic": lambda r: K.spearman_ic(r.panel.filter("tradable").join(r.momentum, ["date", "ticker"]), "score", "ret_fwd_1w_lag1", "date"),
    "window_features": lambda r: K.window_features(r.prices, r.sess, r.cfg, True).select(
        "date", "ticker", *(F.col("f")[k].alias(f"d_{c}") for k, c in enumerate(K.OHLCV))
    ),
    "window_validity": lambda r: K.finite_windows(
        K.window_features(r.sparse, P.sessions(r.sparse, r.cfg), r.cfg).withColumn("ok", F.forall("f", lambda x: x.isNotNull())), "ok", 3
    ).groupBy("ticker").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("whole"), F.lit(False)).cast("int")).alias("whole")),
    "window_model": lambda r: K.window_scores(K.feature_windows(K.window_features(r.prices, r.sess, r.cfg), r.dates, 252), "stub"),
    "weekly_bars": lambda r: T.weekly_bars(r.prices, r.cfg),
    "weekly_features": lambda r: r.weekly.filter("f[0] is not null").select(F.col("date").alias("week"), "ticker", *(F.col("f")[k].alias(f"z_{c}") for k, c in enumerate(K.OHLCV))),
    "weekly_model": lambda r: K.window_scores(T.tradable_windows(r.weekly, r.panel, TRAINING[0], weekly=True), "weekly_stub", lambda w: w[:, :, 1].mean(axis=1)),
    "training_set": lambda r: T.training_set(r.prices, r.cfg, TRAINING[3], TRAINING[1], TRAINING[2], TRAINING[2]).select(
        "ticker", "end", "target_end", "part", "y",
        _window_mean(1).alias("mean_high"), _window_mean(4).alias("mean_volume"),
    ),
    "feature_scaler": lambda r: K.scaler(r.panel.filter("tradable"), ["ret_fwd_1w", "ret_fwd_13w"]),
    # table operations
    "upsert_by_key": lambda r: warehouse.upsert(
        r.table("orders").select("o_orderkey", "o_custkey", "o_totalprice"),
        r.table("orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", (F.col("o_totalprice") * 2).alias("o_totalprice")), ("o_orderkey",),
    ),
    "resume_anti_join": lambda r: warehouse.not_yet_stored(
        r.table("customer").select(F.col("c_custkey").alias("k")), r.table("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")), "k"
    ),
    "dense_reindex": lambda r: P.dense_reindex(P.price_matrix(r.sparse, r.cfg), r.dates, r.sess).join(F.broadcast(r.dates), "date", "left_semi").select("date", "ticker", "value"),
    "melt_metrics": lambda r: M.melt(r.wide, [*G.CROSS, *G.PORTFOLIO]),
    "events_psi": lambda r: M.psi_by_year(
        _event_scores(r),
        r.cfg.with_(dev_weeks=2),
    ),
    "events_auc": lambda r: M.auc(
        r.table("events").select(F.to_date("ts").alias("date"), F.col("value").alias("score"), (F.col("event_type") == "purchase").cast("int").alias("y")), "date"
    ),
    "events_ks": lambda r: M.ks(
        r.table("events").select(F.to_date("ts").alias("date"), F.col("value").alias("score"), (F.col("event_type") == "purchase").cast("int").alias("y")), "date"
    ),
}


def _window_mean(k: int):
    """The mean of one feature over a window."""
    return F.aggregate("window", F.lit(0.0), lambda acc, x: acc + x[k]) / F.size("window")


def _event_scores(r: Review) -> DataFrame:
    """Events as scores of one model, with week numbers counted on the distinct weeks."""
    from pyspark.sql import Window

    rows = r.table("events").select(F.lit("events").alias("model"), F.to_date("ts").alias("date"), F.col("value").alias("score"), F.date_trunc("week", "ts").alias("wk"))
    weeks = rows.select("wk").distinct().select("wk", F.row_number().over(Window.orderBy("wk")).alias("week"))
    return rows.join(F.broadcast(weeks), "wk")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(name: str, q: Q):
        return lambda spark, sf_dir: rounded(q(review(spark, sf_dir)), EXACT.get(name, ()))

    return {name: bind(name, q) for name, q in QUERIES.items()}
