"""The whole review, stage by stage, into a warehouse; each stage reads what the ones before wrote.

    python -m tidemark.plans.revalidate WAREHOUSE [FIXTURE_DIR]

With a fixture folder the prices table is derived from its star schema first.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import FIXTURE, ReviewConfig
from tidemark.operators import backtest as B
from tidemark.operators import calibration as K
from tidemark.operators import candidates as C
from tidemark.operators import gate as G
from tidemark.operators import monitoring as M
from tidemark.operators import overfit as O
from tidemark.operators import panel as P
from tidemark.sources import fixtures
from tidemark.sources.warehouse import Warehouse, manifest, written

#: A candidate takes the price matrix, the rebalance dates, the session numbers and the parameters.
Candidate = Callable[[DataFrame, DataFrame, DataFrame, ReviewConfig], DataFrame]


def _gbm(matrix: DataFrame, dates: DataFrame, sess: DataFrame, cfg: ReviewConfig) -> DataFrame:
    mu_sigma = written(C.gbm_mu_sigma(matrix, dates, sess, cfg))
    return C.gbm_path(mu_sigma, cfg).unionByName(C.gbm_expected(mu_sigma, cfg))


CANDIDATES: dict[str, Candidate] = {"momentum": C.momentum, "gbm": _gbm, "gbm_weekly": C.gbm_weekly_variants}


def build_panel(w: Warehouse, cfg: ReviewConfig) -> None:
    w.replace("panel", P.build_panel(w.read("prices"), cfg))


def score(w: Warehouse, cfg: ReviewConfig, candidates: dict[str, Candidate] = CANDIDATES) -> None:
    """Scores of every candidate replace those that its models had."""
    prices, dates = w.read("prices"), P.rebalance_dates(w.read("panel"))
    matrix, sess = P.price_matrix(prices, cfg), P.sessions(prices, cfg)
    for candidate in candidates.values():
        w.replace_parts("signals", written(candidate(matrix, dates, sess, cfg)))


def develop(w: Warehouse, cfg: ReviewConfig, alias: str = "gbm_weekly", prefix: str = "gbm_w_") -> str | None:
    """Choose a variant by its active Sharpe ratio before the out-of-time window and store it under the alias."""
    signals, panel = w.read("signals").filter(F.col("model").startswith(prefix)), w.read("panel")
    first = B.select_variant(panel, signals, B.benchmarks(panel, cfg), cfg).filter("chosen").first()  # one row
    if first is not None:
        w.replace_parts("signals", C.as_model(signals, first.model, alias))
    return first.model if first else None


def backtest(w: Warehouse, cfg: ReviewConfig) -> None:
    panel, signals = w.read("panel"), w.read("signals")
    for rows in (B.benchmarks(panel, cfg), B.run_models(panel, signals, cfg), B.same_close(panel, signals, cfg)):
        w.replace_parts("portfolio_returns", written(rows.filter("ret_net is not null")))


def test(w: Warehouse, cfg: ReviewConfig, models: list[str], trials: list[str]) -> None:
    signals = w.read("signals").filter(F.col("model").isin(*models))
    found = O.run_all(w.spark, w.read("panel"), signals, w.read("portfolio_returns"), trials, cfg, cfg.n_trials)
    w.upsert("validation_results", found.withColumn("run_at", F.current_timestamp()))


def monitor(w: Warehouse, cfg: ReviewConfig, models: list[str]) -> None:
    prices, panel, returns = w.read("prices"), w.read("panel"), w.read("portfolio_returns")
    vol = written(P.realised_vol(prices, panel, cfg))
    rows = written(M.scored(panel, w.read("signals").filter(F.col("model").isin(*models)), cfg))
    own = M.portfolio_metrics(returns.filter(F.col("strategy").isin("universe_ew", *models)), cfg).filter(F.col("model").isin(*models))
    w.replace_parts("monitoring", written(M.rolling_metrics(rows, prices, vol, cfg).unionByName(own)))


def gate(w: Warehouse, cfg: ReviewConfig, models: list[str]) -> None:
    decided = written(G.decide(G.metrics_wide(w.read("monitoring").filter(F.col("model").isin(*models)), cfg), cfg.rules))
    w.replace_parts("gate_decisions", decided)
    signals = w.read("signals").filter(F.col("model").isin(*models))
    w.replace_parts("portfolio_returns", written(G.challenger_returns(w.read("panel"), signals, decided, cfg)))


def report(w: Warehouse, cfg: ReviewConfig) -> dict[str, DataFrame]:
    """The report's tables, each a few rows."""
    returns, decided = w.read("portfolio_returns"), w.read("gate_decisions")
    oot = returns.filter(F.col("date") >= F.lit(cfg.oot_start).cast("date"))
    pairs = K.calibration_pairs(w.read("prices"), w.read("panel"), w.read("signals"), cfg)
    return {
        "performance": B.summary(oot),
        "champion_challenger": B.champion_challenger(returns, cfg.oot_start),
        "tests": w.read("validation_results").drop("run_at"),
        "gate": G.off_share(decided, returns, cfg.oot_start),
        "gate_reasons": G.reasons(decided),
        "monitoring": M.latest(w.read("monitoring")),
        "calibration": K.matched_calibration(pairs),
        "coverage": P.coverage(w.read("panel")),
        "signals": C.inventory(w.read("signals")),
    }


def markdown(df: DataFrame, digits: int = 4) -> str:
    """A small table as Markdown, in the order of its first column."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    rows = df.orderBy(df.columns[0]).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows])


def revalidate(w: Warehouse, cfg: ReviewConfig, models: tuple[str, ...] = ("momentum", "gbm", "gbm_expected"), trials: list[str] | None = None) -> dict[str, DataFrame]:
    """All stages from the prices table on; returns the report's tables."""
    names = list(models)
    build_panel(w, cfg)
    score(w, cfg)
    develop(w, cfg)
    backtest(w, cfg)
    if trials is None:
        trials = sorted(r[0] for r in w.read("signals").select("model").distinct().collect())  # one name a model
    test(w, cfg, names, trials)
    monitor(w, cfg, names)
    gate(w, cfg, names)
    return report(w, cfg)


def main(root: str, fixture: str | None = None) -> None:
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    w, cfg = Warehouse(spark, root), ReviewConfig()
    w.init_schema()
    if fixture:
        cfg = FIXTURE
        w.replace("prices", fixtures.prices(spark, fixture))
    for name, table in revalidate(w, cfg).items():
        print(f"\n## {name}\n\n{markdown(table)}")
    print(f"\n## files\n\n{markdown(manifest(spark, w._current('panel')))}")


if __name__ == "__main__":
    main(*sys.argv[1:3])
