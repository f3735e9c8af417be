"""Rule-based on/off gate over lagged monitoring metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import ReviewConfig
from tidemark.operators.backtest import portfolio_returns, scored_panel, top_n_weights

PORTFOLIO = ("rolling_sharpe", "drawdown", "active_drawdown")
CROSS = ("psi_score", "psi_input", "auc_1w", "ks_1w", "auc_13w", "ks_13w", "association_slope_13w")


def metrics_wide(monitoring: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """One row for each model and date of any metric; portfolio metrics are those of two rows before.

    A fixed list of metrics is pivoted by one conditional aggregate.
    """
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m)
    wide = monitoring.groupBy("model", "date").agg(*map(pick, (*CROSS, *PORTFOLIO)))
    w = Window.partitionBy("model").orderBy("date")
    return wide.select("model", "date", *CROSS, *(F.lag(m, cfg.monitor_lag).over(w).alias(m) for m in PORTFOLIO))


def decide(wide: DataFrame, rules=ReviewConfig.rules) -> DataFrame:
    """(date, model, gate_on, reason): rules that trip, in order, then missing metrics; null if none."""
    tripped, missing = [], []
    for metric, op, limit in rules:
        value = F.col(metric) if metric in wide.columns else F.lit(None).cast("double")
        hit = value > limit if op == ">" else value < limit
        tripped.append(F.when(hit, metric))
        missing.append(F.when(value.isNull(), f"missing:{metric}"))
    reason = F.concat_ws(",", *tripped, *missing)
    return wide.select("date", "model", (reason == "").alias("gate_on"), F.nullif(reason, F.lit("")).alias("reason"))


def challenger_returns(panel: DataFrame, signals: DataFrame, gate: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """Returns of the gated strategies; weights are 0 while the gate is off or has no decision, and costs follow."""
    return gated_returns(top_n_weights(scored_panel(panel, signals, cfg), cfg.top_n), gate, cfg)


def gated_returns(weights: DataFrame, gate: DataFrame, cfg: ReviewConfig) -> DataFrame:
    on = gate.select(F.col("model").alias("strategy"), "date", "gate_on")
    gated = weights.join(on, ["strategy", "date"], "left")
    w = F.when(F.coalesce("gate_on", F.lit(False)), F.col("w")).otherwise(0.0)
    out = portfolio_returns(gated.withColumn("w", w).drop("gate_on"), cfg)
    return out.withColumn("strategy", F.concat("strategy", F.lit("_gated")))


def reasons(gate: DataFrame) -> DataFrame:
    return gate.filter(~F.col("gate_on")).groupBy("model", "reason").agg(F.count("*").alias("weeks"))


def off_share(gate: DataFrame, returns: DataFrame, start: str) -> DataFrame:
    """Share of completed out-of-time weeks with the gate off."""
    done = returns.filter(F.col("date") >= F.lit(start).cast("date")).select(F.col("strategy").alias("model"), "date")
    met = gate.join(done, ["model", "date"])
    return met.groupBy("model").agg(F.count("*").alias("weeks"), F.avg((~F.col("gate_on")).cast("int")).alias("off_share"))
