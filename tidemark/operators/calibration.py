"""Matched calibration, direction accuracy, rank correlation, training targets and splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import ReviewConfig
from tidemark.functions.stats import finite, mean_rank
from tidemark.operators.panel import available, calendar

#: model -> (kind of target, horizon in sessions, field, description)
TARGETS = {
    "gbm": ("path", 63, "adj_close", "return of the average of this and the next 63 adjusted closes"),
    "gbm_expected": ("path", 63, "adj_close", "return of the average of this and the next 63 adjusted closes"),
    "gbm_weekly": ("point", 5, "adj_close", "return of the adjusted close over five sessions"),
    "window_high": ("point", 65, "high", "return of the unadjusted high over 65 sessions"),
}

#: What the pooled regression may be read as.
INTERPRETATION = "describes these pairs only: their windows overlap, so it is no test of significance"


def session_grid(prices: DataFrame, cfg: ReviewConfig, field: str) -> DataFrame:
    """(date, s, ticker, value): positive values on the benchmark's sessions, numbered."""
    cal = calendar(prices, cfg).select("date", F.row_number().over(Window.orderBy("date")).alias("s"))  # one row a day
    quotes = available(prices, cfg).filter(F.col(field) > 0).select("date", "ticker", F.col(field).alias("value"))
    return quotes.join(F.broadcast(cal), "date").select("date", "s", "ticker", "value")


def forward_target(grid: DataFrame, kind: str, horizon: int) -> DataFrame:
    """(date, ticker, actual): realised target; null if any of its quotes is missing."""
    own = Window.partitionBy("ticker").orderBy("s")
    if kind == "path":
        w = own.rangeBetween(0, horizon)
        ahead = F.when(F.count("value").over(w) == horizon + 1, F.avg("value").over(w))
    else:
        ahead = F.max("value").over(own.rangeBetween(horizon, horizon))
    return grid.select("date", "ticker", (ahead / F.col("value") - 1.0).alias("actual"))


def calibration_pairs(prices: DataFrame, panel: DataFrame, signals: DataFrame, cfg: ReviewConfig, targets: dict = TARGETS) -> DataFrame:
    """(model, horizon, score, actual) of tradable out-of-time rows whose target matured by the cutoff."""
    day = lambda s: F.lit(s).cast("date")
    rows = panel.filter("tradable").select("date", "ticker").join(signals, ["date", "ticker"])
    rows = rows.filter((F.col("date") >= day(cfg.oot_start)) & (F.col("date") <= day(cfg.end)))
    out = None
    for kind, horizon, field in dict.fromkeys(t[:3] for t in targets.values()):
        models = [m for m, t in targets.items() if t[:3] == (kind, horizon, field)]
        actual = forward_target(session_grid(prices, cfg, field), kind, horizon)
        w = Window.orderBy("date")  # one row a day
        mature = calendar(prices, cfg).select("date", F.lead("date", horizon).over(w).alias("ripe")).filter(F.col("ripe") <= day(cfg.end))
        met = rows.filter(F.col("model").isin(*models)).join(actual, ["date", "ticker"]).join(F.broadcast(mature), "date", "left_semi")
        part = met.select("model", F.lit(horizon).cast("long").alias("horizon"), finite(F.col("score")).alias("score"), finite(F.col("actual")).alias("actual"))
        out = part if out is None else out.unionByName(part)
    return out.filter("score is not null and actual is not null")


def matched_calibration(pairs: DataFrame, targets: dict = TARGETS) -> DataFrame:
    """Pooled regression of realised on predicted and mean absolute error of each model; descriptive only."""
    what = F.create_map(*(F.lit(x) for m, t in targets.items() for x in (m, t[3])))
    return pairs.groupBy("model", F.col("horizon").alias("horizon_sessions")).agg(
        F.count("*").alias("n"), F.regr_slope("actual", "score").alias("slope"), F.regr_intercept("actual", "score").alias("intercept"),
        F.avg(F.abs(F.col("actual") - F.col("score"))).alias("mae"),
    ).withColumns({"target": what[F.col("model")], "interpretation": F.lit(INTERPRETATION)})


def scaled_sign_accuracy(true: Column, predicted: Column, low: Column, high: Column) -> Column:
    """Legacy direction accuracy: signs after scaling [low, high] to [-1, 1]."""
    scale = lambda x: (x - low) / (high - low) * 2.0 - 1.0
    return F.avg((F.signum(scale(true)) == F.signum(scale(predicted))).cast("int"))


def sign_accuracy(true: Column, predicted: Column) -> Column:
    """Direction accuracy of the returns themselves."""
    return F.avg((F.signum(true) == F.signum(predicted)).cast("int"))


def direction_metric(pairs: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """(model, n, legacy, corrected) of (model, true, predicted); the scale is the range of the truth unless given."""
    if low is None or high is None:
        ends = pairs.groupBy("model").agg(F.min("true").alias("lo"), F.max("true").alias("hi"))
        pairs = pairs.join(ends, "model")
    else:
        pairs = pairs.withColumn("lo", F.lit(low)).withColumn("hi", F.lit(high))
    t, p = F.col("true"), F.col("predicted")
    return pairs.groupBy("model").agg(F.count("*").alias("n"), scaled_sign_accuracy(t, p, F.col("lo"), F.col("hi")).alias("legacy"), sign_accuracy(t, p).alias("corrected"))


def purged_split(rows: DataFrame, split: str, closed: bool = True) -> DataFrame:
    """rows with `part`: train if the target ended by the split, val if the sample ended after it, else purged.

    rows has `end` (last date of the inputs) and `target_end`. closed: the split day belongs to the training part.
    """
    day = F.lit(split).cast("date")
    early, late = (F.col("target_end") <= day, F.col("end") > day) if closed else (F.col("target_end") < day, F.col("end") >= day)
    return rows.withColumn("part", F.when(early, "train").when(late, "val").otherwise("purged"))


def rank_target(rows: DataFrame, value: str = "ret_fwd_1w") -> DataFrame:
    """rows with `rank_pct`: average rank over count of the value within its date; null where it is null."""
    known = rows.filter(F.col(value).isNotNull())
    pct = mean_rank(value, "date") / F.count("*").over(Window.partitionBy("date"))
    return known.withColumn("rank_pct", pct)


def finite_windows(rows: DataFrame, ok: str, length: int) -> DataFrame:
    """rows with `whole`: the last `length` sessions of the ticker all exist and are valid."""
    w = Window.partitionBy("ticker").orderBy("t").rangeBetween(1 - length, 0)
    return rows.withColumn("whole", F.sum(F.col(ok).cast("int")).over(w) == length)


def spearman_ic(rows: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """(keys, n, ic): rank correlation with average ranks of ties."""
    known = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = known.select(*keys, mean_rank(x, *keys).alias("rx"), mean_rank(y, *keys).alias("ry"))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("ic"))


def scaler(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and population deviation of each column: one row."""
    return rows.agg(*(f(c).alias(f"{c}_{n}") for c in cols for f, n in ((F.avg, "mean"), (F.stddev_pop, "sd"))))


# Window models -----------------------------------------------------------------------------------

OHLCV = ("open", "high", "low", "close", "volume")


def window_features(prices: DataFrame, sess: DataFrame, cfg: ReviewConfig, adjusted: bool = False) -> DataFrame:
    """(date, t, ticker, f): differences of log prices and of log1p volume to the session before.

    adjusted scales the four prices by adj_close / close first.
    """
    rows = available(prices, cfg).join(F.broadcast(sess), "date")  # sess: one row a day
    factor = F.col("adj_close") / F.col("close") if adjusted else F.lit(1.0)
    own = Window.partitionBy("ticker").orderBy("t").rangeBetween(-1, -1)
    cols = [F.when(F.col(c) > 0, F.log(F.col(c) * factor)).alias(c) for c in OHLCV[:4]] + [F.log1p("volume").alias("volume")]
    logs = rows.select("date", "t", "ticker", *cols)
    diffs = [(F.col(c) - F.max(c).over(own)) for c in OHLCV]
    return logs.select("date", "t", "ticker", F.array(*diffs).alias("f"))


def feature_windows(features: DataFrame, dates: DataFrame, length: int) -> DataFrame:
    """(date, ticker, window): the last `length` sessions' features as array<array<double>>, complete ones only.

    A ticker's history, one entry a session, is sorted once; only the windows that end on one of the dates are cut from it.
    """
    marked = features.join(F.broadcast(dates.select("date", F.lit(True).alias("on"))), "date", "left")  # one row a week
    own = F.array_sort(F.collect_list(F.struct("t", "date", "on", "f")))
    rows = marked.groupBy("ticker").agg(own.alias("h"))
    at = lambda i: F.get("h", i)
    ends = F.filter(F.sequence(F.lit(length - 1), F.size("h") - 1), lambda i: at(i)["on"] & (at(i)["t"] - at(i - (length - 1))["t"] == length - 1))
    ends = F.when(F.size("h") >= length, ends)
    cut = F.transform(ends, lambda i: F.struct(at(i)["date"].alias("date"), F.transform(F.slice("h", i - (length - 2), F.lit(length)), lambda x: x["f"]).alias("window")))
    out = rows.select("ticker", F.explode(cut).alias("w")).select("w.date", "ticker", "w.window")
    return out.filter(F.forall("window", lambda f: F.forall(f, lambda x: x.isNotNull())))


def mean_high_predictor(windows: np.ndarray) -> np.ndarray:
    """A stand-in for a trained model: 65 times the mean log change of the high in the window."""
    return 65.0 * windows[:, :, 1].mean(axis=1)


def window_scores(windows: DataFrame, model: str, predict: Callable[[np.ndarray], np.ndarray] = mean_high_predictor) -> DataFrame:
    """(date, ticker, model, score): exp(predicted log change) - 1, predicted in Arrow batches by any callable.

    predict maps (windows, bars, features) to one number a window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            flat = batch.column("window").flatten().flatten().to_numpy(zero_copy_only=False)
            score = np.exp(np.asarray(predict(flat.reshape(n, -1, len(OHLCV))), float)) - 1.0 if n else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("date"), batch.column("ticker"), pa.array([model] * n, pa.string()), pa.array(score)], names=["date", "ticker", "model", "score"])

    return windows.select("date", "ticker", "window").mapInArrow(run, "date date, ticker string, model string, score double")
