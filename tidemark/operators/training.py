"""Inputs of window models: weekly bars, scaled and clipped features, and the training set.

A ticker's history is one row while its windows are cut, as it has one entry a session or week; windows leave as rows
of their own. Weeks run from Saturday to Friday and are named by their Saturday.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import ReviewConfig
from tidemark.functions.stats import mean_rank
from tidemark.operators.calibration import OHLCV, purged_split
from tidemark.operators.panel import available


def week_of(date: Column) -> Column:
    """The Saturday that opens a date's week."""
    return F.date_sub(F.date_trunc("week", F.date_add(date, 2)).cast("date"), 2)


def _complete(f: Column) -> Column:
    return F.forall(f, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def adjusted(prices: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """Quotes with positive closes, the four prices scaled by adj_close / close."""
    rows = available(prices, cfg).filter((F.col("close") > 0) & (F.col("adj_close") > 0))
    factor = F.col("adj_close") / F.col("close")
    return rows.select("date", "ticker", *((F.col(c) * factor).alias(c) for c in OHLCV[:4]), "volume")


def weekly_bars(prices: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """(week, ticker, open, high, low, close, volume, last_date): first open, extremes, last close and summed volume of a week."""
    rows = adjusted(prices, cfg).withColumn("week", week_of(F.col("date")))
    return rows.groupBy("week", "ticker").agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"),
        F.sum("volume").alias("volume"), F.max("date").alias("last_date"),
    )


def bar_features(bars: DataFrame, date: str, t: Column) -> DataFrame:
    """(date, t, ticker, f): log changes of the prices and of log1p volume to the ticker's bar at t - 1, null without one."""
    from pyspark.sql import Window

    logs = [F.when(F.col(c) > 0, F.log(c)).alias(c) for c in OHLCV[:4]] + [F.log1p("volume").alias("volume")]
    rows = bars.select(F.col(date).alias("date"), t.cast("int").alias("t"), "ticker", *logs)
    before = Window.partitionBy("ticker").orderBy("t").rangeBetween(-1, -1)
    return rows.select("date", "t", "ticker", F.array(*(F.col(c) - F.max(c).over(before) for c in OHLCV)).alias("f"))


def weekly_features(prices: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """(date, t, ticker, f) of weekly bars: date is the week's Saturday, t numbers the weeks."""
    return bar_features(weekly_bars(prices, cfg), "week", F.datediff("week", F.lit("1970-01-03").cast("date")) / 7)


def scaler(features: DataFrame, before: str | None = None) -> DataFrame:
    """(mean, sd): arrays of each feature's mean and population deviation over complete rows, dated before a day if given."""
    rows = features.filter(_complete(F.col("f")))
    if before:
        rows = rows.filter(F.col("date") < F.lit(before).cast("date"))
    col = lambda k: F.col("f")[k]
    return rows.agg(F.array(*(F.avg(col(k)) for k in range(len(OHLCV)))).alias("mean"), F.array(*(F.stddev_pop(col(k)) for k in range(len(OHLCV)))).alias("sd"))


def scaled(features: DataFrame, fitted: DataFrame, clip: float = 3.0) -> DataFrame:
    """features scaled by the one row of fitted and then clipped; a feature that does not vary is only centred."""
    zip_ = F.zip_with(F.arrays_zip("mean", "sd"), "f", lambda m, x: (x - m["mean"]) / F.when(m["sd"] > 0, m["sd"]).otherwise(1.0))
    cut = F.transform(zip_, lambda z: F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))
    whole = F.when(_complete(F.col("f")), cut).otherwise(F.transform("f", lambda x: F.lit(None).cast("double")))
    return features.crossJoin(F.broadcast(fitted)).withColumn("f", whole).drop("mean", "sd")  # one row


def tradable_windows(features: DataFrame, panel: DataFrame, length: int, weekly: bool = False) -> DataFrame:
    """(date, ticker, window): complete windows of `length` bars up to a panel date, of names tradable on that date.

    The last bar is that of the date itself, or of its week.
    """
    from tidemark.operators.calibration import feature_windows

    at = week_of(F.col("date")) if weekly else F.col("date")
    asked = panel.filter("tradable").select("ticker", F.col("date").alias("day"), at.alias("date"))
    cut = feature_windows(features, asked.select("date").distinct(), length)
    return cut.join(asked, ["ticker", "date"]).select(F.col("day").alias("date"), "ticker", "window")


def training_set(prices: DataFrame, cfg: ReviewConfig, split: str, length: int = 252, horizon: int = 65, stride: int = 65, clip: float = 3.0, tickers: Sequence[str] | None = None) -> DataFrame:
    """(ticker, end, target_end, part, y, window): samples of a window model.

    Rows of a ticker are its own valid quotes in order. A window ends at every stride-th row from the length-th on that
    has `horizon` rows after it; windows with an incomplete row among inputs or target rows are left out. Features are
    scaled by complete rows before the split and clipped. The target, the summed log change of the close over the
    horizon, is replaced by its average rank among the windows that end on the same date, as a share less one half, and
    divided by its deviation over the training part. part: train if the target ends before the split, val if the window
    ends on or after it, else purged.
    """
    from pyspark.sql import Window

    quotes = adjusted(prices, cfg)
    if tickers is not None:
        quotes = quotes.filter(F.col("ticker").isin(*tickers))
    t = F.row_number().over(Window.partitionBy("ticker").orderBy("date"))
    features = bar_features(quotes.withColumn("t", t), "date", F.col("t"))
    z = scaled(features, scaler(features, split), clip).select("ticker", "t", F.col("f").alias("z"))
    rows = features.join(z, ["ticker", "t"])
    own = F.array_sort(F.collect_list(F.struct("t", "date", F.col("f")[3].alias("c"), "z")))
    rows = rows.groupBy("ticker").agg(own.alias("h"))
    ends = F.sequence(F.lit(length), F.size("h") - horizon, F.lit(stride))
    ends = F.when(F.size("h") - horizon >= length, ends).otherwise(F.array().cast("array<int>"))
    cut = F.transform(
        ends,
        lambda e: F.struct(
            F.get("h", e - 1)["date"].alias("end"), F.get("h", e - 1 + horizon)["date"].alias("target_end"),
            F.transform(F.slice("h", e - length + 1, F.lit(length)), lambda x: x["z"]).alias("window"),
            F.transform(F.slice("h", e + 1, F.lit(horizon)), lambda x: F.struct(x["c"], x["z"])).alias("next"),
        ),
    )
    rows = rows.select("ticker", F.explode(cut).alias("w")).select("ticker", "w.*")
    rows = rows.filter(F.forall("window", _complete) & F.forall("next", lambda x: _complete(x["z"])))
    rows = rows.withColumn("ret", F.aggregate("next", F.lit(0.0), lambda acc, x: acc + x["c"]))
    rank = mean_rank("ret", "end") / F.count("*").over(Window.partitionBy("end")) - 0.5
    rows = purged_split(rows.withColumn("y", rank), split, closed=False)
    spread = rows.filter("part = 'train'").agg(F.stddev_pop("y").alias("sd"))
    return rows.crossJoin(F.broadcast(spread)).select("ticker", "end", "target_end", "part", (F.col("y") / F.col("sd")).alias("y"), "window")  # one row
