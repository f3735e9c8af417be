"""Drift, discrimination and portfolio monitoring.

Additive statistics (bucket counts) are summed week by week and then over windows. Rank statistics (AUC, KS) of one
metric fan each week out to the as-of weeks that look back on it; all of them together come from pieces of the
score axis, in which every row is met once by each window (window_ranks).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from datetime import date

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import ReviewConfig
from tidemark.functions.stats import mean_rank
from tidemark.operators.panel import calendar

FLOOR = 1e-4


def _term(actual: Column, expected: Column) -> Column:
    a, e = F.greatest(actual, F.lit(FLOOR)), F.greatest(expected, F.lit(FLOOR))
    return (a - e) * F.log(a / e)


def scored(panel: DataFrame, signals: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """Tradable scored rows with returns, weekly median labels, and week numbers of the model's own dates."""
    rows = panel.filter(F.col("tradable") & (F.col("date") <= F.lit(cfg.end).cast("date"))).join(signals.filter("score is not null"), ["date", "ticker"])
    w = Window.partitionBy("model", "date")
    y = lambda c: (F.col(c) > F.median(c).over(w)).cast("int")
    rows = rows.select(
        "model", "date", "ticker", "score", F.col("ret_fwd_1w_lag1").alias("r1"), F.col("ret_fwd_13w").alias("r13"),
        y("ret_fwd_1w_lag1").alias("y1"), y("ret_fwd_13w").alias("y13"),
    )
    return rows.join(weeks(rows), ["model", "date"])


def weeks(rows: DataFrame) -> DataFrame:
    """(model, date, week): numbers of the dates of each model, counted on distinct dates: one row a week."""
    days = rows.select("model", "date").distinct()
    return days.withColumn("week", F.row_number().over(Window.partitionBy("model").orderBy("date")))


def psi_by_year(rows: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """(model, year, psi): yearly score shares against the development weeks. An edge's own value is in the lower bucket."""
    probs = [k / cfg.psi_buckets for k in range(1, cfg.psi_buckets)]
    edges = rows.filter(F.col("week") <= cfg.dev_weeks).groupBy("model").agg(F.percentile("score", F.array(*map(F.lit, probs))).alias("edges"))
    placed = rows.join(edges, "model").select(  # one row a model
        "model", F.year("date").cast("long").alias("year"), (F.col("week") <= cfg.dev_weeks).alias("dev"),
        F.size(F.filter("edges", lambda e: F.col("score") > e)).alias("bucket"),
    )
    n = placed.groupBy("model", "year", "dev", "bucket").agg(F.count("*").alias("n"))  # small from here on
    dev = n.filter("dev").groupBy("model", "bucket").agg(F.sum("n").alias("n"))
    exp = dev.select("model", "bucket", (F.col("n") / F.sum("n").over(Window.partitionBy("model"))).alias("e"))
    act = n.groupBy("model", "year", "bucket").agg(F.sum("n").alias("n"))
    act = act.select("model", "year", "bucket", (F.col("n") / F.sum("n").over(Window.partitionBy("model", "year"))).alias("a"))
    grid = act.select("model", "year").distinct().join(exp, "model")
    out = grid.join(act, ["model", "year", "bucket"], "left")
    return out.groupBy("model", "year").agg(F.sum(_term(F.coalesce("a", F.lit(0.0)), F.col("e"))).alias("psi"))


def psi_rolling(values: DataFrame, wk: DataFrame, cfg: ReviewConfig, metric: str = "psi_score") -> DataFrame:
    """(model, date, metric, value): PSI of each week's trailing window against the development weeks.

    values: (model, week, x). Deciles of the development values without repeats, open at both ends, an
    edge's own value in the upper bucket. Weekly counts are summed over weeks n-53 .. n-2.
    """
    b = cfg.psi_buckets
    probs = F.array(*(F.lit(k / b) for k in range(b + 1)))
    edges = values.filter(F.col("week") <= cfg.dev_weeks).groupBy("model").agg(F.array_distinct(F.percentile("x", probs)).alias("es"))
    edges = edges.select("model", F.slice("es", 2, F.greatest(F.size("es") - 2, F.lit(0))).alias("es"))
    above = sum((F.coalesce((F.col("x") >= F.get("es", F.lit(k))).cast("int"), F.lit(0)) for k in range(b - 1)), F.lit(0))
    placed = values.join(F.broadcast(edges), "model").select("model", "week", above.alias("k"))  # one row a model
    hit = [F.sum((F.col("k") == k).cast("int")).alias(f"n{k}") for k in range(b)]
    return psi_of_counts(placed.groupBy("model", "week").agg(*hit), wk, cfg, metric)


def psi_of_counts(weekly: DataFrame, wk: DataFrame, cfg: ReviewConfig, metric: str) -> DataFrame:
    """psi_rolling of (model, week, n0, n1, ...): counts of the buckets, one row a week."""
    b = cfg.psi_buckets
    base = weekly.filter(F.col("week") <= cfg.dev_weeks).groupBy("model").agg(*(F.sum(f"n{k}").alias(f"e{k}") for k in range(b)))
    all_weeks = wk.join(weekly, ["model", "week"], "left").na.fill(0, [f"n{k}" for k in range(b)])
    w = Window.partitionBy("model").orderBy("week").rangeBetween(-cfg.monitor_window - 1, -cfg.monitor_lag)
    sums = all_weeks.select("model", "date", "week", *(F.sum(f"n{k}").over(w).alias(f"n{k}") for k in range(b))).join(base, "model")
    total, whole = (sum((F.col(f"{c}{k}") for k in range(1, b)), F.col(f"{c}0")) for c in "ne")
    psi = sum((_term(F.col(f"n{k}") / total, F.col(f"e{k}") / whole) for k in range(1, b)), _term(F.col("n0") / total, F.col("e0") / whole))
    late = sums.filter(F.col("week") > max(cfg.monitor_window + 1, cfg.dev_weeks))
    return late.select("model", "date", F.lit(metric).alias("metric"), F.when((total > 0) & (whole > 0), psi).alias("value"))


def psi_score(rows: DataFrame, cfg: ReviewConfig, wk: DataFrame | None = None) -> DataFrame:
    return psi_rolling(rows.select("model", "week", F.col("score").alias("x")), weeks(rows) if wk is None else wk, cfg)


def psi_input(rows: DataFrame, vol: DataFrame, cfg: ReviewConfig, wk: DataFrame | None = None) -> DataFrame:
    """PSI of realised volatility over all tradable names on the model's weeks."""
    wk = weeks(rows) if wk is None else wk
    values = vol.filter("vol252 is not null").join(F.broadcast(wk), "date").select("model", "week", F.col("vol252").alias("x"))
    return psi_rolling(values, wk, cfg, "psi_input")


def auc(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, auc) of score and y (0 or 1) by the average-rank identity; null where a class is empty."""
    ranked = rows.withColumn("rk", mean_rank("score", *keys))
    pos, neg = F.sum("y"), F.sum(1 - F.col("y"))
    up = F.sum(F.when(F.col("y") == 1, F.col("rk"))) - pos * (pos + 1) / F.lit(2.0)
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.when((pos > 0) & (neg > 0), up / (pos * neg)).alias("auc"))


def ks(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, ks): the largest distance of the classes' right-continuous distribution functions."""
    own = Window.partitionBy(*keys)
    upto = own.orderBy("score").rangeBetween(Window.unboundedPreceding, 0)
    y, n = F.col("y"), 1 - F.col("y")
    gap = F.abs(F.try_divide(F.sum(y).over(upto), F.sum(y).over(own)) - F.try_divide(F.sum(n).over(upto), F.sum(n).over(own)))
    return rows.select(*keys, gap.alias("gap")).groupBy(*keys).agg(F.max("gap").alias("ks"))


def auc_and_ks(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, auc, ks, slope): both distances and the slope of r on the score, from one pass over (keys, score, r, y)."""
    own = Window.partitionBy(*keys)
    upto = own.orderBy("score").rangeBetween(Window.unboundedPreceding, 0)
    y, n = F.col("y"), 1 - F.col("y")
    gap = F.abs(F.try_divide(F.sum(y).over(upto), F.sum(y).over(own)) - F.try_divide(F.sum(n).over(upto), F.sum(n).over(own)))
    ranked = rows.select(*keys, "score", "r", "y", mean_rank("score", *keys).alias("rk"), gap.alias("gap"))
    pos, neg = F.sum("y"), F.sum(1 - F.col("y"))
    up = F.sum(F.when(F.col("y") == 1, F.col("rk"))) - pos * (pos + 1) / F.lit(2.0)
    slope = F.when(F.stddev_pop("score") > 0, F.regr_slope("r", "score"))
    return ranked.groupBy(*keys).agg(F.when((pos > 0) & (neg > 0), up / (pos * neg)).alias("auc"), F.max("gap").alias("ks"), slope.alias("slope"))


def auc_by_year(rows: DataFrame) -> DataFrame:
    """(model, year, n, auc) of next week's direction; labels from rows with a return."""
    known = rows.filter("r1 is not null")
    out = auc(known.select("model", F.year("date").cast("long").alias("year"), "score", F.col("y1").alias("y")), "model", "year")
    return out


def lookback(rows: DataFrame | None, cfg: ReviewConfig, wk: DataFrame | None = None) -> DataFrame:
    """(model, asof, week): the 52 weeks n-53 .. n-2 that as-of week n looks back on."""
    wk = weeks(rows) if wk is None else wk
    late = wk.filter(F.col("week") > max(cfg.monitor_window + 1, cfg.dev_weeks))
    back = F.explode(F.sequence(F.col("week") - cfg.monitor_window - 1, F.col("week") - cfg.monitor_lag))
    return late.select("model", F.col("date").alias("asof"), back.alias("week"))


def matured(rows: DataFrame | None, prices: DataFrame | None, cfg: ReviewConfig, wk: DataFrame | None = None, cal: DataFrame | None = None) -> DataFrame:
    """(model, asof, week): the last 52 earlier weeks whose 65-session target had matured by the as-of date."""
    wk = weeks(rows) if wk is None else wk
    ends = wk.join((calendar(prices, cfg) if cal is None else cal).select("date", "day65"), "date").filter("day65 is not null").select("model", "week", F.col("day65").alias("ripe"))
    late = wk.filter(F.col("week") > max(cfg.monitor_window + 1, cfg.dev_weeks)).select("model", F.col("date").alias("asof"), F.col("week").alias("n"))
    # Weeks ripen in order, so the newest ripe week of each as-of week bounds the window: one row a week each.
    pairs = late.join(ends, "model").filter((F.col("week") < F.col("n")) & (F.col("ripe") <= F.col("asof")))
    last = pairs.groupBy("model", "asof").agg(F.max("week").alias("newest"))
    back = F.explode(F.sequence(F.greatest(F.col("newest") - cfg.monitor_window + 1, F.lit(1)), F.col("newest")))
    return last.select("model", "asof", back.alias("week"))


def windowed(rows: DataFrame, pairs: DataFrame, ret: str, y: str) -> DataFrame:
    """(model, date, score, r, y): rows of each as-of week's window that have the return."""
    known = rows.filter(F.col(ret).isNotNull()).select("model", "week", "score", F.col(ret).alias("r"), F.col(y).alias("y"))
    return known.join(pairs, ["model", "week"]).select("model", F.col("asof").alias("date"), "score", "r", "y")


def auc_rolling(win: DataFrame, suffix: str) -> DataFrame:
    return auc(win, "model", "date").select("model", "date", F.lit(f"auc_{suffix}").alias("metric"), F.col("auc").alias("value"))


def ks_rolling(win: DataFrame, suffix: str) -> DataFrame:
    return ks(win, "model", "date").select("model", "date", F.lit(f"ks_{suffix}").alias("metric"), F.col("ks").alias("value"))


def association_slope(win: DataFrame) -> DataFrame:
    """Descriptive slope of the 13-week return on the score."""
    slope = F.when(F.stddev_pop("score") > 0, F.regr_slope("r", "score"))
    return win.groupBy("model", "date").agg(slope.alias("value")).select("model", "date", F.lit("association_slope_13w").alias("metric"), "value")


#: Rows of scores in a piece of the score axis, about.
PIECE = 250_000
KINDS = ("1", "13")


def weekly_sums(rows: DataFrame) -> DataFrame:
    """(model, week, p1, n1, p13, n13, slope sums): counts of both labels and moments of score and 13-week return; one row a week."""
    label = lambda c, v: F.sum((F.col(c) == v).cast("long")).alias(f"{'np'[v]}{c[1:]}")
    ripe = F.when(F.col("r13").isNotNull(), F.col("score"))
    known = lambda k: F.when(F.col(f"r{k}").isNotNull(), F.col(f"y{k}")).alias(f"y{k}")
    return rows.select("model", "week", "score", "r13", ripe.alias("s"), *map(known, KINDS)).groupBy("model", "week").agg(
        *(label(f"y{k}", v) for k in KINDS for v in (1, 0)),
        F.count("s").alias("n"), F.avg("s").alias("ms"), F.avg("r13").alias("mr"), F.var_pop("s").alias("vs"), F.covar_pop("s", "r13").alias("c"), F.min("s").alias("lo"), F.max("s").alias("hi"),
        F.count("*").alias("rows"),
    )


def _slope(w: pd.DataFrame) -> float | None:
    """The slope of the returns on the scores of some weeks, from their sums; none where scores do not differ."""
    w = w[w["n"] > 0]
    if not len(w) or not w["hi"].max() > w["lo"].min():
        return None
    n, ms, mr = (w[c].to_numpy(float) for c in ("n", "ms", "mr"))
    ds, dr = ms - np.average(ms, weights=n), mr - np.average(mr, weights=n)
    return float((n * (w["c"] + ds * dr)).sum() / (n * (w["vs"] + ds * ds)).sum())


def _pieces(edges: dict[str, np.ndarray], names: list[str]):
    """Rows to (id, score, code, n): the piece of the axis and what the row counts as; equal ones of a batch are one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            model, score = b.column("model").to_pandas(), b.column("score").to_numpy(zero_copy_only=False)
            code = b.column("week").to_numpy(zero_copy_only=False).astype("int64")
            for k in KINDS:
                code = code * 3 + np.nan_to_num(b.column(f"y{k}").to_numpy(zero_copy_only=False).astype(float) + 1.0).astype("int64")
            which = np.zeros(len(score), "int64")
            for m, name in enumerate(names):
                own = (model == name).to_numpy()
                which[own] = np.searchsorted(edges[name], score[own], "left") * len(names) + m
            order = np.lexsort((code, score, which))
            which, score, code = which[order], score[order], code[order]
            first = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (score[1:] != score[:-1]) | (code[1:] != code[:-1]))) if len(score) else np.zeros(0, "int64")
            n = np.diff(np.append(first, len(score)))
            yield pa.RecordBatch.from_arrays([pa.array(which[first].astype("int32")), pa.array(score[first]), pa.array(code[first].astype("int32")), pa.array(n.astype("int32"))], ["id", "score", "code", "n"])

    return cut


def together(score: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of score and code, equal ones as one with the sum of their counts."""
    order = np.lexsort((code, score))
    score, code, n = score[order], code[order], n[order]
    first = np.flatnonzero(np.append(True, (score[1:] != score[:-1]) | (code[1:] != code[:-1]))) if len(score) else np.zeros(0, "int64")
    return score[first], code[first], np.add.reduceat(n, first) if len(first) else n


RANKED = "id int, span int, p long, q long, u double, low double, high double"


def ranked_piece(here: int, score: np.ndarray, code: np.ndarray, n: np.ndarray, spans: list[tuple[int, int, int, int, float, float]]) -> pd.DataFrame:
    """One piece to (id, span, p, q, u, low, high): both labels' counts in each span of weeks, pairs of the piece in order (ties half),
    and the least and largest difference of the labels' distribution functions from their value at the piece's start. Rows as together gives them."""
    found = []
    week, label = code // 9, {1: code % 9 // 3, 13: code % 3}
    tie = np.cumsum(np.append(0, score[1:] != score[:-1]))
    parts = {k: (y > 0) for k, y in label.items()}
    parts = {k: (week[on], tie[on], np.where(label[k][on] == 2, n[on], 0), np.where(label[k][on] == 1, n[on], 0)) for k, on in parts.items()}
    for span, kind, lo, hi, p_all, q_all in spans:
        week_k, tie_k, pos, neg = parts[kind]
        at = np.flatnonzero((week_k >= lo) & (week_k <= hi))
        if not len(at):
            continue
        t = tie_k[at]
        last = np.flatnonzero(np.append(t[1:] != t[:-1], True))
        p, q = np.cumsum(pos[at])[last], np.cumsum(neg[at])[last]
        gap = p / p_all - q / q_all
        u = (np.diff(p, prepend=0) * (q - np.diff(q, prepend=0) / 2.0)).sum()
        found.append((here, span, int(p[-1]), int(q[-1]), float(u), float(gap.min()), float(gap.max())))
    return pd.DataFrame(found, columns=["id", "span", "p", "q", "u", "low", "high"])


def _ranked(spans: dict[int, list[tuple[int, int, int, int, float, float]]], models: int):
    def ranked(rows: pd.DataFrame) -> pd.DataFrame:
        here = int(rows["id"].iloc[0])
        return ranked_piece(here, *together(rows["score"].to_numpy(), rows["code"].to_numpy("int64"), rows["n"].to_numpy("int64")), spans[here % models])

    return ranked


def spans_by_model(spans: list[tuple], sums: pd.DataFrame, names: list[str]) -> dict[int, list]:
    """(span, kind, first week, last week, both labels' counts) of the spans that have both labels, by the model's place in names."""
    plan: dict[int, list] = {k: [] for k in range(len(names))}
    for span, model, kind, lo, hi in spans:
        own = sums[(sums["model"] == model) & sums["week"].between(lo, hi)]
        p, q = float(own[f"p{kind}"].sum()), float(own[f"n{kind}"].sum())
        if p and q:
            plan[names.index(model)].append((span, int(kind), lo, hi, p, q))
    return plan


def joined(found: DataFrame, plan: dict[int, list]) -> DataFrame:
    """(span, auc, ks) from what ranked_piece says of each piece."""
    whole = found.sparkSession.createDataFrame([(x[0], x[4], x[5]) for v in plan.values() for x in v], "span int, ps double, qs double")
    before = Window.partitionBy("span").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    p0, q0 = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in "pq")
    steps = found.join(F.broadcast(whole), "span").select("span", "ps", "qs", "p", "low", "high", (F.col("u") + F.col("p") * q0).alias("u"), (p0 / F.col("ps") - q0 / F.col("qs")).alias("at"))
    far = F.greatest(F.abs(F.col("at") + F.col("low")), F.abs(F.col("at") + F.col("high")))
    return steps.groupBy("span").agg((F.sum("u") / F.first(F.col("ps") * F.col("qs"))).alias("auc"), F.max(far).alias("ks"))


def window_ranks(rows: DataFrame, spans: list[tuple], sums: pd.DataFrame) -> DataFrame:
    """(span, auc, ks) of (span, model, kind, first week, last week), as auc_and_ks gives them for the weeks' rows with the return.

    rows: as scored gives them; sums: weekly_sums. Scores are cut into pieces of the axis, each row moves once and is met in its piece
    by each span that has its week. A piece says how it changes both distribution functions; one short pass joins the pieces.
    """
    names = sorted(sums["model"].unique())
    size = {m: int(sums.loc[sums["model"] == m, "rows"].sum()) for m in names}
    cuts = {m: max(size[m] // PIECE, 7) for m in names}
    probs = [F.percentile_approx(F.when(F.col("model") == m, F.col("score")), [(i + 1) / (c + 1) for i in range(c)], 10 * c).alias(str(k)) for k, (m, c) in enumerate(cuts.items())]
    edges = {m: np.unique(np.array(e if e is not None else [], float)) for m, e in zip(names, rows.agg(*probs).first(), strict=True)}
    plan = spans_by_model(spans, sums, names)
    known = rows.select("model", "week", "score", *(F.when(F.col(f"r{k}").isNotNull(), F.col(f"y{k}")).alias(f"y{k}") for k in KINDS))
    cells = known.mapInArrow(_pieces(edges, names), "id int, score double, code int, n int")
    return joined(cells.groupBy("id").applyInPandas(_ranked(plan, len(names)), RANKED), plan)


def rolling_metrics(rows: DataFrame, prices: DataFrame | None, vol: DataFrame, cfg: ReviewConfig, cal: DataFrame | None = None) -> DataFrame:
    """(date, model, metric, value) of all cross-sectional metrics; missing values have no row. The driver holds rows of weeks."""
    spark = rows.sparkSession
    wk = spark.createDataFrame([tuple(r) for r in weeks(rows).collect()], "model string, date date, week int")
    psi = psi_score(rows, cfg, wk).unionByName(psi_input(rows, vol, cfg, wk))
    return with_ranks(spark, wk, weekly_sums(rows).toPandas(), psi, lambda spans, sums: window_ranks(rows, spans, sums), cfg, prices, cal)


def with_ranks(
    spark: SparkSession, wk: DataFrame, sums: pd.DataFrame, psi: DataFrame, ranks: Callable[[list[tuple], pd.DataFrame], DataFrame], cfg: ReviewConfig,
    prices: DataFrame | None, cal: DataFrame | None,
) -> DataFrame:
    """psi, and from sums by week (as weekly_sums has them) slopes and what ranks(spans, sums) finds as window_ranks does."""
    spans: list[tuple[int, str, str, int, int]] = []
    asof: list[tuple[int, date, str, str]] = []
    slopes = []
    for kind, pairs in (("1", lookback(None, cfg, wk)), ("13", matured(None, prices, cfg, wk, cal))):
        for r in pairs.groupBy("model", "asof").agg(F.min("week").alias("lo"), F.max("week").alias("hi")).collect():
            asof.append((len(spans), r["asof"], r["model"], f"{kind}w"))
            if kind == "13":
                own = sums[(sums["model"] == r["model"]) & sums["week"].between(r["lo"], r["hi"])]
                slopes.append((r["asof"], r["model"], "association_slope_13w", _slope(own)))
            spans.append((len(spans), r["model"], kind, r["lo"], r["hi"]))
    out = psi.unionByName(spark.createDataFrame(slopes, "date date, model string, metric string, value double"))
    if len(sums):
        of = F.broadcast(spark.createDataFrame(asof, "span int, date date, model string, kind string"))
        found = ranks(spans, sums).join(of, "span")
        both = F.explode(F.array(*(F.struct(F.concat(F.lit(f"{m}_"), "kind").alias("metric"), F.col(m).alias("value")) for m in ("auc", "ks"))))
        out = out.unionByName(found.select("model", "date", both.alias("x")).select("model", "date", "x.*"))
    return out.filter("value is not null").select("date", "model", "metric", "value")


def portfolio_metrics(returns: DataFrame, cfg: ReviewConfig, bench: str = "universe_ew") -> DataFrame:
    """(date, model, metric, value): rolling active Sharpe, drawdown, drawdown relative to the benchmark."""
    b = returns.filter(F.col("strategy") == bench).select("date", F.col("ret_net").alias("b"))
    rows = returns.join(b, "date").select(F.col("strategy").alias("model"), "date", "ret_net", "b", (F.col("ret_net") - F.col("b")).alias("a"))
    own = Window.partitionBy("model").orderBy("date")
    w, upto = own.rowsBetween(1 - cfg.monitor_window, 0), own.rowsBetween(Window.unboundedPreceding, 0)
    sd = F.stddev_samp("a").over(w)
    rs = F.when((F.count("a").over(w) == cfg.monitor_window) & (sd > 0), F.avg("a").over(w) / sd * math.sqrt(cfg.weeks_per_year))
    rows = rows.select("model", "date", rs.alias("rolling_sharpe"), F.sum(F.log1p("ret_net")).over(upto).alias("le"), F.sum(F.log1p("ret_net") - F.log1p("b")).over(upto).alias("lr"))
    fall = lambda c: F.exp(F.col(c) - F.greatest(F.max(c).over(upto), F.lit(0.0))) - 1.0
    rows = rows.select("model", "date", "rolling_sharpe", fall("le").alias("drawdown"), fall("lr").alias("active_drawdown"))
    return melt(rows, ["rolling_sharpe", "drawdown", "active_drawdown"])


def melt(wide: DataFrame, metrics: list[str]) -> DataFrame:
    return wide.unpivot(["date", "model"], metrics, "metric", "value").filter("value is not null")


def latest(monitoring: DataFrame) -> DataFrame:
    """The last row of each model and metric."""
    out = monitoring.groupBy("model", "metric").agg(F.max("date").alias("date"), F.max_by("value", "date").alias("value"))
    return out.select("date", "model", "metric", "value")
