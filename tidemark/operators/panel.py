"""Universe, calendar and weekly panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import ReviewConfig
from tidemark.functions.stats import trailing


def clean_universe(listing: DataFrame, size: int, asof: str) -> DataFrame:
    """The `size` largest equities: positive market cap, plain tickers, one row for each name, ranked.

    Ties in market cap go to the smaller ticker.
    """
    rows = listing.filter((F.col("quote_type") == "EQUITY") & (F.col("market_cap") > 0) & ~F.col("ticker").rlike(r"[-^$]"))
    first = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(F.col("market_cap").desc(), "ticker"))
    for key in ("name", "ticker"):
        rows = rows.withColumn("rn", first(key)).filter("rn = 1").drop("rn")
    top = rows.orderBy(F.col("market_cap").desc(), "ticker").limit(size)
    # At most `size` rows are left: one partition ranks them.
    rank = F.row_number().over(Window.orderBy(F.col("market_cap").desc(), "ticker"))
    cols = ("ticker", "name", "exchange", "sector", "industry", "market_cap")
    return top.select(*cols, rank.alias("rank_by_mcap"), F.lit(asof).cast("date").alias("asof_date"))


def available(prices: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """What could be known at the cutoff; everything else starts from it."""
    return prices.filter(F.col("date") <= F.lit(cfg.end).cast("date"))


def calendar(prices: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """Sessions of the benchmark up to the cutoff with their next, 5th and 65th followers: one row a day."""
    w = Window.orderBy("date")  # days, not facts
    days = available(prices, cfg).filter(F.col("ticker") == cfg.benchmark).select("date")
    ahead = lambda k, name: F.lead("date", k).over(w).alias(name)
    return days.select("date", ahead(1, "next_session"), ahead(cfg.weekly_horizon, "day5"), ahead(cfg.mature_sessions, "day65"))


def schedule(cal: DataFrame) -> DataFrame:
    """The last session of each ISO week with entry, exit and horizon dates: one row a week."""
    last = cal.groupBy(F.date_trunc("week", "date").alias("wk")).agg(F.max_by(F.struct("date", "next_session", "day5", "day65"), "date").alias("s")).select("s.*")
    w = Window.orderBy("date")
    return last.select(
        "date", F.col("next_session").alias("entry_date"), "day5", "day65",
        F.lead("date").over(w).alias("next_date"), F.lead("next_session").over(w).alias("exit_date"),
    )


def build_panel(prices: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """One row for each week-end date and quoted ticker, with tradability and exact-session forward returns.

    The window of 20 counts a ticker's own valid rows. A forward return needs a positive quote on exactly
    its session. The weekly rows ask for up to four later quotes each; the asks meet the quotes in one
    join on (ticker, date), after which one aggregate brings each row's answers together.
    """
    quotes = available(prices, cfg)
    cal = calendar(prices, cfg)
    plan = F.broadcast(schedule(cal))  # one row a week
    valid = quotes.filter((F.col("close") > 0) & (F.col("adj_close") > 0))
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-19, 0)
    daily = valid.select(
        "date", "ticker", "close", "adj_close", F.avg(F.col("close") * F.col("volume")).over(w).alias("adv"), F.count("*").over(w).alias("n20")
    )
    weekly = daily.join(plan, "date").filter(F.col("date") >= F.lit(cfg.start).cast("date"))
    asks = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("at")) for k, c in (("n", "next_date"), ("e", "entry_date"), ("x", "exit_date"), ("h", "day65"))))
    asked = weekly.select("date", "ticker", F.explode(asks).alias("a")).select("date", "ticker", "a.kind", "a.at").filter("at is not null")
    known = quotes.filter(F.col("adj_close") > 0).select("ticker", F.col("date").alias("at"), F.col("adj_close").alias("p"))
    told = asked.join(known, ["ticker", "at"]).groupBy("ticker", "date")
    told = told.agg(*(F.max(F.when(F.col("kind") == k, F.col("p"))).alias(k) for k in "nexh"))
    tradable = (F.col("close") >= cfg.min_price) & (F.col("adv") >= cfg.min_adv) & (F.col("n20") == 20)
    return weekly.join(told, ["ticker", "date"], "left").select(
        "date", "ticker", "close", "adj_close", F.col("adv").alias("adv20_usd"), tradable.alias("tradable"),
        (F.col("n") / F.col("adj_close") - 1.0).alias("ret_fwd_1w"),
        (F.col("x") / F.col("e") - 1.0).alias("ret_fwd_1w_lag1"),
        (F.col("h") / F.col("adj_close") - 1.0).alias("ret_fwd_13w"),
    )


def rebalance_dates(panel: DataFrame) -> DataFrame:
    return panel.select("date").distinct()


def sessions(prices: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """(date, t): the global session number over all tickers' dates: one row a day."""
    days = available(prices, cfg).select("date").distinct()
    return days.select("date", F.row_number().over(Window.orderBy("date")).alias("t"))


def price_matrix(prices: DataFrame, cfg: ReviewConfig, field: str = "adj_close") -> DataFrame:
    """(date, t, ticker, value): the price matrix kept long; nonpositive values are missing."""
    if field not in ("open", "high", "low", "close", "adj_close", "volume"):
        raise ValueError(f"not a price field: {field}")
    quotes = available(prices, cfg).filter(F.col(field) > 0).select("date", "ticker", F.col(field).alias("value"))
    return quotes.join(F.broadcast(sessions(prices, cfg)), "date").select("date", "t", "ticker", "value")


def dense_reindex(matrix: DataFrame, dates: DataFrame, sess: DataFrame) -> DataFrame:
    """matrix with a null row for each ticker at each of the dates that it has no quote on.

    dates and sess have one row a week and one a day.
    """
    grid = matrix.select("ticker").distinct().crossJoin(F.broadcast(dates.join(sess, "date").select("date", "t")))
    missing = grid.join(matrix.select("ticker", "t"), ["ticker", "t"], "left_anti")
    return matrix.unionByName(missing.select("date", "t", "ticker", F.lit(None).cast("double").alias("value")))


def coverage(panel: DataFrame) -> DataFrame:
    """Tickers with prices and tradable ones in each year."""
    return panel.groupBy(F.year("date").cast("long").alias("year")).agg(
        F.countDistinct("ticker").alias("with_prices"),
        F.countDistinct(F.when(F.col("tradable"), F.col("ticker"))).alias("tradable_any_week"),
        F.round(F.avg(F.col("tradable").cast("int")), 3).alias("tradable_share"),
        F.round(F.median("adv20_usd") / 1e6, 8).alias("median_adv_musd"),
    )


def realised_vol(prices: DataFrame, panel: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """(date, ticker, vol252) of tradable panel rows: trailing 252-row volatility, 200 returns at least.

    Returns bridge a ticker's own gaps: the lag is its previous valid row.
    """
    own = Window.partitionBy("ticker").orderBy("date")
    r = F.log(F.col("adj_close") / F.lag("adj_close").over(own))
    lr = available(prices, cfg).filter("adj_close > 0").select("ticker", "date", r.alias("r"))
    n, mean, sd = trailing("r", own, cfg.sessions_per_year, rows=True)
    rv = lr.select("ticker", "date", n.alias("n"), (sd * F.sqrt(cfg.sessions_per_year * (n - 1) / F.nullif(n, F.lit(0)))).alias("vol252"))
    rows = panel.filter("tradable").select("date", "ticker")
    return rows.join(rv.filter("n >= 200"), ["ticker", "date"]).select("date", "ticker", "vol252")


def stride_sample(matrix: DataFrame, stride: int = 65, first: int = 1) -> DataFrame:
    """Every stride-th session from the first on: a sample whose targets do not overlap."""
    return matrix.filter((F.col("t") - first) % stride == 0)


def first_names(universe: DataFrame, n: int = 100) -> DataFrame:
    """The n first tickers in alphabetical order: a fixed audit set."""
    return universe.select("ticker").distinct().orderBy("ticker").limit(n)
