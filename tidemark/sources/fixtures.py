"""Daily prices and a universe from the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import ReviewConfig
from tidemark.operators import grid, weekly


def observed_prices(lineitem: DataFrame, market: str = "SPY", span: int = 20) -> DataFrame:
    """Bars on days with shipments: price is a 20-observation volume-weighted mean, the adjustment the mean discount.

    Sums are decimal, so they do not depend on the order of rows.
    """
    dec = "decimal(18,2)"
    li = lineitem.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_extendedprice").cast(dec).alias("ext"),
        F.col("l_quantity").cast(dec).alias("qty"),
        F.col("l_discount").cast(dec).alias("disc"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"),
    )
    sums = lambda df: df.agg(
        F.sum("ext").alias("ext"), F.sum("qty").alias("qty"), F.sum("disc").alias("disc"), F.count("*").alias("n"),
        F.max("unit").alias("hi"), F.min("unit").alias("lo"),
    )
    by_ticker = sums(li.groupBy("ticker", "date"))
    # The market sums the tickers' sums instead of doubling the rows.
    whole = by_ticker.groupBy("date").agg(
        F.sum("ext").alias("ext"), F.sum("qty").alias("qty"), F.sum("disc").alias("disc"), F.sum("n").alias("n"),
        F.max("hi").alias("hi"), F.min("lo").alias("lo"),
    ).withColumn("ticker", F.lit(market))
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(1 - span, 0)
    total = lambda c: F.sum(c).over(w).cast("double")
    return by_ticker.unionByName(whole).select(
        "ticker", "date", F.col("qty").cast("double").alias("volume"), F.max("hi").over(w).alias("high"), F.min("lo").over(w).alias("low"),
        (total("ext") / total("qty")).alias("close"), (1.0 - total("disc") / total("n")).alias("factor"),
    )


def _bars(df: DataFrame) -> DataFrame:
    return df.select(
        "date", "ticker", ((F.col("high") + F.col("low")) / 2.0).alias("open"), "high", "low", "close",
        (F.col("close") * F.col("factor")).alias("adj_close"), "volume",
    )


def sparse_prices(lineitem: DataFrame, market: str = "SPY") -> DataFrame:
    return _bars(observed_prices(lineitem, market))


def dense_prices(lineitem: DataFrame, market: str = "SPY") -> DataFrame:
    """Bars on every market session from a ticker's first day on; days without shipments repeat the last bar.

    Only this fixture fills gaps; the engine never does.
    """
    v = observed_prices(lineitem, market)
    sessions = v.filter(F.col("ticker") == market).select("date")
    grid = v.select("ticker").distinct().crossJoin(F.broadcast(sessions))  # sessions: one row a day
    z = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(z).alias(c)
    filled = grid.join(v, ["ticker", "date"], "left").select(
        "ticker", "date", F.coalesce("volume", F.lit(0.0)).alias("volume"), last("high"), last("low"), last("close"), last("factor")
    )
    return _bars(filled.filter("close is not null"))


def _cents(x: np.ndarray) -> np.ndarray:
    """x as a decimal of two digits, times 100, halves rounded away from zero as written."""
    x = np.nan_to_num(x)
    y = x * 100.0
    out = np.rint(y).astype("int64")
    for i in np.flatnonzero(np.abs(np.abs(y - out) - 0.5) < 0.01):
        out[i] = int(Decimal(repr(float(x[i]))).quantize(Decimal("0.01"), ROUND_HALF_UP) * 100)
    return out


def _shipped(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_suppkey").cast("long").alias("key"), F.unix_date(F.col("l_shipdate").cast("date")).alias("day"),
        F.col("l_extendedprice").alias("ext"), F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"),
    ).filter("day is not null")


def _cents_of(c: str) -> Column:
    """_cents as a column."""
    x = F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    y = x * 100.0
    half = F.abs(F.abs(y - F.rint(y)) - 0.5) < 0.01
    return F.when(half, (x.cast("decimal(18,2)") * 100).cast("long")).otherwise(F.rint(y).cast("long"))


def _summed(key: np.ndarray, day: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Integer sums of values by key and day, in that order."""
    order = np.lexsort((day, key))
    key, day = key[order], day[order]
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (day[1:] != day[:-1]))) if len(key) else np.zeros(0, "int64")
    return key[first], day[first], [np.add.reduceat(v[order], first) if len(first) else v for v in values]


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    key, day, *doubles = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "day", "ext", "qty", "disc"))
    return key, day.astype("int64"), [*map(_cents, doubles)]


def market_days(lineitem: DataFrame) -> np.ndarray:
    """A row for each session: day, sums of price, quantity and discount in hundredths, shipments. A few thousand rows."""
    sums = [F.sum(_cents_of(c)).alias(c) for c in ("ext", "qty", "disc")]
    rows = _shipped(lineitem).groupBy("day").agg(*sums, F.count("*").alias("n")).orderBy("day").collect()
    return np.array([tuple(r) for r in rows], dtype="int64").reshape(-1, 5)


#: Shipments packed at once by a task.
PACKED = 400_000


def _dealt(lineitem: DataFrame) -> DataFrame:
    """(id, blob): shipments packed by the partition that their supplier goes to, dealt out."""
    n = int(lineitem.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(held: list) -> pa.RecordBatch:
        rows = np.stack([np.concatenate([h[i] for h in held]) for i in range(5)])
        ids = ((rows[0].astype("uint64") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(n)
        order = np.lexsort((rows[1], rows[0], ids))
        rows, ids = rows[:, order], ids[order]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        blobs = []
        for a, b in zip(first, np.append(first[1:], len(ids)), strict=True):
            part = rows[:, a:b].copy()
            part[:2, 1:] = np.diff(rows[:2, a:b], axis=1)
            blobs.append(weekly.pack_whole(part))
        return pa.RecordBatch.from_arrays([pa.array(ids[first].astype("int32")), pa.array(blobs, pa.binary())], ["id", "blob"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                key, day, values = _columns(b)
                held.append((key, day, *values))
                size += b.num_rows
            if size >= PACKED:
                yield deal(held)
                held, size = [], 0
        if held:
            yield deal(held)

    return _shipped(lineitem).filter("key is not null").mapInArrow(part, "id int, blob binary").repartitionById(n, "id")


def _undealt(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """Rows of key, day, price, quantity and discount in hundredths."""
    found = []
    for b in batches:
        for blob in b.column("blob"):
            rows = weekly.unpack_whole(blob.as_buffer(), 5)
            rows[:2] = np.cumsum(rows[:2], axis=1)
            found.append(rows)
    return found


def _series(key: np.ndarray, day: np.ndarray, sums: list[np.ndarray], days: np.ndarray, span: int) -> Iterator[tuple]:
    """Blocks of dense_prices: keys, cells (ticker's number, session, sums, close and adj_close by shipping day), and close, adj_close and volume by session;
    key and day are sorted."""
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, "int64")
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
    close, adj = weekly.trailing_prices(group, starts, sums, span)
    at = np.searchsorted(days, day)
    for lo in range(0, len(starts), weekly.BLOCK):
        a, b = starts[lo], starts[lo + weekly.BLOCK] if lo + weekly.BLOCK < len(starts) else len(key)
        k = group[a:b] - lo
        last = np.full((k[-1] + 1, len(days)), -1)
        last[k, at[a:b]] = np.arange(a, b)
        shipped = last >= 0
        last = np.maximum.accumulate(last, axis=1)
        seen = last >= 0
        cells = (k, at[a:b], [s[a:b] for s in sums], close[a:b], adj[a:b])
        yield key[starts[lo : lo + weekly.BLOCK]], cells, np.where(seen, close[last], np.nan), np.where(seen, adj[last], np.nan), np.where(shipped, sums[1][last] / 100.0, np.where(seen, 0.0, np.nan))


def weekly_facts(lineitem: DataFrame, cfg: ReviewConfig, want: tuple[str, ...], market: np.ndarray, span: int = 20) -> DataFrame:
    """weekly.facts of dense_prices, a row a ticker. Shipments are dealt out by supplier once; nothing else is shuffled.

    market: market_days of lineitem.
    """
    weeks = weekly.Weeks.of(market[:, 0], cfg)
    return _facts(lineitem, cfg, market, span, lambda names, cells, facts: weekly.as_rows(names, facts(want), weeks), weekly.schema(want))


def weekly_grid(lineitem: DataFrame, cfg: ReviewConfig, score: str, market: np.ndarray, span: int = weekly.SPAN) -> DataFrame:
    """weekly_facts of one score as grid.as_grid has them, a row a block of tickers. Of momentum, shipping days are kept instead of facts where prices allow."""
    weeks = weekly.Weeks.of(market[:, 0], cfg)

    def rows(names: list[str], cells: tuple, facts: Callable) -> pa.RecordBatch:
        blob = weekly.as_cells(*cells, weeks) if score == "momentum" and span == weekly.SPAN else None
        return grid.as_grid(names, facts(grid.wanted(score)[:1] if blob else grid.wanted(score)), weeks, blob)

    return _facts(lineitem, cfg, market, span, rows, grid.SCHEMA)


def market_facts(market: np.ndarray, cfg: ReviewConfig, want: tuple[str, ...], span: int = 20) -> tuple[weekly.Weeks, dict[str, np.ndarray]]:
    """The weeks, and facts of the market alone by week."""
    days = market[:, 0]
    weeks = weekly.Weeks.of(days, cfg)
    known = len(weeks.days)
    for _, _, *series in _series(np.zeros(len(days), "int64"), days, [market[:, i] for i in range(1, 5)], days, span):
        return weeks, {k: x[0] for k, x in weekly.facts(*(x[:, :known] for x in series), weeks, cfg, want).items()}
    return weeks, {k: np.zeros(0) for k in want}


def _facts(lineitem: DataFrame, cfg: ReviewConfig, market: np.ndarray, span: int, rows: Callable, schema: str) -> DataFrame:
    """rows: from names, cells and a function that finds wanted facts to a batch."""
    days, name = market[:, 0], cfg.benchmark
    weeks = weekly.Weeks.of(days, cfg)
    known = len(weeks.days)

    def found(key, day, sums, named) -> Iterator[pa.RecordBatch]:
        for keys, cells, *series in _series(key, day, sums, days, span):
            own = [x[:, :known] for x in series]
            yield rows([*map(named, keys)], cells, partial(weekly.facts, *own, weeks, cfg))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _undealt(batches)
        if held:
            key, day, *values = np.concatenate(held, axis=1)
            held.clear()
            yield from found(*_summed(key, day, [*values, np.ones(len(key), "int64")]), lambda k: f"S{k}")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        if len(market):
            yield from found(np.zeros(len(days), "int64"), days, [market[:, i] for i in range(1, 5)], lambda _: name)

    return _dealt(lineitem).mapInArrow(part, schema).unionByName(lineitem.sparkSession.range(0, 1, 1, 1).mapInArrow(whole, schema))


def listing(part: DataFrame) -> DataFrame:
    """A screener snapshot: one row for each part."""
    return part.select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("ticker"), F.col("p_name").alias("name"), F.col("p_brand").alias("exchange"),
        F.col("p_type").alias("sector"), F.lit(None).cast("string").alias("industry"), F.col("p_retailprice").alias("market_cap"), F.lit("EQUITY").alias("quote_type"),
    )


def prices(spark: SparkSession, sf_dir: str, dense: bool = True) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return dense_prices(lineitem) if dense else sparse_prices(lineitem)
