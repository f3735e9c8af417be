"""Sources that are fetched in parts: pages of a screener, batches of tickers.

A part is one partition, so parts are fetched in parallel and a lost executor costs its parts only. The
fetching function is given by the caller; nothing here talks to a network by itself.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def with_retries(fetch: Callable, part, tries: int = 3, pause: float = 1.0) -> Iterable[tuple]:
    """fetch(part), tried again after growing pauses; the last error is raised."""
    for k in range(tries):
        try:
            return list(fetch(part))
        except Exception:
            if k == tries - 1:
                raise
            time.sleep(pause * 2**k)
    return []


class _Part(InputPartition):
    def __init__(self, value):
        self.value = value


def read_parts(spark: SparkSession, fetch: Callable, parts: Sequence, schema: str, tries: int = 3, pause: float = 1.0) -> DataFrame:
    """Rows of fetch(part) for each part, as tuples in the order of the schema."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [_Part(p) for p in parts]

        def read(self, partition):
            yield from with_retries(fetch, partition.value, tries, pause)

    class Parts(DataSource):
        @classmethod
        def name(cls):
            return "tidemark_parts"

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Parts)
    return spark.read.format("tidemark_parts").load()


def batches(items: Sequence, size: int = 100) -> list[tuple]:
    """Items in batches, each one part of a price download."""
    return [tuple(items[k : k + size]) for k in range(0, len(items), size)]


def pages(wanted: int, size: int = 250, excess: float = 0.15) -> list[int]:
    """Page offsets that cover `wanted` rows and some more, as cleaning drops a few."""
    return list(range(0, int(wanted * (1 + excess)) + size - 1, size))


# The fields that a screener and a price download name, in the order of the columns here.
SCREENER_FIELDS = ("symbol", "shortName", "exchange", "marketCap", "quoteType", "sector", "industry")
SCREENER_SCHEMA = "ticker string, name string, exchange string, market_cap double, quote_type string, sector string, industry string"
QUOTE_FIELDS = ("Open", "High", "Low", "Close", "Adj Close", "Volume")
QUOTE_SCHEMA = "date date, ticker string, open double, high double, low double, close double, adj_close double, volume double"


def _number(x) -> float | None:
    return None if x is None or x != x else float(x)


def read_screener(spark: SparkSession, fetch: Callable, wanted: int, size: int = 250, **retry) -> DataFrame:
    """A listing from the pages of a screener: fetch(offset) gives records, whose missing fields are null.

    Some 15 % more than wanted are asked for, as cleaning drops share classes and other instruments.
    """

    def rows(offset: int) -> Iterable[tuple]:
        for r in fetch(offset) or ():
            yield tuple(_number(r.get(c)) if c == "marketCap" else r.get(c) for c in SCREENER_FIELDS)

    return read_parts(spark, rows, pages(wanted, size), SCREENER_SCHEMA, **retry)


def long_quotes(wide: Iterable[tuple], tickers: Sequence[str]) -> Iterable[tuple]:
    """One row a day and ticker from wide rows (time, {(field, ticker): value}); those without a close are left out."""
    for time_, cells in wide:
        day = time_.date() if hasattr(time_, "date") else time_
        for t in tickers:
            values = [_number(cells.get((f, t))) for f in QUOTE_FIELDS]
            if values[3] is not None:
                yield (day, t, *values)


def read_quotes(spark: SparkSession, fetch: Callable, tickers: Sequence[str], size: int = 100, **retry) -> DataFrame:
    """Daily bars of many tickers in batches: fetch(batch) gives wide rows as long_quotes() takes them, or a lone
    ticker's cells by field alone."""

    def rows(batch: tuple) -> Iterable[tuple]:
        found = fetch(batch) or ()
        if len(batch) == 1:
            found = ((d, {k if isinstance(k, tuple) else (k, batch[0]): v for k, v in cells.items()}) for d, cells in found)
        yield from long_quotes(found, batch)

    return read_parts(spark, rows, batches(tickers, size), QUOTE_SCHEMA, **retry)
