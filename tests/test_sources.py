"""Tables, files and streams."""

from __future__ import annotations

import datetime as dt
import hashlib
import json

import pytest

from tidemark.schemas import KEYS, SCHEMAS
from tidemark.sources import connectors, warehouse
from tidemark.streaming import monitor

D = dt.date(2022, 1, 7)


def test_warehouse_round_trip(spark, tmp_path):
    w = warehouse.Warehouse(spark, str(tmp_path / "w"))
    w.init_schema()
    assert {t: w.read(t).count() for t in SCHEMAS} == dict.fromkeys(SCHEMAS, 0)
    rows = spark.createDataFrame([(1.0, "A", D, "m"), (2.0, "B", D, "n")], "score double, ticker string, date date, model string")
    w.append("signals", rows)  # columns by name
    w.append("signals", rows.limit(0))
    assert w.read("signals").count() == 2
    w.upsert("signals", spark.createDataFrame([(5.0, "A", D, "m"), (6.0, "C", D, "m")], rows.schema))
    assert {(r.ticker, r.score) for r in w.read("signals").collect()} == {("A", 5.0), ("B", 2.0), ("C", 6.0)}
    w.replace_parts("signals", spark.createDataFrame([(9.0, "Z", D, "m")], rows.schema))
    assert {(r.ticker, r.score) for r in w.read("signals").collect()} == {("B", 2.0), ("Z", 9.0)}
    assert w.sql("SELECT ticker FROM signals WHERE score > :low", low=5.0).first().ticker == "Z"
    for t, key in KEYS.items():
        df = w.read(t)
        assert df.count() == df.select(*key).distinct().count()


def test_prepend_and_resume(spark):
    a = spark.createDataFrame([("SPY", 1)], "k string, v int")
    b = spark.createDataFrame([("SPY", 2), ("A", 3)], "k string, v int")
    assert {(r.k, r.v) for r in warehouse.prepend_missing(a, b, "k").collect()} == {("SPY", 1), ("A", 3)}
    assert [r.k for r in warehouse.not_yet_stored(b, a, "k").collect()] == ["A"]


def test_wide_to_long(spark):
    wide = spark.createDataFrame([("2022-01-07", 1.0, 2.0, None)], "date string, A_close double, A_adj_close double, B_close double")
    rows = warehouse.wide_to_long(wide).collect()
    assert [(r.ticker, r.close, r.adj_close, r.open) for r in rows] == [("A", 1.0, 2.0, None)]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "k string, v double")
    warehouse.write_csv(df, str(tmp_path / "c"))
    assert warehouse.read_csv(spark, str(tmp_path / "c"), "k string, v double").collect() == df.collect()
    warehouse.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().v == 1.5
    (tmp_path / "x.txt").write_text("hello")
    assert warehouse.manifest(spark, str(tmp_path / "x.txt")).first().sha256 == hashlib.sha256(b"hello").hexdigest()
    (tmp_path / "r.json").write_text(json.dumps({"trials": [{"model": "m1"}, {"model": "m2"}]}, indent=1))
    from tidemark.operators.overfit import trials_of

    assert sorted(r.model for r in trials_of(warehouse.read_registry(spark, str(tmp_path / "r.json"))).collect()) == ["m1", "m2"]


def test_page_source(spark):
    calls = {"tries": 3, "pause": 0.0}

    def fetch(part):
        return [(f"T{part}", "2022-01-07", float(part))]

    df = connectors.read_parts(spark, fetch, [1, 2, 3], "ticker string, date string, close double", **calls)
    assert sorted(r.ticker for r in df.collect()) == ["T1", "T2", "T3"]


def test_page_source_gives_up(spark):
    def broken(part):
        raise OSError("no network")

    with pytest.raises(Exception, match="no network"):
        connectors.read_parts(spark, broken, [1], "x int", tries=2, pause=0.0).collect()


def test_streaming_counts_match_batch(spark, sf_dir, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(str(src))
    rows = spark.readStream.schema(spark.read.parquet(str(src)).schema).parquet(str(src))
    edges = [5.0, 10.0, 20.0, 40.0]
    q = monitor.bucket_counts(rows, "ts", "value", edges, "7 days").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.window.start, r.bucket): r.n for r in spark.table("counts").collect()}
    want = {(r.window.start, r.bucket): r.n for r in monitor.bucket_counts(spark.read.parquet(str(src)), "ts", "value", edges, "7 days").collect()}
    assert got == want and got
    psi = monitor.psi_of_counts(spark.table("counts"), {k: 1 / 5 for k in range(5)}).collect()
    assert all(r.psi >= 0 for r in psi)


def test_screener_maps_fields(spark):
    from tidemark.sources.connectors import read_screener

    def fetch(offset):
        return [{"symbol": f"T{offset + k}", "shortName": "n", "marketCap": 5, "extra": 1} for k in range(2)] if offset < 4 else []

    rows = read_screener(spark, fetch, wanted=4, size=2, pause=0.0).orderBy("ticker").collect()
    assert [r.ticker for r in rows] == ["T0", "T1", "T2", "T3"]
    assert rows[0].asDict() == {"ticker": "T0", "name": "n", "exchange": None, "market_cap": 5.0, "quote_type": None, "sector": None, "industry": None}


def test_quotes_become_long(spark):
    import datetime as dt

    from tidemark.sources.connectors import read_quotes

    def fetch(batch):
        fields = ("Open", "High", "Low", "Close", "Adj Close", "Volume")
        day = dt.datetime(2022, 1, 3, 5)
        if len(batch) == 1:
            return [(day, dict(zip(fields, (1, 2, 3, 4, 5, 6), strict=True)))]
        cells = {(f, t): k for k, f in enumerate(fields) for t in batch}
        return [(day, cells | {("Close", batch[0]): float("nan")})]

    rows = read_quotes(spark, fetch, ["A", "B", "C"], size=2, pause=0.0).orderBy("ticker").collect()
    assert [tuple(r) for r in rows] == [(dt.date(2022, 1, 3), "B", 0.0, 1.0, 2.0, 3.0, 4.0, 5.0), (dt.date(2022, 1, 3), "C", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)]
