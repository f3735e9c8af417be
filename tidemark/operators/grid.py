"""Portfolio and monitoring of one score from a grid of weekly facts: a row a block of tickers, each fact a packed matrix.

What the long operators (scored, top_n_weights, equal weights, weekly_sums, psi_rolling) find in rows of tickers and weeks is found
block by block; what tasks send on is small, but for returns on their way to medians and scores on their way to ranks.
The driver holds rows of weeks, and values in order where deciles and pieces of the axis are looked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import ReviewConfig
from tidemark.operators import backtest as B
from tidemark.operators import monitoring as M
from tidemark.operators.weekly import Weeks, from_cells, pack, unpack
from tidemark.sources.warehouse import used_once

#: cells: shipping days, packed; where a block has them, its facts are null and worked out as they are read, as they take three times the room.
SCHEMA = "tickers array<string>, tradable binary, r1 binary, r13 binary, score binary, vol binary, cells binary"
RETURN = B.RETURNS[0]
#: Of the scores of a block, each so-manieth in order stands for as many where the axis is cut; a task sends so many at most.
STRIDE, SENT = 64, 1024


def wanted(score: str) -> tuple[str, ...]:
    return ("tradable", RETURN, "ret_fwd_13w", score, "vol252")


def as_grid(tickers: list[str], found: dict[str, np.ndarray], weeks: Weeks, cells: bytes | None = None) -> pa.RecordBatch:
    """One row for a block of tickers; values of rows that are not tradable, and what is not finite, are NaN. With cells, tradable alone is found."""
    on, *facts = found.values()
    blobs = [np.packbits(on, axis=1).tobytes(), *(pack(np.where(on & np.isfinite(x), x, np.nan)) for x in facts)]
    cols = [pa.array([tickers], pa.list_(pa.string())), *(pa.array([x], pa.binary()) for x in (*blobs, *[None] * (5 - len(blobs)), cells))]
    return pa.RecordBatch.from_arrays(cols, ["tickers", "tradable", "r1", "r13", "score", "vol", "cells"])


def _blocks(batches: Iterator[pa.RecordBatch], weeks: Weeks, cfg: ReviewConfig) -> Iterator[dict]:
    for b in batches:
        want = tuple(c for c in b.schema.names if c not in ("tickers", "tradable", "cells"))
        for i in range(b.num_rows):
            names, (on, cells) = b.column("tickers")[i].values, (b.column(c)[i].as_buffer() for c in ("tradable", "cells"))
            on = np.unpackbits(np.frombuffer(on, "uint8").reshape(len(names), -1), axis=1, count=len(weeks.at)).astype(bool)
            out: dict = {"tickers": names, "tradable": on}
            yield out | (from_cells(cells, len(names), on, weeks, cfg, want) if cells else {c: unpack(b.column(c)[i].as_buffer(), len(names), "float64") for c in want})


def _summed(batches: Iterator[pa.RecordBatch], blocks: Callable, weeks: int, names: list[str], of: Callable[[dict], dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Sums of what is found in each block, by week; lo and hi are least and greatest."""
    total: dict[str, np.ndarray] = {}
    for block in blocks(batches):
        for k, x in of(block).items():
            join = {"lo": np.fmin, "hi": np.fmax}.get(k, np.add)
            total[k] = join(total[k], x) if k in total else x
    if total:
        yield pa.RecordBatch.from_pydict({"w": pa.array(np.arange(weeks), pa.int32())} | {k: pa.array(x, mask=~np.isfinite(x)) for k, x in ((k, total[k]) for k in names)})


class Grid:
    """The grid as a written table, with the facts of the market by week."""

    def __init__(self, table: DataFrame, weeks: Weeks, market: dict[str, np.ndarray], cfg: ReviewConfig, model: str):
        self.table, self.cfg, self.model, self.market = table, cfg, model, market
        self.spark, self.n, self.blocks = table.sparkSession, len(weeks.at), partial(_blocks, weeks=weeks, cfg=cfg)
        self.dates = [date(1970, 1, 1) + timedelta(int(d)) for d in weeks.days[weeks.at]]
        #: completed_weeks.
        self.done = market["quoted"].astype(bool) & np.isfinite(market[RETURN])

    def _of(self, *cols: str) -> DataFrame:
        """What _blocks reads these facts from."""
        return self.table.select("tickers", "tradable", "cells", *cols)

    def _sums(self, cols: list[str], names: dict[str, str], of: Callable[[dict], dict[str, np.ndarray]]) -> pd.DataFrame:
        """Sums by week over all blocks."""
        n, order, blocks = self.n, list(names), self.blocks
        part = self._of(*cols).mapInArrow(lambda b: _summed(b, blocks, n, order, of), "w int, " + ", ".join(f"{k} {t}" for k, t in names.items()))
        how = {"lo": F.min, "hi": F.max}
        with used_once(self.spark):
            found = part.groupBy("w").agg(*(how.get(k, F.sum)(k).alias(k) for k in names)).toPandas().set_index("w")
        return found.reindex(range(n))

    def held(self) -> DataFrame:
        """top_n_weights of the score."""
        blocks, top, done, days = self.blocks, self.cfg.top_n, self.done, np.array(self.dates, "datetime64[D]")

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in blocks(batches):
                names = np.array(b["tickers"].to_pylist(), object)
                order = np.argsort(names, kind="stable")
                score = np.where(b["tradable"] & done, b["score"], np.nan)[order]
                first = np.argsort(-score, axis=0, kind="stable")[:top]
                score = np.take_along_axis(score, first, 0)
                row, week = np.nonzero(~np.isnan(score))
                at = order[first[row, week]]
                r = b["r1"][at, week]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(days[week]), pa.array(names[at], pa.string()), pa.array(score[row, week]), pa.array(r, mask=np.isnan(r))], ["date", "ticker", "score", RETURN]
                )

        rows = self._of("r1", "score").mapInArrow(best, f"date date, ticker string, score double, {RETURN} double")
        return B.top_n_weights(rows.withColumn("strategy", F.lit(self.model)), top, (RETURN,))

    def equal_weight(self, strategy: str = "universe_ew") -> DataFrame:
        """portfolio_returns of all tradable names at equal weight."""

        def count(b: dict) -> dict[str, np.ndarray]:
            known = np.isfinite(b["r1"])
            return {"n": b["tradable"].sum(axis=0), "bare": (b["tradable"] & ~known).sum(axis=0), "s": np.where(known, b["r1"], 0.0).sum(axis=0)}

        found = self._sums(["r1"], {"n": "long", "bare": "long", "s": "double"}, count)
        n, bare, s = (np.nan_to_num(found[c].to_numpy(float)) for c in ("n", "bare", "s"))
        at = np.flatnonzero(self.done & (n > 0))
        if bare[at].any():
            raise ValueError(B.MISSING)
        n, weeks = n[at], self.n
        g = s[at] / n
        grown = np.where(1.0 + g == 0, np.inf, 1.0 + g)

        def legs(b: dict) -> dict[str, np.ndarray]:
            leg = b["tradable"][:, at] / n
            before = leg * (1.0 + np.nan_to_num(b["r1"][:, at])) / grown
            leg[:, 1:] -= before[:, :-1]
            out = np.zeros(weeks)
            out[at] = np.abs(leg).sum(axis=0)
            return {"moved": out}

        moved = self._sums(["r1"], {"moved": "double"}, legs)["moved"].to_numpy(float)[at]
        rows = [(self.dates[w], strategy, float(x), float(x - m * self.cfg.cost_bps / 1e4), float(m / 2.0), int(k)) for w, x, m, k in zip(at, g, moved, n, strict=True)]
        return self.spark.createDataFrame(rows, "date date, strategy string, ret_gross double, ret_net double, turnover double, n_held int")

    def benchmark(self, strategy: str = "benchmark_spy") -> DataFrame:
        """portfolio_returns of the benchmark alone."""
        on = np.flatnonzero(self.done & self.market["tradable"].astype(bool))
        rows = [(strategy, self.dates[w], self.cfg.benchmark, 1.0, float(self.market[RETURN][w])) for w in on]
        return B.portfolio_returns(self.spark.createDataFrame(rows, f"strategy string, date date, ticker string, w double, {RETURN} double"), self.cfg)

    def _medians(self) -> pd.DataFrame:
        """Medians of both returns over scored rows, by week; weeks without a scored row have none. A task sends a week's returns as one."""
        blocks = self.blocks

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            for b in blocks(batches):
                at, week = np.nonzero(~np.isnan(b["score"]))
                held.append((week, b["r1"][at, week], b["r13"][at, week]))
                if sum(len(h[0]) for h in held) >= M.PIECE * 4:
                    yield sent(held)
                    held = []
            if held:
                yield sent(held)

        def sent(held: list[tuple]) -> pa.RecordBatch:
            week, r1, r13 = (np.concatenate([h[i] for h in held]) for i in range(3))
            order = np.argsort(week, kind="stable")
            week, r = week[order], np.stack([r1[order], r13[order]])
            first = np.flatnonzero(np.append(True, week[1:] != week[:-1])) if len(week) else np.zeros(0, "int64")
            blobs = [pack(r[:, a:e]) for a, e in zip(first, np.append(first[1:], len(week)), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(week[first], pa.int32()), pa.array(blobs, pa.binary())], ["w", "r"])

        def median(rows: pd.DataFrame) -> pd.DataFrame:
            both = np.concatenate([unpack(pa.py_buffer(x), 2, "float64") for x in rows["r"]], axis=1)
            known = (x[~np.isnan(x)] for x in both)
            return pd.DataFrame([(rows["w"].iloc[0], *(np.median(x) if len(x) else None for x in known))], columns=["w", "m1", "m13"])

        packed = self._of("r1", "r13", "score").mapInArrow(rows, "w int, r binary")
        with used_once(self.spark):
            return packed.groupBy("w").applyInPandas(median, "w int, m1 double, m13 double").toPandas().sort_values("w")

    def _psi_edges(self, dev: np.ndarray) -> dict[str, np.ndarray]:
        """Inner deciles of score and volatility over the development weeks; none where there are no values.

        Exact, in two passes: so-manieth values of each task bound where a decile can lie, then what lies there is looked at. The driver
        holds these: a few thousandths of all values for each decile.
        """
        blocks, b, kinds = self.blocks, self.cfg.psi_buckets, ("score", "vol")

        def dev_values(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
            found: dict[str, list] = {c: [] for c in kinds}
            for block in blocks(batches):
                for c in kinds:
                    x = block[c][:, dev]
                    found[c].append(x[~np.isnan(x)])
            return {c: np.sort(np.concatenate(x)) for c, x in found.items() if x}

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for c, x in dev_values(batches).items():
                if len(x):
                    step = -(-len(x) // SENT)
                    yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([len(x)]), pa.array([step]), pa.array([x[::step]], pa.list_(pa.float64()))], ["c", "n", "step", "x"])

        table, targets, bounds = self._of(*kinds), {}, {}
        for c, own in table.mapInArrow(some, "c string, n long, step long, x array<double>").toPandas().groupby("c"):
            size, points = int(own["n"].sum()), np.concatenate(own["x"].to_list())
            weight = np.repeat(own["step"].to_numpy(), [len(x) for x in own["x"]])
            order = np.argsort(points, kind="stable")
            points, upto = points[order], np.cumsum(weight[order])
            below, least = np.append(0, upto)[np.searchsorted(points, points, "left")], upto[np.searchsorted(points, points, "right") - 1] - own["step"].sum()
            place = [(size - 1) * (k / b) for k in range(b + 1)]
            targets[c] = [(p, int(np.floor(p)), int(np.ceil(p))) for p in place]
            # below: no more values are smaller than the point; least: no fewer are at most the point.
            ks = sorted({k for _, *pair in targets[c] for k in pair})
            low = points[np.maximum(np.searchsorted(below, ks, "right") - 1, 0)]
            high = np.append(points, np.inf)[np.searchsorted(least, np.array(ks) + 1, "left")]
            bounds[c] = (ks, low, high)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for c, x in dev_values(batches).items():
                if c in bounds:
                    _, low, high = bounds[c]
                    before = np.searchsorted(x, low, "left")
                    on = np.zeros(len(x) + 1, "int64")
                    np.add.at(on, before, 1)
                    np.add.at(on, np.searchsorted(x, high, "right"), -1)
                    v, count = np.unique(x[np.cumsum(on)[:-1] > 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([c]), pa.array([before], pa.list_(pa.int64())), pa.array([v], pa.list_(pa.float64())), pa.array([count], pa.list_(pa.int64()))], ["c", "before", "v", "n"]
                    )

        edges = {}
        for c, own in table.mapInArrow(near, "c string, before array<long>, v array<double>, n array<long>").toPandas().groupby("c"):
            ks, low, _ = bounds[c]
            v, count, before = np.concatenate(own["v"].to_list()), np.concatenate(own["n"].to_list()), np.sum(own["before"].to_list(), axis=0)
            order = np.argsort(v, kind="stable")
            v, upto = v[order], np.cumsum(count[order])
            # Of the values looked at, those below a bound; all from there to the decile are among them.
            skipped = np.append(0, upto)[np.searchsorted(v, low, "left")]
            at = {k: v[np.searchsorted(upto, k - b0 + s0, "right")] for k, b0, s0 in zip(ks, before, skipped, strict=True)}
            es = [at[lo] if lo == hi or at[lo] == at[hi] else (hi - p) * at[lo] + (p - lo) * at[hi] for p, lo, hi in targets[c]]
            edges[c] = np.unique(np.array(es, float))[1:-1]
        return edges

    def _cuts(self, pieces: int) -> np.ndarray:
        """Scores that cut the axis into about so many even pieces; they bear on the tasks' sizes only."""
        blocks = self.blocks

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = [np.sort(s[~np.isnan(s)])[STRIDE // 2 :: STRIDE] for s in (b["score"].ravel() for b in blocks(batches))]
            if x:
                x = np.sort(np.concatenate(x))
                step = -(-len(x) // SENT) or 1
                yield pa.RecordBatch.from_arrays([pa.array([float(step)]), pa.array([x[step // 2 :: step]], pa.list_(pa.float64()))], ["weight", "x"])

        got = self._of("score").mapInArrow(some, "weight double, x array<double>").collect()
        x = np.concatenate([np.array(r["x"], float) for r in got] or [np.zeros(0)])
        weight = np.concatenate([np.full(len(r["x"]), r["weight"]) for r in got] or [np.zeros(0)])
        order = np.argsort(x)
        x, upto = x[order], np.cumsum(weight[order])
        return np.unique(x[np.searchsorted(upto, upto[-1] * np.arange(1, pieces) / pieces)]) if len(x) else x

    def rolling_metrics(self, cal: DataFrame) -> DataFrame:
        """rolling_metrics of the score and of the realised volatility of all tradable names."""
        cfg, model, n, b = self.cfg, self.model, self.n, self.cfg.psi_buckets
        medians = self._medians()
        own = medians["w"].to_numpy("int64")
        number = np.zeros(n, "int64")  # of the model's own weeks, from 1
        number[own] = np.arange(1, len(own) + 1)
        m1, m13 = (np.full(n, np.nan) for _ in range(2))
        m1[own], m13[own] = medians["m1"].to_numpy(float), medians["m13"].to_numpy(float)
        wk = self.spark.createDataFrame([(model, self.dates[w], int(number[w])) for w in own], "model string, date date, week int")
        edges = self._psi_edges(np.flatnonzero((number > 0) & (number <= cfg.dev_weeks)))
        middle = float(np.median(edges["score"])) if len(edges.get("score", ())) else 0.0
        counted = {"score": "k", "vol": "v"}

        def sums(x: dict) -> dict[str, np.ndarray]:
            s, r1, r13, out = x["score"], x["r1"], x["r13"], {}
            on = ~np.isnan(s)
            for k, r, m in (("1", r1, m1), ("13", r13, m13)):
                known = on & ~np.isnan(r)
                up = known & (r > m)
                out |= {f"p{k}": up.sum(axis=0), f"n{k}": known.sum(axis=0) - up.sum(axis=0)}
            ds, dr = (np.where(known, d, 0.0) for d in (s - middle, r13 - m13))
            out |= {"n": known.sum(axis=0), "s": ds.sum(axis=0), "r": dr.sum(axis=0), "ss": (ds * ds).sum(axis=0), "sr": (ds * dr).sum(axis=0), "rows": on.sum(axis=0)}
            out |= {"lo": np.fmin.reduce(np.where(known, s, np.nan), axis=0), "hi": np.fmax.reduce(np.where(known, s, np.nan), axis=0)}
            for c, k in counted.items():
                at, week = np.nonzero(~np.isnan(x[c]) & (number > 0))
                bucket = np.searchsorted(edges.get(c, np.zeros(0)), x[c][at, week], "right")
                hits = np.bincount(week * b + bucket, minlength=n * b).reshape(n, b)
                out |= {f"{k}{i}": hits[:, i] for i in range(b)}
            return out

        names = {k: "long" for k in ("p1", "n1", "p13", "n13", "n", "rows", *(f"{k}{i}" for k in counted.values() for i in range(b)))} | {k: "double" for k in ("s", "r", "ss", "sr", "lo", "hi")}
        found = self._sums(["r1", "r13", "score", "vol"], names, sums).loc[own]
        found.insert(0, "week", number[own])
        found.insert(0, "model", model)
        psi = None
        for c, k in counted.items():
            rows = [(model, int(r[0]), *map(int, r[1:])) for r in found[["week", *(f"{k}{i}" for i in range(b))]].itertuples(index=False)]
            weekly = self.spark.createDataFrame(rows, "model string, week int, " + ", ".join(f"n{i} long" for i in range(b)))
            one = M.psi_of_counts(weekly, wk, cfg, f"psi_{'input' if c == 'vol' else c}")
            psi = one if psi is None else psi.unionByName(one)
        with np.errstate(all="ignore"):
            k, s, r = (found[c].to_numpy(float) for c in ("n", "s", "r"))
            means = {"ms": s / k + middle, "mr": r / k + m13[own], "vs": found["ss"].to_numpy(float) / k - (s / k) ** 2, "c": found["sr"].to_numpy(float) / k - s / k * (r / k)}
        return M.with_ranks(self.spark, wk, found.assign(**means), psi, lambda spans, sums: self._window_ranks(spans, sums, number, m1, m13), cfg, None, cal)

    def _window_ranks(self, spans: list[tuple], sums: pd.DataFrame, number: np.ndarray, m1: np.ndarray, m13: np.ndarray) -> DataFrame:
        """window_ranks; a task sends the rows of a piece as one."""
        blocks, cuts, plan = self.blocks, self._cuts(max(int(sums["rows"].sum()) // M.PIECE, 7)), M.spans_by_model(spans, sums, [self.model])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = []
            for b in blocks(batches):
                at, week = np.nonzero(~np.isnan(b["score"]))
                code = number[week]
                for r, m in ((b["r1"][at, week], m1), (b["r13"][at, week], m13)):
                    code = code * 3 + np.where(np.isnan(r), 0, 1 + (r > m[week]))
                held.append((b["score"][at, week], code))
                if sum(len(h[0]) for h in held) >= M.PIECE * 4:
                    yield sent(held)
                    held = []
            if held:
                yield sent(held)

        def sent(held: list) -> pa.RecordBatch:
            score, code = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            score, code, count = M.together(score, code, np.ones(len(score), "int64"))
            which = np.searchsorted(cuts, score, "left")
            first = np.flatnonzero(np.append(True, which[1:] != which[:-1])) if len(which) else np.zeros(0, "int64")
            ends = np.append(first[1:], len(which))
            blobs = {c: [pack(x[None, a:e]) for a, e in zip(first, ends, strict=True)] for c, x in (("score", score), ("code", code), ("n", count))}
            return pa.RecordBatch.from_arrays([pa.array(which[first].astype("int32")), *(pa.array(x, pa.binary()) for x in blobs.values())], ["id", *blobs])

        def ranked(rows: pd.DataFrame) -> pd.DataFrame:
            parts = [np.concatenate([unpack(pa.py_buffer(x), 1, t)[0] for x in rows[c]]) for c, t in (("score", "float64"), ("code", "int64"), ("n", "int64"))]
            return M.ranked_piece(int(rows["id"].iloc[0]), *M.together(*parts), plan[0])

        cells = self._of("r1", "r13", "score").mapInArrow(cut, "id int, score binary, code binary, n binary")
        return M.joined(cells.groupBy("id").applyInPandas(ranked, M.RANKED), plan)
