"""Weekly facts of whole price series: one row a ticker, an array over the weeks for each fact.

The long operators (build_panel, momentum, gbm_mu_sigma, gbm_weekly_variants, realised_vol) say what the facts are; here
they are worked out for blocks of tickers at once, so daily rows are neither stored nor shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import ReviewConfig
from tidemark.functions.stats import ERF_A, ERF_P

#: Tickers worked on at once.
BLOCK = 64
#: Shipping days of a ticker that a price is a mean over.
SPAN = 20


@dataclass(frozen=True)
class Weeks:
    """Sessions up to the cutoff as days since 1970, and the positions of each week's last one from the start on."""

    days: np.ndarray
    at: np.ndarray

    @staticmethod
    def of(days, cfg: ReviewConfig) -> Weeks:
        number = lambda iso: int(np.datetime64(iso, "D").astype("int64"))
        days = np.unique(np.asarray(days, dtype="int64"))
        days = days[days <= number(cfg.end)]
        week = (days + 3) // 7  # Monday to Sunday
        last = np.flatnonzero(np.append(week[1:] != week[:-1], True)) if len(days) else np.zeros(0, "int64")
        return Weeks(days, last[days[last] >= number(cfg.start)])


def variants(cfg: ReviewConfig) -> list[str]:
    return [f"gbm_w_{lb}_{kind}" for lb in cfg.weekly_lookbacks for kind in ("expected", "prob_up")]


def _cdf(x: np.ndarray) -> np.ndarray:
    z = np.abs(x) / math.sqrt(2.0)
    t = 1.0 / (1.0 + ERF_P * z)
    poly = np.zeros_like(x)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return 0.5 * (1.0 + np.sign(x) * (1.0 - poly * np.exp(-z * z)))


class _Trailing:
    """Counts and growing sums of x along the rows; at(i, b): count, mean and sample deviation after place b up to place i."""

    def __init__(self, x: np.ndarray):
        known = np.isfinite(x)
        x = np.where(known, x, 0.0)
        pad = lambda a: np.concatenate([np.zeros((len(a), 1)), np.cumsum(a, axis=1)], axis=1)
        self.sums = [pad(a) for a in (known.astype(float), x, x * x)]

    def at(self, i: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, b = (np.broadcast_to(np.maximum(p, -1) + 1, (len(self.sums[0]), p.shape[-1])) for p in (i, b))
        n, s1, s2 = (np.take_along_axis(s, i, 1) - np.take_along_axis(s, b, 1) for s in self.sums)
        var = np.maximum(s2 - s1 * s1 / n, 0.0) / (n - 1)
        return n, s1 / n, np.sqrt(np.where(n > 1, var, np.nan))


def _aligned(x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's masked values moved to its start, and the place of the last of them up to each column."""
    place = np.cumsum(mask, axis=1) - 1
    out = np.full(x.shape, np.nan)
    out[np.nonzero(mask)[0], place[mask]] = x[mask]
    return out, place


def _ahead(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """x at the columns; NaN where there is none."""
    return np.where((at >= 0) & (at < x.shape[1]), x[:, np.clip(at, 0, x.shape[1] - 1)], np.nan)


def facts(close: np.ndarray, adj: np.ndarray, volume: np.ndarray, weeks: Weeks, cfg: ReviewConfig, want: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Each wanted fact of a block: tickers by weeks. The inputs are tickers by sessions, NaN without a quote."""
    with np.errstate(all="ignore"):
        at, out = weeks.at, {}
        valid, p = (close > 0) & (adj > 0), np.where(adj > 0, adj, np.nan)
        gone = np.iinfo("int64").max
        nxt = np.append(at[1:], gone)
        out["quoted"] = valid[:, at]
        traded, place = _aligned(close * volume, valid)
        back = place[:, at][:, :, None] - np.arange(19, -1, -1)
        twenty = np.take_along_axis(traded, np.maximum(back, 0).reshape(len(close), -1), 1).reshape(back.shape)
        adv = twenty.sum(axis=2) / 20.0
        out["tradable"] = out["quoted"] & (close[:, at] >= cfg.min_price) & (adv >= cfg.min_adv) & (back[:, :, 0] >= 0)
        own = lambda x: np.where(out["quoted"], x, np.nan)
        out["ret_fwd_1w"] = own(_ahead(p, nxt) / p[:, at] - 1.0)
        out["ret_fwd_1w_lag1"] = own(_ahead(p, np.where(nxt < gone, nxt + 1, gone)) / _ahead(p, at + 1) - 1.0)
        out["ret_fwd_13w"] = own(_ahead(p, at + cfg.mature_sessions) / p[:, at] - 1.0)
        out["momentum"] = _ahead(p, at - cfg.mom_skip) / _ahead(p, at - cfg.mom_lookback) - 1.0
        if {"mu", "sigma", "gbm_expected", *variants(cfg)} & set(want):
            lr = _Trailing(np.concatenate([np.full((len(p), 1), np.nan), np.log(p[:, 1:] / p[:, :-1])], axis=1))
            n, mean, sd = lr.at(at, np.searchsorted(weeks.days, weeks.days[at] - cfg.gbm_days, "right") - 1)
            enough = n >= cfg.gbm_min_obs
            mu, sigma = np.where(enough, mean * cfg.sessions_per_year, np.nan), np.where(enough, sd * math.sqrt(cfg.sessions_per_year), np.nan)
            out["mu"], out["sigma"] = mu, sigma
            if "gbm_expected" in want:
                dt, total = cfg.gbm_years / cfg.gbm_steps, np.zeros_like(mu)
                for i in range(cfg.gbm_steps + 1):
                    total += np.exp(mu * (i * dt))
                out["gbm_expected"] = np.where(np.isnan(sigma), np.nan, total / (cfg.gbm_steps + 1.0) - 1.0)
            for lb in cfg.weekly_lookbacks if set(variants(cfg)) & set(want) else ():
                n, mean, sd = lr.at(at, at - lb)
                mean, sd = (np.where(n >= int(lb * 0.9), x, np.nan) for x in (mean, sd))
                h = cfg.weekly_horizon
                out[f"gbm_w_{lb}_expected"] = np.exp(mean * float(h)) - 1.0
                out[f"gbm_w_{lb}_prob_up"] = np.where(sd > 0, _cdf((mean - 0.5 * sd * sd) * math.sqrt(h) / sd), np.nan)
        if "vol252" in want:
            kept, place = _aligned(p, ~np.isnan(p))
            r = np.concatenate([np.full((len(p), 1), np.nan), np.log(kept[:, 1:] / kept[:, :-1])], axis=1)
            i = place[:, at]
            n, _, sd = _Trailing(r).at(i, i - cfg.sessions_per_year)
            vol = sd * np.sqrt(cfg.sessions_per_year * (n - 1) / n)
            out["vol252"] = np.where(out["tradable"] & (n >= 200), vol, np.nan)
        return {k: out[k] for k in want}


def schema(want: tuple[str, ...]) -> str:
    return "ticker string, date array<date>, " + ", ".join(f"{k} array<{'boolean' if k in ('quoted', 'tradable') else 'double'}>" for k in want)


def as_rows(tickers: list[str], found: dict[str, np.ndarray], weeks: Weeks) -> pa.RecordBatch:
    """A row for each ticker; what is not finite is null."""
    k, w = len(tickers), len(weeks.at)
    ends = pa.array(np.arange(0, k * w + 1, w) if w else np.zeros(k + 1), pa.int32())
    dates = pa.array(np.tile(weeks.days[weeks.at], k).astype("int32"), pa.int32()).cast(pa.date32())
    cols = {"ticker": pa.array(tickers, pa.string()), "date": pa.ListArray.from_arrays(ends, dates)}
    for name, x in found.items():
        flat = x.ravel()
        cols[name] = pa.ListArray.from_arrays(ends, pa.array(flat) if flat.dtype == bool else pa.array(flat, mask=~np.isfinite(flat)))
    return pa.RecordBatch.from_pydict(cols)


def pack(x: np.ndarray) -> bytes:
    """Rows of numbers of 8 bytes, compressed by the place of each byte: high bytes of small numbers cost next to nothing."""
    planes = np.ascontiguousarray(x).view("uint8").reshape(*x.shape, 8).transpose(0, 2, 1)
    return x.shape[1].to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(planes), asbytes=True)


def unpack(blob: pa.Buffer, rows: int, dtype: str) -> np.ndarray:
    """What pack got."""
    n = int.from_bytes(blob[:8].to_pybytes(), "little")
    if not n:
        return np.zeros((rows, 0), dtype)
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], rows * n * 8), "uint8").reshape(rows, 8, n)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype).reshape(rows, n)


def pack_whole(rows: np.ndarray) -> bytes:
    """pack of integers; a row of whole hundreds is kept as hundreds."""
    unit = np.where((rows % 100).any(axis=1), 1, 100)[:, None]
    return pack(np.concatenate([unit, rows // unit], axis=1))


def unpack_whole(blob: pa.Buffer, rows: int) -> np.ndarray:
    """What pack_whole got."""
    found = unpack(blob, rows, "int64")
    return found[:, 1:] * found[:, :1]


def trailing_prices(group: np.ndarray, starts: np.ndarray, sums: list[np.ndarray], span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """close and adj_close by shipping day. Sums of price, quantity and discount in hundredths and of shipments by (ticker, day), in that order;
    group: a ticker's number, starts: where each begins."""
    low = np.maximum(np.arange(len(group)) - span, starts[group] - 1) + 1
    grown = [np.concatenate([[0], np.cumsum(s)]) for s in sums]
    ext, qty, disc, n = ((g[1:] - g[low]).astype(float) for g in grown)
    with np.errstate(all="ignore"):
        close = (ext / 100.0) / (qty / 100.0)
        return close, close * (1.0 - (disc / 100.0) / n)


def as_cells(group: np.ndarray, session: np.ndarray, sums: list[np.ndarray], close: np.ndarray, adj: np.ndarray, weeks: Weeks) -> bytes | None:
    """A block's shipping days, packed, from which from_cells finds facts; None where a day has no price of its own."""
    if not (np.isfinite(adj) & (adj > 0) & np.isfinite(close) & (close > 0)).all():
        return None
    on = session < len(weeks.days)
    code = (group * len(weeks.days) + session)[on]
    return pack_whole(np.stack([np.diff(code, prepend=0), *(s[on] for s in sums)]))


def from_cells(blob: pa.Buffer, tickers: int, tradable: np.ndarray, weeks: Weeks, cfg: ReviewConfig, want: tuple[str, ...]) -> dict[str, np.ndarray]:
    """facts of tradable rows by their names in a grid (r1, r13, score: momentum, vol), bit for bit; NaN elsewhere. Prices change on shipping days only,
    so days between are looked up and not worked out."""
    known, at = len(weeks.days), weeks.at
    code, *sums = unpack_whole(blob, 5)
    group, session = np.divmod(np.cumsum(code), max(known, 1))
    starts = np.searchsorted(group, np.arange(tickers))
    _, p = trailing_prices(group, starts, sums)
    last = np.full((tickers, known), -1)
    last[group, session] = np.arange(len(group))
    last = np.maximum.accumulate(last, axis=1)
    cell = lambda x: np.where((x >= 0) & (x < known), last[:, np.clip(x, 0, known - 1)], -1)
    p = np.append(p, np.nan)  # at -1: no price
    price, out = (lambda x: p[cell(x)]), {}
    with np.errstate(all="ignore"):
        for c in want:
            if c == "r1":
                day = price(at + 1)
                out[c] = np.full(day.shape, np.nan)
                out[c][:, :-1] = day[:, 1:] / day[:, :-1] - 1.0
            elif c == "r13":
                out[c] = price(at + cfg.mature_sessions) / price(at) - 1.0
            elif c == "score":
                out[c] = price(at - cfg.mom_skip) / price(at - cfg.mom_lookback) - 1.0
            elif c == "vol":
                place = np.arange(len(group)) - starts[group]
                r = np.zeros((tickers, int(place.max(initial=-1)) + 2))  # at 0: before the first day
                r[group, place + 1] = np.where(place > 0, np.log(p[:-1] / np.append(np.nan, p[:-2])[: len(group)]), 0.0)
                first = np.full(tickers, known)
                first[group[place == 0]] = session[place == 0]
                i = at - first[:, None]  # a session's place in its ticker's own
                place = np.append(place + 1, 0)
                n = (np.maximum(i, 0) - np.maximum(i - cfg.sessions_per_year, 0)).astype(float)  # of returns: the first session has none
                to, by = place[cell(at)], np.where(i - cfg.sessions_per_year >= 0, place[cell(at - cfg.sessions_per_year)], 0)
                s1, s2 = (np.take_along_axis(g, to, 1) - np.take_along_axis(g, by, 1) for g in (np.cumsum(x, axis=1) for x in (r, r * r)))
                sd = np.sqrt(np.where(n > 1, np.maximum(s2 - s1 * s1 / n, 0.0) / (n - 1), np.nan))
                out[c] = np.where(n >= 200, sd * np.sqrt(cfg.sessions_per_year * (n - 1) / n), np.nan)
    return {k: np.where(tradable & np.isfinite(x), x, np.nan) for k, x in out.items()}


def by_week(facts: DataFrame, *names: str) -> DataFrame:
    """(ticker, date, names): a row for each ticker and week."""
    return facts.select("ticker", F.inline(F.arrays_zip("date", *names)))


def scores(facts: DataFrame, *models: str) -> DataFrame:
    """What scored_panel gives without its cut to completed weeks: tradable rows with a score of each model (strategy)."""
    rows = by_week(facts, "tradable", "ret_fwd_1w_lag1", "ret_fwd_1w", *models).filter("tradable").drop("tradable")
    many: Column = F.explode(F.array(*(F.struct(F.lit(m).alias("strategy"), F.col(m).alias("score")) for m in models)))
    return rows.select("date", "ticker", "ret_fwd_1w_lag1", "ret_fwd_1w", many.alias("x")).select("date", "ticker", "ret_fwd_1w_lag1", "ret_fwd_1w", "x.*").filter("score is not null")
