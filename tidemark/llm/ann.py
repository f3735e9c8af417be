"""Approximate nearest neighbours by cross-polytope hashing with multiprobe and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: Tables, hashes of a table's key, and cells of each table that a query looks into.
TABLES = 10
HASHES = 1
PROBES = 12
#: Times as many probes where lengths differ: one more coordinate may double the cells and flattens the angles.
LONGER = 4
#: Vectors and queries of a cell that one task compares at once; larger cells are split into a grid.
BLOCK_ROWS = 4096
BLOCK_QUERIES = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        y = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return x


def rotations(dim: int, count: int, seed: int = 1) -> np.ndarray:
    """Signs of `count` pseudo-rotations: three diagonals each."""
    width = 1 << max(0, dim - 1).bit_length()
    return np.random.default_rng([seed, dim]).choice(np.array([-1.0, 1.0]), (count, 3, width))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """H D3 H D2 H D1 x, scaled as a rotation; x is padded with zeros to a power of two."""
    width = signs.shape[1]
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    for d in signs:
        y = hadamard(y * d) / np.sqrt(width)
    return y


def cells(x: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """(rows, tables, probes) cell numbers, best first. A hash is the nearest of the 2 width signed axes.

    A cell joins `hashes` of them; its rank is the sum of the projections on the axes chosen.
    """
    signs = rotations(x.shape[1], tables * hashes)
    out = []
    for t in range(tables):
        score, cell = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
        for h in range(hashes):
            y = rotate(x, signs[t * hashes + h])
            axes = np.concatenate([y, -y], axis=1)
            many = axes.shape[1]
            joined = (score[:, :, None] + axes[:, None, :]).reshape(len(x), -1)
            keep = min(joined.shape[1], max(probes, 1))
            best = np.argpartition(-joined, keep - 1, axis=1)[:, :keep]
            score = np.take_along_axis(joined, best, axis=1)
            order = np.argsort(-score, axis=1, kind="stable")
            best, score = np.take_along_axis(best, order, axis=1), np.take_along_axis(score, order, axis=1)
            cell = np.take_along_axis(cell, best // many, axis=1) * many + best % many
        out.append(cell[:, :probes])
    return np.stack(out, axis=1)


def nearest(q: np.ndarray, own: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query, rows, scores) of each query's k largest inner products among v, ties to smaller ids, own id left out.

    The matrix product selects; scores are then summed in one fixed order, so equal vectors score alike
    in every block.
    """
    products = q @ v.T
    out = []
    for i in range(len(q)):
        row = products[i]
        open_ = ids != own[i]
        row = np.where(open_, row, -np.inf)
        if len(row) > k:
            least = np.partition(row, len(row) - k)[len(row) - k]
            pick = np.flatnonzero((row >= least - 1e-9 * max(1.0, abs(least) if np.isfinite(least) else 1.0)) & open_)
        else:
            pick = np.flatnonzero(open_)
        scores = (v[pick] * q[i]).sum(axis=1)
        order = np.lexsort((ids[pick], -scores))[:k]
        out.append((i, pick[order], scores[order]))
    return out


def _hashed(vectors: DataFrame, tables: int, hashes: int, probes: int, id_kind: str, longest: float | None, asks: bool) -> DataFrame:
    """(id, dim, vec as float64 bytes, cells, per): cells flat, table by table, `per` of them each.

    Cells go by angle. Where lengths differ, rows get one more coordinate that brings all of them to the longest
    length and queries a zero there: angles then order rows by inner product.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            dims = np.asarray(lists.value_lengths())
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                own = lists.take(pa.array(at))
                x = np.asarray(own.flatten(), dtype=np.float64).reshape(len(at), dim)
                most = np.abs(x).max(axis=1, keepdims=True)
                unit = x / most
                size = np.linalg.norm(unit, axis=1, keepdims=True)
                unit /= size
                if longest:
                    share = np.ones_like(size) if asks else np.minimum(1.0, most * size / longest)
                    unit = np.concatenate([unit * share, np.sqrt(1.0 - share * share)], axis=1)
                for lo in range(0, len(at), 2048):
                    part = slice(lo, lo + 2048)
                    found = cells(unit[part], tables, hashes, probes)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("id").take(pa.array(at[part])),
                            pa.array(np.full(len(found), dim, np.int32)),
                            pa.array([r.tobytes() for r in x[part]], pa.binary()),
                            pa.array(list(found.reshape(len(found), -1)), pa.list_(pa.int64())),
                            pa.array(np.full(len(found), found.shape[2], np.int32)),
                        ],
                        names=["id", "dim", "vec", "cells", "per"],
                    )

    return vectors.mapInArrow(run, f"id {id_kind}, dim int, vec binary, cells array<long>, per int")


def search(
    vectors: DataFrame, is_query, k: int = 20, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES,
    block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row, by largest inner product in double.

    is_query is a condition on vectors. Each vector, with a length coordinate where lengths differ, lies in one cell of each table; a query looks into its
    `probes` best cells of each (LONGER times as many with that coordinate) and all their vectors are compared exactly, in blocks: a cell with more than
    block_rows vectors or block_queries queries is split by hash into a grid of tasks, none left out. The
    nearest found so far of each block are merged by query. A query that finds fewer than k that way is compared
    with all vectors of its dimension. Raise `hashes` with the logarithm of the rows to
    keep cells small, and `tables` or `probes` for recall. Vectors that are null, empty, zero or hold null or
    non-finite components take no part; vectors of other dimensions are not compared with each other; all
    rows with the query's own id are left out; a repeated id is reported once, by its best score. Queries
    with no candidate have no row. Null ids take no part. An empty table gives an empty result.
    """
    v = F.col("v")
    valid = F.col("v").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    chosen = vectors.select(vectors[id_col].alias("id"), vectors[vec_col].cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    chosen = chosen.filter(valid & F.col("id").isNotNull())
    kind = vectors.schema[id_col].dataType.simpleString()
    largest = F.array_max(F.transform(v, F.abs))
    length = largest * F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x / largest) * (x / largest)))
    stats = chosen.agg(F.min(length).alias("least"), F.max(length).alias("most"), F.count("*").alias("n")).first()
    uneven = stats.n > 0 and stats.least < 0.99 * stats.most < float("inf")
    longest = stats.most if uneven else None
    rows = materialize(_hashed(chosen, tables, hashes, 1, kind, longest, False), "cells")
    asks = materialize(_hashed(chosen.filter("q"), tables, hashes, LONGER * probes if uneven else probes, kind, longest, True), "probes")
    at_row = rows.select("id", "vec", "dim", F.posexplode("cells").alias("tbl", "cell"))
    asked = asks.select("id", "vec", "dim", "per", F.posexplode("cells").alias("nth", "cell"))
    at_ask = asked.select("id", "vec", "dim", "cell", F.floor(F.col("nth") / F.col("per")).cast("int").alias("tbl"))
    key = ["dim", "tbl", "cell"]
    n_rows = at_row.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(float(block_rows))).cast("int").alias("row_blocks"))
    n_asks = at_ask.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(float(block_queries))).cast("int").alias("ask_blocks"))
    grid = materialize(n_rows.join(n_asks, key), "grid")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = at_row.join(grid, key).select(*key, "id", "vec", own("row_blocks").alias("rb"), every("ask_blocks").alias("ab"))
    right = at_ask.join(grid, key).select(*key, "id", "vec", own("ask_blocks").alias("ab"), every("row_blocks").alias("rb"))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        dim = int(a["dim"].iloc[0])
        vs, qs = (np.frombuffer(b"".join(x["vec"]), np.float64).reshape(len(x), dim) for x in (a, b))
        ids, own_ids = a["id"].to_numpy(), b["id"].to_numpy()
        found = nearest(qs, own_ids, vs, ids, k)
        return pd.DataFrame(
            {
                "query_id": np.repeat(own_ids, [len(p) for _, p, _ in found]),
                "vec_id": ids[np.concatenate([p for _, p, _ in found])],
                "score": np.concatenate([s for _, _, s in found]),
            }
        )

    cell = [*key, "rb", "ab"]
    meet = lambda a, b: a.groupBy(*cell).cogroup(b.groupBy(*cell)).applyInPandas(compare, f"query_id {kind}, vec_id {kind}, score double")
    once = lambda pairs: pairs.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    found = materialize(once(meet(left, right)), "nearest")
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("id"))
    short = materialize(asks.select("id", "vec", "dim").join(full, "id", "left_anti"), "short")
    if not short.isEmpty():  # their probed cells hold too few: all rows of their dimension, in one grid
        whole = lambda df: df.select("id", "vec", "dim", F.lit(-1).alias("tbl"), F.lit(-1).cast("long").alias("cell"))
        blocks = lambda most: F.ceil(F.count("*") / F.lit(float(most))).cast("int")
        n_rows = rows.groupBy("dim").agg(blocks(block_rows).alias("row_blocks"))
        all_ = n_rows.join(short.groupBy("dim").agg(blocks(block_queries).alias("ask_blocks")), "dim")
        left = whole(rows).join(all_, "dim").select(*key, "id", "vec", own("row_blocks").alias("rb"), every("ask_blocks").alias("ab"))
        right = whole(short).join(all_, "dim").select(*key, "id", "vec", own("ask_blocks").alias("ab"), every("row_blocks").alias("rb"))
        found = once(found.unionByName(meet(left, right)))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op4(vectors: DataFrame) -> DataFrame:
    """The contract's columns."""
    out = search(vectors, vectors["vec_id"] % 20 == 0)
    return out.withColumns({"query_id": F.col("query_id").cast("long"), "vec_id": F.col("vec_id").cast("long")})
