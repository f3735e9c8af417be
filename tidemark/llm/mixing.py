"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, look_up, materialize, text_of, word_count

#: Weights dealt to the sources in order, the share of all words to take, and the most copies of a source.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
#: Bits of the hash that the extra copy's probability is compared with.
HASH_BITS = 32


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The columns of sizes and target, from one row for each source: source, source_size.

    The k-th source by code point (null last) weighs weights[k % len(weights)]. The targets share
    `share` of all words by weight; a target stops at `most` times its source's size and the excess
    goes to the others by weight until none is above. That fixed point is target = min(cap, level *
    weight) with one level for all; sources reach their caps in the order of cap / weight, so the
    level follows from running sums over the sorted sources, without a loop.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    deal = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    capped = sizes.withColumn("w", deal).withColumn("cap", most * F.col("source_size"))
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = up.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    # The level once the sources before are at their caps; the first that stays under its cap sets it for the rest.
    tried = capped.withColumn("level", level).withColumn("under", F.col("level") * F.col("w") < F.col("cap"))
    final = F.min(F.when(F.col("under"), F.struct(F.col("cap") / F.col("w"), "source", "level"))).over(everything)["level"]
    return tried.select(*sizes.columns, F.least(F.col("cap"), F.coalesce(final * F.col("w"), F.col("cap"))).alias("target"))


def _hash(doc_id, seed: str):
    """32 bits of a hash of the id."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def goals(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n, target, whole, fraction): one row for each source, written to the shared folder.

    n is the source's documents. rate = target / source_size: every document is taken whole = floor(rate)
    times, and once more with probability fraction = rate - floor(rate).
    """
    rows = docs.select(docs["source"], word_count(text_of(docs)).alias("size"))
    sums = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sizes")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    aims = targets(sums, weights, share, most).withColumns({"whole": F.floor(rate), "fraction": rate - F.floor(rate)})
    return materialize(aims, "goals")


def _with_copies(docs: DataFrame, plan: DataFrame, name: str, seed: str) -> tuple[DataFrame, Column]:
    """docs with a struct column `name`, its source's row of the plan, and how often the mix takes a row.

    The one extra copy is drawn by the hash of the seed and the id, which falls below a fraction of its range with
    that probability. Hot sources are looked up where their documents are, so no task gets all of a source.
    """
    total = plan.agg(F.sum("n")).first()[0] or 0
    met = look_up(docs, plan, ["source"], name, total)
    extra = _hash(docs["doc_id"], seed) < F.col(f"{name}.fraction") * F.lit(float(1 << HASH_BITS))
    return met, F.col(f"{name}.whole") + extra.cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of docs.

    size is the number of words of the whole text (null text: 0). Reruns agree: copies depend on the id's hash and
    the sums of the sources alone. Sources without words have target 0 and their documents are taken 0 times. Null
    sources form one source, null ids hash as one id, rows that repeat an id share its copies. Sources that tie in
    target / weight are ordered by name. An empty table gives an empty result; other columns are ignored.
    """
    out, copies = _with_copies(docs.select("doc_id", "source", "text"), goals(docs, weights, share, most), "plan", seed)
    return out.select(
        "doc_id", "source", word_count(F.coalesce("text", F.lit(""))).alias("size"), F.col("plan.source_size").alias("source_size"),
        F.col("plan.target").alias("target"), copies.alias("copies"),
    )


def op9(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    out = mix(docs)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def emit(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix") -> DataFrame:
    """docs with every row repeated as often as mix() takes it, with the same rules for nulls, repeats and ties.

    Its columns, of whatever name, are unchanged; rows without words are emitted like any other of their source.
    """
    name, each = fresh("plan", docs), fresh("copy", docs)
    out, copies = _with_copies(docs, goals(docs, weights, share, most), name, seed)
    return out.select(*(docs[c] for c in docs.columns), F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias(each)).drop(each)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS hv
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
c AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
             2.0::DOUBLE * source_size AS cap FROM s),
t AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
l AS (SELECT level AS final FROM t WHERE level * w < cap ORDER BY cap / w, source NULLS LAST LIMIT 1),
g AS (SELECT source, source_size, least(cap, coalesce((SELECT final FROM l) * w, cap)) AS target FROM t),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM g)
SELECT doc_id, size, source_size, target,
       size * (floor(rate) + CASE WHEN hv < (rate - floor(rate)) * 4294967296::DOUBLE THEN 1 ELSE 0 END)::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
