"""Skew-safe exact deduplication, native DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, fresh, look_up, materialize, text_of

SALTS = 32


def normalized(text):
    """Every run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


def _digest(text):
    return F.sha2(text, 256)


def groups_of(docs: DataFrame, salts: int = SALTS, digest=_digest) -> DataFrame:
    """(digest, body, keep_id, group_size): one row for each distinct normalised text.

    Local: the partial aggregate of the first groupBy keeps one text per task. Salted: a digest
    is merged in `salts` groups picked by the row's id, so that no task gets all rows of a hot
    text. Global: at most `salts` winners of each text meet. The text itself is part of every
    grouping key, so equality is decided on whole contents each time, never on the digest.
    """
    body = normalized(text_of(docs))
    rows = docs.select(docs["doc_id"], body.alias("body"))
    rows = rows.select("doc_id", "body", digest(F.col("body")).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"))
    salted = rows.groupBy("digest", "salt", "body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    return salted.groupBy("digest", "body").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(docs: DataFrame, salts: int = SALTS, digest=_digest) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest): one row per row of docs.

    Texts are equal when identical after white-space runs become one space; null counts as empty.
    The smallest doc_id of a group stays (null ids come last; a group of null ids only has a null
    keep_id and counts as kept). Rows that repeat a doc_id and its text share one outcome. An empty
    table gives an empty result; other columns are ignored. Two different texts with one digest
    are told apart by their contents: such digests are joined by whole text. Texts of any length count whole.
    A hot text's rows stay where they are: its one row of the merge is broadcast to them.
    """
    body = normalized(text_of(docs))
    rows = docs.select(docs["doc_id"], digest(body).alias("digest"))
    groups = groups_of(docs, salts, digest)
    # Per digest: its only group, or how many there are.
    by_digest = groups.groupBy("digest").agg(
        F.count("*").alias("contents"), F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.sum("group_size").alias("n")
    )
    known = materialize(by_digest.filter((F.col("contents") > 1) | (F.col("group_size") > 1)), "digests")
    found = look_up(rows, known, ["digest"], "known", docs.count()).select("doc_id", "digest", "known.contents", "known.keep_id", "known.group_size")
    plain = found.filter("contents is null or contents = 1").select(
        "doc_id",
        F.when(F.col("contents").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "digest",
    )
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    clash = known.filter("contents > 1").select("digest")
    if clash.isEmpty():
        return plain.select("*", kept)
    # Several contents under one digest: those rows are told apart by whole text.
    texts = docs.select(docs["doc_id"], body.alias("body")).withColumn("digest", digest(F.col("body"))).join(clash, "digest", "left_semi")
    told = groups.join(clash, "digest", "left_semi")
    apart = texts.join(told, ["digest", "body"]).select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "digest")
    return plain.unionByName(apart).select("*", kept)


def keep_first(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """docs without exact copies: of each group one row stays, whole, with its own columns of whatever name.

    The row of the smallest doc_id stays as exact_dedup() says: null counts as the empty text, null ids stay only in
    groups without another id, and of rows that repeat an id and its text one stays. Empty texts are one group,
    texts of any length count whole, an empty table stays empty.
    """
    digest, about = fresh("digest", docs), fresh("about", docs)
    groups = exact_dedup(docs, salts).filter("group_size > 1")
    rows = groups.groupBy("doc_id", "digest").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")).filter("not kept or n > 1")
    known = materialize(rows.withColumnRenamed("digest", digest), "copies")
    keyed = docs.withColumn(digest, _digest(normalized(text_of(docs))))
    out = look_up(keyed, known, ["doc_id", digest], about, docs.count())
    alone = out.filter(F.col(about).isNull())
    if known.filter("kept").isEmpty():
        return alone.drop(digest, about)
    one = out.filter(F.col(f"{about}.kept")).dropDuplicates(["doc_id", digest])  # equal rows: merged before they move
    return alone.unionByName(one).drop(digest, about)


def op5(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body
  FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, h AS text_sha256
FROM d WINDOW g AS (PARTITION BY body)
"""
