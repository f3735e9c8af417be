"""Drift monitoring of a stream: an extension, which the reviewed application does not have.

Bucket counts are additive, so they are kept by event-time window and bucket with a watermark; the index
follows from the counts of a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.monitoring import FLOOR


def bucket_counts(rows: DataFrame, time: str, value: str, edges: list[float], window: str, late: str = "1 day") -> DataFrame:
    """(window, bucket, n) of a batch or a stream; an edge's own value is in the upper bucket."""
    bucket = sum(((F.col(value) >= e).cast("int") for e in edges), F.lit(0))
    stamped = rows.filter(F.col(value).isNotNull()).withColumn("at", F.col(time).cast("timestamp"))
    return stamped.withWatermark("at", late).groupBy(F.window("at", window), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def psi_of_counts(counts: DataFrame, expected: dict[int, float]) -> DataFrame:
    """(window, n, psi) from bucket counts and the expected shares of all buckets."""
    hit = lambda k: F.coalesce(F.sum(F.when(F.col("bucket") == k, F.col("n"))), F.lit(0)) / F.sum("n")
    psi = F.lit(0.0)
    for k, share in expected.items():
        a, e = F.greatest(hit(k), F.lit(FLOOR)), max(share, FLOOR)
        psi = psi + (a - e) * F.log(a / e)
    return counts.groupBy("window").agg(F.sum("n").alias("n"), psi.alias("psi"))
