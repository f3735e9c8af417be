"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import ann, chat, exact, mixing, packing, quality, secret_scan, simhash, toxicity, urls
from tidemark.llm.common import read


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda s, d: read(s, d, "documents")
    labels = lambda s, d: read(s, d, "labels")
    return {
        "op1_simhash": lambda s, d: simhash.op1(docs(s, d)),
        "op2_quality": lambda s, d: quality.op2(docs(s, d), labels(s, d)),
        "op3_toxicity": lambda s, d: toxicity.op3(docs(s, d), labels(s, d)),
        "op4_ann": lambda s, d: ann.op4(read(s, d, "embeddings")),
        "op5_exact": lambda s, d: exact.op5(docs(s, d)),
        "op6_chat": chat.op6,
        "op7_packing": lambda s, d: packing.op7(docs(s, d)),
        "op8_urls": urls.op8,
        "op9_mixing": lambda s, d: mixing.op9(docs(s, d)),
        "op10_secrets": lambda s, d: secret_scan.op10(docs(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can express the query; the others are tested against brute force."""
    return {"op5_exact": exact.SQL, "op6_chat": chat.SQL, "op8_urls": urls.SQL, "op9_mixing": mixing.SQL}
