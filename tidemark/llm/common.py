"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache, reduce
from operator import and_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the query contracts name it, for Java and Python patterns.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``.

    Where none is named, a new local one is set on a single machine (tests); a cluster is refused, as its
    executors would write to disks of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Cuts the lineage and computes df once for all its readers. The files survive
    the loss of any executor and go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, *frames: DataFrame) -> str:
    """The name, with underscores in front until no frame has a column of that name (in any case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: A key of look_up() is hot with more than one in so many rows, and at least as many rows: there are fewer hot keys than this.
HOT = 1000


def look_up(rows: DataFrame, known: DataFrame, keys: list[str], name: str, total: int, count: str = "n", how: str = "left") -> DataFrame:
    """rows with a struct column `name`: the row of known that has their keys, null where there is none (inner: no such rows).

    known is a written table with one row for each of its keys; `count` tells how many of the `total` rows carry
    the key. Fewer than HOT keys have more than a HOT-th of all rows: these are broadcast, so their rows stay where
    they are, and any other key is a small part of a shuffle. Null keys are equal.
    """
    side = known.select(F.struct(*known.columns).alias(name))
    same = lambda: reduce(and_, (rows[k].eqNullSafe(F.col(f"{name}.{k}")) for k in keys))
    hot = F.col(f"{name}.{count}") * F.lit(HOT) > F.lit(max(total, HOT * HOT))
    if side.filter(hot).isEmpty():
        return rows.join(side, same(), how)
    few = F.broadcast(side.filter(hot))
    return rows.join(few, same()).unionByName(rows.join(few, same(), "left_anti").join(side.filter(~hot), same(), how))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(docs: DataFrame, col: str = "text"):
    """The text column with null as the empty text."""
    return F.coalesce(docs[col].cast("string"), F.lit(""))


def word_count(text):
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs, counted by the JVM."""
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long")


#: Bytes of text that a Python worker turns into strings at once, or one text if it is longer.
PIECE = 2 << 20


#: Rows and bytes of an Arrow batch between the JVM and Python, which both hold it whole.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def bounded(docs: DataFrame) -> DataFrame:
    """docs, whose session sends small Arrow batches unless it names sizes of its own: texts are long."""
    conf = docs.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs


def pieces(batch: pa.RecordBatch, *texts: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most PIECE bytes of text each, one row at least: long texts do not add up."""
    size = sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False) for c in texts or ("text",))
    at = 0
    while at < len(size):
        end, room = at + 1, PIECE - size[at]
        while end < len(size) and room >= size[end]:
            room -= size[end]
            end += 1
        yield batch.slice(at, end - at)
        at = end
    pa.default_memory_pool().release_unused()  # a worker serves many stages; what it keeps adds up


#: Cached functions whose memory a worker keeps from task to task, by the operator that has it.
MEMORIES: dict[str, Callable] = {}


@cache
def _trim() -> Callable:
    """glibc's call that gives freed memory back to the system; elsewhere a function that does nothing."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def begin(own: str = "") -> None:
    """At the start of a task: what operators other than `own` keep in this worker goes."""
    for name, kept in MEMORIES.items():
        if name != own:
            kept.cache_clear()


def end() -> None:
    """At the end of a task: memory that this worker no longer uses goes back to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def give_back(spark: SparkSession) -> None:
    """Executors collect their garbage in full, so their heaps shrink to what lives and direct buffers that nothing holds go.

    A task does it for its own executor; tasks of equal rank are dealt out evenly. Results do not depend on it. The workers that
    Python tasks use give memory back on their own (end).
    """
    sc = spark.sparkContext
    n = max(1, sc.defaultParallelism)
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list[str]], dict]], types: dict[str, pa.DataType], schema: str) -> DataFrame:
    """doc_id and what a function of a batch of texts returns: one row per row of docs.

    make() is called once in each task and returns the function, which maps a list of texts (null as
    empty) to a list for each name in types; schema is the same as a Spark DDL string. Ids pass through
    Arrow untouched, so null ids do not turn long ids into floats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        of = make()
        for whole in batches:
            for batch in pieces(whole):
                out = of(batch.column("text").to_pylist())
                arrays = [pa.array(out[name], kind) for name, kind in types.items()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *types])
        del of
        end()

    rows = bounded(docs).select(docs["doc_id"], text_of(docs).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")
