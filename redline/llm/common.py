"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redline.session import ship_package
from redline.sources.scratch import scratch_path

#: ASCII white space that separates words: space and 0x09-0x0D.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text: maximal runs of characters other than ASCII white space (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE_RE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and bind it to the lambda variable of ``body``."""
    return F.transform(F.array(value), body)[0]


#: Pages and row groups are bounded in bytes, however long the rows: readers hold whole pages.
SMALL_PAGES = {"parquet.page.size.row.check.min": 4, "parquet.block.size.row.check.min": 4, "parquet.block.size": 64 << 20}


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` once as Parquet into the cluster's shared scratch folder and read it back.

    Cuts the lineage (a lost executor does not recompute the upstream stages) and keeps columns
    prunable for each later reader."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**(SMALL_PAGES | options)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_WORKER_STATE: dict = {}


def _give_back() -> None:
    """Hands freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def worker_state(key, make):
    """What an operator's tasks keep in their Python worker (caches, automata).

    A worker lives on from task to task; it holds the state of one operator at a time, so what a
    stage has gathered is given back when the next stage's first task starts."""
    if key not in _WORKER_STATE:
        _WORKER_STATE.clear()
        _give_back()
        _WORKER_STATE[key] = make()
    return _WORKER_STATE[key]


#: Texts are worked on in runs of about so many bytes.
RUN_BYTES = 2 << 20


def runs(texts, most: int = RUN_BYTES):
    """Positions [a, b) of consecutive values of an Arrow binary array, of about ``most`` bytes
    together (one value at least)."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)) if len(texts) else ()
    ends = np.cumsum(sizes, dtype=np.int64)
    a = done = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield a, b
        a, done = b, int(ends[b - 1])


#: Most bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 8 << 20


def begin(spark: SparkSession) -> None:
    """Called by every operator that works in Python, and by every query: the workers get the
    package, and batches are bounded in bytes unless the session says how."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":      # Spark's default
        spark.conf.set(key, str(BATCH_BYTES))


def release(spark: SparkSession) -> None:
    """Called between the stages of a pipeline: a full collection on the driver lets Spark drop what
    finished jobs leave (broadcasts, shuffle files, plans), and the heap shrinks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
