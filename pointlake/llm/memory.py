"""Gives memory back between partitions, since Spark keeps its Python workers for the next task."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def release() -> None:
    """Frees what is no longer used to the operating system; where the C library has no trim, only Python's and Arrow's part."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for mapInArrow, with a release at the end of each partition."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def collect_garbage(spark: SparkSession) -> None:
    """Has the executors' virtual machines collect all garbage, which returns most of a heap that an earlier step grew to the system.

    A heap grows while a step sorts and aggregates and stays that large, beside the Python workers of the steps after it. One task
    for each core, so that executors that are idle all get some. Where explicit collections are switched off, nothing happens.
    """
    n = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).select(F.call_function("java_method", F.lit("java.lang.System"), F.lit("gc"))).collect()


#: Rows of whole texts in one Arrow batch, on both sides of the pipe.
TEXT_ROWS = 1_000


def text_batches(spark: SparkSession) -> None:
    """Lowers the session's rows in an Arrow batch to TEXT_ROWS, since the default of 10,000 is meant for numbers and not for whole documents."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))
