"""Bounded Arrow batches for the operators that run Python inside tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_BYTES = 4 << 20
SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bytes per Arrow batch to BATCH_BYTES if they are more.

    A batch is held by the JVM and by the Python worker, on both ways and in every slot of an
    executor; whole texts fill the usual 64 MB. A single longer text still makes its own batch.
    """
    now = spark.conf.get(SETTING, "1g").removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(SETTING, str(BATCH_BYTES))


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def release_memory() -> None:
    """Give freed memory back to the system; Python's workers live on and run other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Run) -> Run:
    """``run`` for ``mapInArrow``, which leaves the worker as small as it was."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return tidied
