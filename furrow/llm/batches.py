"""Small Arrow batches while whole texts, which are large rows, are handed to Python, and workers that keep no memory."""

from __future__ import annotations

import ctypes
import functools
import inspect
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

#: Texts in a batch.
BATCH = 200
_NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH) -> Iterator[None]:
    """Batches of at most so many rows for the jobs that run inside; the session's own setting comes back."""
    before = spark.conf.get(_NAME)
    spark.conf.set(_NAME, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_NAME, before)


def give_back() -> None:
    """Memory that is free in this process goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(function: Callable) -> Callable:
    """The function, and then ``give_back``: of batches at their end, else after each call.

    Spark keeps idle Python workers and takes them in turn, so what each one's largest task left free would add up.
    """

    @functools.wraps(function)
    def batched(batches):
        yield from function(batches)
        give_back()

    @functools.wraps(function)
    def called(first, *more):  # Spark counts the arguments of functions of groups
        made = function(first, *more)
        give_back()
        return made

    return batched if inspect.isgeneratorfunction(function) else called
