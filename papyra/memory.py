"""What Python workers hold: rows that they are handed at a time, and memory that they give back."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes after which a batch of rows that hold megabytes is handed to Python.
BATCH = "4m"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans that run meanwhile hand few rows at a time to Python: one row holds megabytes, and a batch is held by executor and worker, as often as it is copied."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, BATCH)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


_held: dict[str, Callable[[], None]] = {}


def holds(name: str, free: Callable[[], None]) -> None:
    """A worker keeps memory from task to task under this name, until a task of another operator comes."""
    _held[name] = free


def _trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def trimmed(rows: Iterator, keep: str = "") -> Iterator:
    """``rows``; before them, what a worker holds under other names than ``keep`` is freed, and once they are over, memory that it no longer uses goes back to
    the system: workers live on to the next stage. What a worker has imported by its first task is not searched for garbage after each."""
    if not gc.get_freeze_count():
        gc.collect()
        gc.freeze()
    if others := [n for n in _held if n != keep]:
        for name in others:
            _held.pop(name)()
        _trim()
    yield from rows
    _trim()


def by_length(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Slices of batches in which the lists of ``column`` have ``most`` values together, or which have one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        i = before = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(i, j - i)
            i, before = j, int(ends[j - 1])
