"""Bounded memory in the executors' Python workers.

A worker serves one task after another, of whatever operator, so what a task
leaves behind adds up next to the JVM's heap.  Here Arrow batches are kept
small, texts are handed out in pieces of bounded size, and a task gives its
memory back to the system when it ends.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch, where the session doesn't say otherwise.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
#: glibc's mallopt() parameters, with bytes: free memory kept at the heap's top, and size from which a block is mapped (and unmapped) by itself.
_MALLOPT = ((-1, 8 << 20), (-3, 1 << 20))
_settled: list = []


def small_batches(spark: SparkSession) -> None:
    for key, value in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def _libc():
    """glibc, or None on systems without it."""
    if not _settled:
        try:
            libc = ctypes.CDLL("libc.so.6")
            for parameter, value in _MALLOPT:
                libc.mallopt(parameter, value)
            _settled.append(libc)
        except (OSError, AttributeError):
            _settled.append(None)
        pa.set_memory_pool(pa.system_memory_pool())
    return _settled[0]


def tidy(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """``run`` over batches, giving freed memory back when the task ends."""

    @wraps(run)
    def own(batches):
        libc = _libc()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if libc is not None:
                libc.malloc_trim(0)

    return own


def map_batches(df: DataFrame, run: Callable[[Iterable], Iterator], schema) -> DataFrame:
    """``df.mapInArrow`` with small batches and a tidy worker."""
    small_batches(df.sparkSession)
    return df.mapInArrow(tidy(run), schema)


def pieces(batches: Iterable[pa.RecordBatch], size: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of that column: large ones are sliced, small ones joined; one longer text is a piece of its own."""
    held, n = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(lengths):
            upto = np.cumsum(lengths[at:])
            take = int(np.searchsorted(upto, size - n, "right"))
            if take == 0 and not held:
                take = 1
            if take:
                held.append(batch.slice(at, take))
                n += int(upto[take - 1])
                at += take
            if at < len(lengths):
                yield _joined(held)
                held, n = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
