"""Small helpers for functions that work on Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that Spark hands to Python; bounds the worker's memory.
BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Have Spark cut Arrow batches by bytes too, so that long texts do not pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def free(spark: SparkSession) -> None:
    """Collect garbage here and in the driver's JVM: Spark's cleaner then removes the files of shuffles that no query reads again."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Hand memory that was freed back to the system: a worker stays for later tasks, of other stages too, and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of a task's batches that gives memory back when it ends."""

    @wraps(run)
    def out(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return out


def columnwise(kind: str) -> Callable[[Callable[[pa.Array], pa.Array]], Callable]:
    """Makes a function of an array a function of a column of `kind`; memory is given back when a task ends."""

    def made(of: Callable[[pa.Array], pa.Array]) -> Callable:
        @F.arrow_udf(kind)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from tidy(lambda b: map(of, b))(batches)

        return run

    return made


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring rows of at most `most` bytes; a longer row stands alone."""
    lo, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def packed(parts: list[bytes | None]) -> pa.Array:
    return pa.array(parts, pa.binary())
