"""Shared plumbing: scratch tables, and the workers' import path."""

from __future__ import annotations

import contextlib
import ctypes
import functools

from pyspark.sql import DataFrame, SparkSession

from ..common import drop as drop, importable, keep as keep, scratch as scratch

#: Bounds of Arrow batches where nobody has set them: Spark's 10,000 rows and 64 MB of long texts fill an executor.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def workers(spark: SparkSession) -> None:
    """Let Python workers import this package where only the driver's sys.path names it, and bound Arrow batches (BATCHES)
    where neither the session nor its context does."""
    have = spark.conf.getAll
    for key, value in BATCHES.items():
        if key not in have:
            spark.conf.set(key, value)
    importable(spark)


def _give_back() -> None:
    """Return freed memory to the system: idle workers are kept, and what they held stays counted against an executor."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """``run`` (batches to batches) for an Arrow task, giving freed memory back every few batches and at the end."""

    @functools.wraps(run)
    def task(batches):
        try:
            for i, b in enumerate(run(batches)):
                yield b
                if i % 16 == 15:
                    _give_back()
        finally:
            _give_back()

    return task


def only(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns alone, cast to the given types; other columns (whatever their names) play no part."""
    return df.select(*[df[f"`{c}`"].cast(k).alias(c) for c, k in kinds.items()])


def numbered(df: DataFrame, *named: str) -> DataFrame:
    """``df`` with its columns called c0, c1, ... so that no name can clash; those in ``named`` keep theirs."""
    return df.toDF(*[c if c in named else f"c{i}" for i, c in enumerate(df.columns)])
