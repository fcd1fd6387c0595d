"""Shared pieces of the training-data operators: table access, scratch storage and stable digests."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources import storage
from lodestar.sources.storage import drop, scratch, shared_dir  # noqa: F401

#: Rows of an Arrow batch where the session leaves that open: texts can be long, and a batch lies in memory in the JVM and in its worker.
BATCH_ROWS = 1000

#: A word of the query contracts: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def unit_interval(*cols: Column) -> Column:
    """A uniform double in (0, 1) that is a function of the columns alone: 52 bits of a 64-bit hash."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 12).cast("double") + 0.5) / F.lit(float(1 << 52))


def ship_package(spark: SparkSession) -> None:
    """Gives the workers this package, and the session a bound of batches if it has none of its own."""
    storage.ship_package(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # Spark's own default
        spark.conf.set(name, str(BATCH_ROWS))


def release() -> None:
    """Gives what this worker process no longer uses back to the system: idle workers stay beside later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A map over batches that releases its memory at the end of each task."""

    def go(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return go
