"""Helpers shared by the training-data operators: tables, scratch storage, Arrow plumbing."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.plans.storage import SMALL_ROWS, Scratch, discard, is_small, scratch_dir, stored  # noqa: F401

#: Rows and bytes that are worked on at once, about, so that Python's copies of long texts stay in memory.
BATCH_ROWS, BATCH_BYTES = 1_000, 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_of(col: Column) -> Column:
    """crc32 of the decimal text of an integer column."""
    return F.crc32(col.cast("string").cast("binary"))


def crc32_text(value: int) -> int:
    return zlib.crc32(str(value).encode())


def share_of_hash(key: Column, share: Column) -> Column:
    """True for about `share` of the keys, chosen by hash: the same rows however the data is partitioned."""
    return F.pmod(F.xxhash64(key, F.lit(20)), F.lit(1 << 30)) < share * F.lit(float(1 << 30))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most BATCH_ROWS rows and about BATCH_BYTES; a row is never split."""
    if batch.num_rows <= BATCH_ROWS and batch.nbytes <= BATCH_BYTES:
        yield batch
        return
    at, rows = 0, max(1, min(BATCH_ROWS, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes)))
    while at < batch.num_rows:
        part = batch.slice(at, rows)
        while part.num_rows > 1 and part.nbytes > BATCH_BYTES:
            part = part.slice(0, part.num_rows // 2)
        yield part
        at += part.num_rows


def bounded(spark: SparkSession) -> None:
    """Sees that Arrow batches of this session hold BATCH_BYTES at most.  It only splits batches, so no result depends on it."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(limit)) <= BATCH_BYTES:
        spark.conf.set(limit, str(BATCH_BYTES))


def released() -> None:
    """Hands memory that a partition no longer needs back to the system, as the worker lives on beside others."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


_LIBC = ctypes.CDLL(None)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """mapInArrow with a function of one slice of bounded rows and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out
                out = None
        released()

    bounded(df.sparkSession)
    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a text column; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def list_array(offsets, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def small_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a frame that must be small; more than `limit` raise instead of filling the driver."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return rows
