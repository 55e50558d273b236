"""Shared plumbing: table access, shared storage and raw access to Arrow strings."""

from __future__ import annotations

import ctypes
import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandline.sources import shared
from strandline.sources.shared import Scratch

__all__ = ["Scratch", "bounded_batches", "is_held_out", "materialise", "row_blocks", "strings", "table", "trimmed", "utf8"]

BATCH_ROWS, BATCH_BYTES = 2_000, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(spark: SparkSession, df: DataFrame) -> DataFrame:
    return shared.materialise(df)


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous large_string array, nulls as empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts in them (one more offset than rows)."""
    column = strings(column)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def row_blocks(offsets: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes; a longer row is alone."""
    out, start, n = [], 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        out.append((start, min(stop, n)))
        start = stop
    return out


#: Caches whose values outlive the tasks of this worker.
_kept: list[Callable] = []


def _keep_only(cache: Callable | None) -> None:
    """Empty the caches that former tasks of this worker left, but for ``cache``."""
    for other in _kept:
        if other is not cache:
            other.cache_clear()
    _kept[:] = [] if cache is None else [cache]


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], cache: Callable | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over batches that gives freed memory back at its end, as Python workers live on between tasks.

    What ``cache``, an lru_cache, holds stays for the worker's next tasks of this kind; a task of another kind drops it."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_only(cache)
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return wrapped


def bounded_batches(spark: SparkSession) -> None:
    """Let this session send ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` at most to Python at once, as JVM and worker both hold whole batches."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        known = (spark.conf.get(name) or "").lower().removesuffix("b")
        if not (known.isdigit() and 0 < int(known) <= most):
            spark.conf.set(name, most)


def is_held_out(doc_ids: list[int | None]) -> list[bool]:
    """crc32 of the decimal doc_id, modulo 4, is 2; a null id is not held out."""
    return [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in doc_ids]
