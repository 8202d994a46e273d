"""Helpers shared by the training-data operators: remote files, byte words, bounded chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicat.scratch import delete_path, discard, materialise, scratch_path  # noqa: F401  (used by the operators)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: ASCII bytes that are no part of an alphanumeric word become spaces; bytes of 0x80 and
#: more (any non-ASCII character in UTF-8) stay, so bytes.split() yields the words
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a text whose A-Z were lower-cased.
ALNUM_TABLE = bytes(
    b if b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" else 0x20 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lowered(col: Column) -> Column:
    """Text with A-Z (only) lower-cased; null becomes empty."""
    return F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER)


def open_fs(uri: str):
    """(file system, path) of a URI or absolute path, usable from executors."""
    from pyarrow import fs

    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    if uri.startswith("file:"):
        uri = uri[len("file:") :]
    return fs.LocalFileSystem(), uri


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def frugal(run: Callable) -> Callable:
    """``run`` for mapInArrow, after which the worker gives back the memory that its allocators still hold.

    Workers live on for other tasks, and several share an executor's memory.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def release_memory() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def byte_chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose ``column`` holds about ``limit`` bytes, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
