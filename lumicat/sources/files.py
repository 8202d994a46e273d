"""Files as tables: a walk on the driver, file facts and content ids on the executors."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumicat import config as C
from lumicat.functions import scalars as S

FOUND = StructType().add("found_size", "long").add("found_mtime", "long").add("found_id", "string").add("found_error", "string")


def walk(root: str, skip_dirs: tuple[str, ...] = (C.DEFAULT.catalog_dir,), prune: str | None = None, sort: bool = False, on_error: Callable[[OSError], None] | None = None) -> Iterator[str]:
    """Regular files below ``root``, hidden ones included; links aren't followed, unreadable folders are
    passed to ``on_error`` or dropped. ``prune``: a subtree to leave out, as the output folder."""
    cut = os.path.realpath(prune) if prune else None
    for folder, dirs, names in os.walk(root, onerror=on_error, followlinks=False):
        dirs[:] = [d for d in dirs if d not in skip_dirs and os.path.realpath(os.path.join(folder, d)) != cut]
        if sort:
            dirs.sort()
            names.sort()
        for name in names:
            path = os.path.join(folder, name)
            if os.path.isfile(path) and not os.path.islink(path):
                yield path


def paths(spark: SparkSession, root: str, **options) -> DataFrame:
    """The walk as a table. The list of paths is what the driver holds."""
    found = [(p,) for p in walk(root, **options)]
    df = spark.createDataFrame(found, "source_path string")
    return df.repartition(max(1, min(len(found), 4 * spark.sparkContext.defaultParallelism)))


def ingestible(files: DataFrame) -> DataFrame:
    return files.where(S.is_ingestible(F.col("source_path")))


def clamp(seconds: int) -> int:
    return max(C.MTIME_MIN, min(C.MTIME_MAX, seconds))


def derive_id(path: str, size: int, mtime: int) -> str:
    """As functions.scalars.content_id, reading only the first and the last 64 KiB, which never overlap."""
    if size == 0:
        raise ValueError("an empty file has no id")
    h = hashlib.sha256(size.to_bytes(8, "little") + clamp(mtime).to_bytes(8, "little", signed=True))
    with open(path, "rb") as f:
        head = f.read(C.WINDOW_BYTES)
        h.update(head)
        start = max(size - C.WINDOW_BYTES, len(head))
        f.seek(start)
        h.update(f.read(size - start))
    return h.hexdigest()


def with_facts(rows: DataFrame, path: str = "source_path", derive: bool = True) -> DataFrame:
    """Rows with found_size, found_mtime, found_id and found_error of the file each ``path`` names.

    found_error: null, file_missing, zero_bytes (derive only) or derive_failed with a reason. Without
    ``derive`` files are only looked up, not read. No shuffle: the columns pass through.
    """
    at = rows.columns.index(path)
    schema = StructType(rows.schema.fields + FOUND.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name in batch.column(at).to_pylist():
                size = mtime = digest = error = None
                try:
                    st = os.stat(name)
                    size, mtime = st.st_size, int(st.st_mtime)
                    digest = derive_id(name, size, mtime) if derive else None
                except FileNotFoundError:
                    error = "file_missing"
                except (OSError, ValueError, TypeError) as e:
                    error = "zero_bytes" if size == 0 else f"derive_failed: {e}"
                found.append((size, mtime, digest, error))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            extra = [pa.array(c, t) for c, t in zip(list(zip(*found)) or [()] * 4, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=schema.names)

    return rows.mapInArrow(run, schema)


def facts(files: DataFrame) -> DataFrame:
    """Size, mtime and content id of each path; ``error`` says why there is no id."""
    found = with_facts(files.select("source_path"))
    return found.toDF("source_path", "file_size", "mtime", "content_id", "error")


def absolute(path: str, root: str) -> str:
    """The canonical path; an error if it has a NUL or leaves the root."""
    if "\0" in path:
        raise ValueError("a path can't hold NUL")
    real, base = os.path.realpath(path), os.path.realpath(root)
    if real != base and not real.startswith(base.rstrip("/") + "/"):
        raise ValueError(f"{path} is outside {root}")
    return real
