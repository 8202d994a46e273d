"""Raster images: Spark's decoder with channels put in order and EXIF orientation applied; RAW by plug-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicat.functions.pixels import jpeg_orientation, upright

DECODED = "source_path string, width int, height int, rgb binary, error string"


def _local(path: str):
    return F.regexp_replace(path, "^file:/+", "/")


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """Upright RGB of every JPEG or PNG below a path; an undecodable one has an error."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(path)
    heads = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("h_path"), F.expr("substring(content, 1, 65536)").alias("head"))
    images = images.select("image.*").withColumn("origin", _local("origin"))  # the readers write file paths differently
    rows = images.join(heads.withColumn("h_path", _local("h_path")), F.col("origin") == F.col("h_path"), "right").select("h_path", "width", "height", "nChannels", "data", "head")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for origin, w, h, channels, data, head in zip(*(c.to_pylist() for c in batch.columns)):
                if not data or not w or w < 1:
                    out.append((origin, None, None, None, "not decodable"))
                    continue
                a = np.frombuffer(data, np.uint8).reshape(h, w, channels)
                rgb = np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, 2::-1]
                rgb = np.ascontiguousarray(upright(rgb, jpeg_orientation(head or b"") or 1))
                out.append((origin, rgb.shape[1], rgb.shape[0], rgb.tobytes(), None))
            types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["source_path", "width", "height", "rgb", "error"])

    return rows.mapInArrow(run, DECODED)


@dataclass(frozen=True)
class SensorLevels:
    """Black and white levels of a sensor plane."""

    black: int
    white: int
    bits: int

    def __post_init__(self) -> None:
        if not 0 <= self.black < self.white or self.white - self.black < 256 or self.white >= 1 << self.bits:
            raise ValueError("levels out of range")


def valid_white_balance(gains: np.ndarray) -> bool:
    """Finite, not negative, and loaded (not all zero)."""
    g = np.asarray(gains, float)
    return bool(np.isfinite(g).all() and (g >= 0).all() and g.any())


def valid_color_matrix(matrix: np.ndarray) -> bool:
    """Finite, no row of zeros, and loaded (not the identity)."""
    m = np.asarray(matrix, float)
    return bool(np.isfinite(m).all() and m.any(1).all() and not (m.shape[0] == m.shape[1] and np.array_equal(m, np.eye(len(m)))))


def read_raw(files: DataFrame, decode: Callable[[str], tuple[int, int, bytes]]) -> DataFrame:
    """RAW files through a plugged-in decoder: path -> (width, height, RGB bytes).

    Sizes that don't fit the bytes, and the decoder's errors, are outcomes of the row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                try:
                    w, h, rgb = decode(path)
                    if len(rgb) != w * h * 3:
                        raise ValueError("size doesn't fit the pixels")
                    out.append((path, w, h, rgb, None))
                except Exception as e:
                    out.append((path, None, None, None, str(e)))
            types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, types)], names=["source_path", "width", "height", "rgb", "error"])

    return files.select("source_path").mapInArrow(run, DECODED)
