"""Model files: verified against a manifest on the driver, broadcast, and run by pluggable scorers."""

from __future__ import annotations

import hashlib
import tomllib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


class Scorer(Protocol):
    """Made once for each Python worker from the model's bytes; scores preprocessed images."""

    def __call__(self, pixels: np.ndarray) -> np.ndarray: ...


def verified_bytes(folder: str, name: str) -> bytes:
    """The bytes of a model of ``manifest.toml``, or an error unless their SHA-256 is the manifest's."""
    with open(f"{folder}/manifest.toml", "rb") as f:
        section = tomllib.load(f).get(name)
    if not section or "file" not in section or "sha256" not in section:
        raise ValueError(f"the manifest has no model {name}")
    with open(f"{folder}/{section['file']}", "rb") as f:
        data = f.read()
    found = hashlib.sha256(data).hexdigest()
    if found != section["sha256"].lower():
        raise ValueError(f"model {name}: SHA-256 is {found}")
    return data


def onnx_scorer(data: bytes) -> Scorer:
    """A session of one thread over the model's first input and output."""
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1
    session = onnxruntime.InferenceSession(data, options)
    name = session.get_inputs()[0].name
    return lambda pixels: session.run(None, {name: pixels})[0]


def mean_score(bins: np.ndarray) -> float:
    """Sum of (i + 1) times bin i; an error outside [1, 10]."""
    value = float((np.asarray(bins, float) * np.arange(1, len(bins) + 1)).sum())
    if not np.isfinite(value) or not 1.0 <= value <= 10.0:
        raise ValueError(f"score {value}")
    return value


def unit_vector(raw: np.ndarray) -> np.ndarray:
    v = np.asarray(raw, np.float32).ravel()
    n = float(np.linalg.norm(v))
    if not len(v) or not np.isfinite(n) or n == 0:
        raise ValueError("no direction")
    return v / n


def run_model(spark: SparkSession, images: DataFrame, data: bytes, make: Callable[[bytes], Scorer], prepare: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(id, output, error) for images (id, width, height, rgb): one scorer for each worker, a row for each image."""
    shared = spark.sparkContext.broadcast(data)  # a model file is of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make(shared.value)
        for batch in batches:
            ids, outs, errors = [], [], []
            for i, w, h, rgb in zip(*(batch.column(k).to_pylist() for k in ("id", "width", "height", "rgb"))):
                ids.append(i)
                try:
                    image = np.frombuffer(rgb, np.uint8).reshape(h, w, 3)
                    outs.append(np.asarray(scorer(prepare(image)), float).ravel().tolist())
                    errors.append(None)
                except Exception as e:  # a bad image is an outcome of its row
                    outs.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(outs, pa.list_(pa.float64())), pa.array(errors, pa.string())], names=["id", "output", "error"])

    return images.mapInArrow(run, "id string, output array<double>, error string")
