"""Output files: atomic writes from executors, copies of pairs, renders."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumicat.functions.pixels import decode_png, render, tone_table
from lumicat.sources.sidecar import merge_and_write, replace_file

OUTCOME = "target string, outcome string, error string"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (list(zip(*rows)) or [()] * 3)], names=["target", "outcome", "error"])


def inside(path: str, root: str) -> bool:
    return os.path.realpath(path).startswith(os.path.realpath(root).rstrip("/") + "/")


def write_blobs(rows: DataFrame, root: str, force: bool = False) -> DataFrame:
    """Write (target, data) to files below ``root``; present ones are skipped unless forced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for target, data in zip(batch.column("target").to_pylist(), batch.column("data").to_pylist()):
                try:
                    if not inside(target, root):
                        raise ValueError("outside the output folder")
                    if os.path.exists(target) and not force:
                        out.append((target, "skipped", None))
                        continue
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    replace_file(target, data)
                    out.append((target, "written", None))
                except (OSError, ValueError) as e:
                    out.append((target, "failed", str(e)))
            yield _rows(out)

    return rows.select("target", "data").mapInArrow(run, OUTCOME)


def copy_pairs(plan: DataFrame, root: str, force: bool = False) -> DataFrame:
    """Copy (source_path, target) with the sidecars beside them; both are staged before either is moved in place."""

    def copy(source: str, target: str) -> str:
        if not inside(target, root):
            raise ValueError("outside the output folder")
        if os.path.exists(target) and not force:
            return "skipped"
        os.makedirs(os.path.dirname(target), exist_ok=True)
        pairs = [(source, target)]
        side = os.path.splitext(source)[0] + ".xmp"
        if os.path.exists(side):
            pairs.append((side, os.path.splitext(target)[0] + ".xmp"))
        staged = []
        try:
            for a, b in pairs:
                part = f"{b}.{uuid.uuid4().hex}.tmp"
                staged.append((part, b))
                shutil.copy2(a, part)
            for part, b in staged:
                os.replace(part, b)
        finally:
            for part, _ in staged:
                if os.path.exists(part):
                    os.remove(part)
        return "copied"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source, target in zip(batch.column("source_path").to_pylist(), batch.column("target").to_pylist()):
                try:
                    out.append((target, copy(source, target), None))
                except (OSError, ValueError) as e:
                    out.append((target, "failed", str(e)))
            yield _rows(out)

    return plan.select("source_path", "target").mapInArrow(run, OUTCOME)


def write_sidecars(plan: DataFrame, settings: list[str], force: bool = False) -> DataFrame:
    """Merge each row's settings (columns of those names) into its ``sidecar`` file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    out.append((row["sidecar"], merge_and_write(row["sidecar"], {k: row[k] for k in settings}, force), None))
                except (OSError, ValueError) as e:
                    out.append((row["sidecar"], "failed", str(e)))
            yield _rows(out)

    return plan.select("sidecar", *settings).mapInArrow(run, OUTCOME)


def load_mark(path: str) -> np.ndarray:
    """RGBA of a PNG mark; other kinds of files are refused."""
    with open(path, "rb") as f:
        return decode_png(f.read())


def mark_images(images: DataFrame, mark: np.ndarray) -> DataFrame:
    """(target, data) of images (target, width, height, rgb, box): the mark laid over each image's box.

    Images without a box (the mark doesn't fit) are not for this: an unmarked copy is never written.
    """
    shared = images.sparkSession.sparkContext.broadcast(mark)  # one picture

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for w, h, rgb, box in zip(*(batch.column(c).to_pylist() for c in ("width", "height", "rgb", "box"))):
                mark = (shared.value, (box["x"], box["y"], box["w"], box["h"]))
                data.append(render(np.frombuffer(rgb, np.uint8).reshape(h, w, 3), marks=[mark]))
            yield pa.RecordBatch.from_arrays([batch.column("target"), pa.array(data, pa.binary())], names=["target", "data"])

    return images.select("target", "width", "height", "rgb", "box").mapInArrow(run, "target string, data binary")


def render_images(images: DataFrame, long_edge: int | None, downscale_only: bool = False, shadow: float = 0.0, marks: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(target, data) of images (target, width, height, rgb): resized, shaded, marked, encoded as PNG.

    With a column ``linear`` (16-bit samples, low byte first), rows that have it are toned by their
    ``exposure`` instead of taken from ``rgb``. ``marks``: RGBA by the name of the column of its box.
    """
    shared = images.sparkSession.sparkContext.broadcast(marks or {})  # at most one picture for each slot
    toned = "linear" in images.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        luts: dict[float, np.ndarray] = {}
        for batch in batches:
            data = []
            for k in range(batch.num_rows):
                w, h, rgb = (batch.column(c)[k].as_py() for c in ("width", "height", "rgb"))
                samples = batch.column("linear")[k].as_py() if toned else None
                if samples is not None:
                    ev = batch.column("exposure")[k].as_py() or 0.0
                    if ev not in luts:
                        luts = {ev: tone_table(ev)}
                    image = luts[ev][np.frombuffer(samples, "<u2")].reshape(h, w, 3)
                else:
                    image = np.frombuffer(rgb, np.uint8).reshape(h, w, 3)
                laid = [(mark, tuple(batch.column(slot)[k].as_py()[c] for c in "xywh")) for slot, mark in shared.value.items()]
                data.append(render(image, long_edge, downscale_only, shadow, laid))
            yield pa.RecordBatch.from_arrays([batch.column("target"), pa.array(data, pa.binary())], names=["target", "data"])

    columns = ["target", "width", "height", "rgb", *(["linear", "exposure"] if toned else []), *(marks or {})]
    return images.select(*columns).mapInArrow(run, "target string, data binary")
