"""The five stages of a run over a catalog: ingest, score, dedup, develop, export.

Each stage reads the catalog, decides in DataFrames, and commits a snapshot. Decoders and models are
plugged in as functions from rows to rows.
"""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicat import config as C
from lumicat.functions import scalars as S
from lumicat.operators import catalog as K
from lumicat.operators import dedup as D
from lumicat.operators import naming as N
from lumicat.operators.graph import global_index
from lumicat.scratch import discard, materialise
from lumicat.sources import files, outputs, sidecar
from lumicat.sources.exif import with_exif
from lumicat.sources.images import read_rasters
from lumicat.store import Catalog


@dataclass
class RunConfig:
    source: str
    output: str
    now: int
    threshold: float = C.DEFAULT.run_threshold
    minimum_rating: int = 3
    strict: bool = False
    force: bool = False
    names: C.CatalogConfig = field(default_factory=lambda: C.DEFAULT)


def check_folders(source: str, output: str) -> None:
    """The output must not be inside the input."""
    s, o = os.path.realpath(source), os.path.realpath(output)
    if o == s or o.startswith(s.rstrip("/") + "/"):
        raise ValueError("the output folder is inside the source folder")


def threshold_arg(text: str) -> float:
    value = float(text)
    if not 0 < value <= 1:
        raise ValueError("a similarity threshold is in (0, 1]")
    return value


def long_edge_arg(text: str) -> int:
    value = int(text)
    if value < 16:
        raise ValueError("the long edge is at least 16")
    return value


def badge_arg(text: str) -> dict[str, str | float]:
    """``path=...,pos=...,scale=...``; the scale is kept in 0.001..100."""
    parts = dict(p.split("=", 1) for p in text.split(",") if "=" in p)
    if "path" not in parts or set(parts) - {"path", "pos", "scale"}:
        raise ValueError("a badge is path=...[,pos=...][,scale=...]")
    pos = parts.get("pos", "bottom_right").replace("-", "_")
    if pos not in ("top_left", "top_right", "bottom_left", "bottom_right", "center"):
        raise ValueError(f"unknown position {pos}")
    return {"path": parts["path"], "pos": pos, "scale": max(0.001, min(100.0, float(parts.get("scale", 5.0))))}


def count_by(outcomes: DataFrame, column: str) -> dict[str, int]:
    return {r[column]: r["count"] for r in outcomes.groupBy(column).count().collect()}  # a row for each outcome


def labels_arg(red: str, green: str) -> tuple[str, str]:
    """The two colour labels, trimmed: not empty, not equal, and only characters that XML allows."""
    red, green = red.strip(S.WHITE_SPACE), green.strip(S.WHITE_SPACE)
    if not red or not green or red == green:
        raise ValueError("labels must not be empty, and must differ")
    if any(re.search("[^\\x09\\x0a\\x0d\\x20-\\ud7ff\\ue000-\\ufffd\\U00010000-\\U0010ffff]", x) for x in (red, green)):
        raise ValueError("a label holds a character that XML doesn't allow")
    return red, green


def ready(rows: DataFrame, same_content: bool = True) -> tuple[DataFrame, dict[str, int]]:
    """(rows whose file is as it was ingested, counts of the others by what is wrong).

    Without ``same_content`` it is enough that the file is there. The rows are a scratch table.
    """
    seen = files.with_facts(rows, derive=same_content)
    derived = F.col("found_id") if same_content else F.when(F.col("found_error").isNull(), F.col("id"))
    seen = K.file_guard(seen, ~F.col("found_error").eqNullSafe("file_missing"), derived, F.col("id")).drop("found_size", "found_mtime", "found_id", "found_error")
    seen = materialise(seen, "guarded")
    good = seen.where("guard = 'ready'").drop("guard")
    good._scratch = seen._scratch  # so that discard() takes it
    return good, count_by(seen.where("guard <> 'ready'"), "guard")


def ingest(catalog: Catalog, cfg: RunConfig, exif: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, int]:
    """Walk, identify, look up cameras and upsert. ``exif`` adds the metadata columns; without it they are read from the files' EXIF directories.

    Files without a make are counted as no_exif and catalogued with nulls.
    """
    found = files.ingestible(files.paths(catalog.spark, cfg.source, prune=cfg.output))
    facts = materialise(files.facts(found), "facts")
    good = facts.where("error IS NULL")
    good = materialise((exif or with_exif)(good), "exif")
    cameras = catalog.spark.createDataFrame(list(C.CAMERAS), "make string, model string, slug string")
    looked_up = K.camera_lookup(good, cameras).withColumn("ingested_at_unix_seconds", F.lit(cfg.now).cast("long"))
    rows = looked_up.select(
        F.col("content_id").alias("id"), "source_path", "file_size", S.clamp_mtime(F.col("mtime")).cast("long").alias("mtime_unix_seconds"),
        S.mtime_anomalous(F.col("mtime")).alias("mtime_anomalous"), "make", "model", F.col("found_slug").alias("camera_slug"),
        "capture_time_unix_seconds", "width", "height", "exif_orientation", "ingested_at_unix_seconds", F.lit(None).cast("long").alias("superseded_at_unix_seconds"),
    )
    outcomes, after = K.upsert(catalog.read("photos"), materialise(rows, "ingest-batch"), cfg.now)
    counts = count_by(outcomes, "outcome") | {"errors": facts.where("error IS NOT NULL AND error <> 'zero_bytes'").count(), "zero_bytes": facts.where("error = 'zero_bytes'").count()}
    unknown = K.unknown_cameras(looked_up).agg(F.sum("n").alias("n")).first()["n"]
    anomalous = good.where(S.mtime_anomalous(F.col("mtime"))).count()
    no_exif = good.where("make IS NULL").count()
    catalog.commit({"photos": after})
    discard(facts, good)
    return counts | {"no_exif": no_exif, "unknown_camera": unknown or 0, "mtime_anomalous": anomalous}


def score(catalog: Catalog, cfg: RunConfig, scorer: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
    """Score what the model hasn't scored. ``scorer``: rows -> (photo_id, aesthetic_score)."""
    todo, wrong = ready(K.unprocessed(catalog.read("photos"), catalog.read("cull_scores"), cfg.names.score_model))
    batch = scorer(todo).select("photo_id", F.lit(cfg.names.score_model).alias("model_slug"), "aesthetic_score", F.lit(cfg.now).cast("long").alias("scored_at_unix_seconds"))
    outcomes, after = K.insert_scores(catalog.read("cull_scores"), materialise(batch, "score-batch"))
    counts = count_by(outcomes, "outcome")
    catalog.commit({"cull_scores": after})
    discard(todo)
    return counts | wrong


def dedup(catalog: Catalog, cfg: RunConfig, embedder: Callable[[DataFrame], DataFrame], recluster: bool = False, prune: bool = False) -> dict[str, int]:
    """Embed what isn't embedded, then cluster; clusters stay as they are if nothing was (unless ``recluster``)."""
    photos, model = catalog.read("photos"), cfg.names.embedding_model
    todo, wrong = ready(K.unprocessed(photos, catalog.read("embeddings"), model))
    batch = materialise(embedder(todo).select("photo_id", F.lit(model).alias("model_slug"), F.size("embedding").alias("dim"), "embedding", F.lit(cfg.now).cast("long").alias("embedded_at_unix_seconds")), "embedding-batch")
    fresh = batch.count()
    discard(todo)
    counts = {"embedded": fresh} | wrong
    if fresh:
        outcomes, after = K.insert_embeddings(catalog.read("embeddings"), batch)
        counts |= count_by(outcomes, "outcome")
        catalog.commit({"embeddings": after})
    if not fresh and not recluster:
        return counts
    # the catalog's ids are texts; clusters are found among row numbers in the order of ingest
    rows = D.valid_embeddings(K.embedding_rows(photos, catalog.read("embeddings"), model))
    rows = materialise(global_index(rows.select("id", "ingested_at_unix_seconds", "embedding"), F.col("ingested_at_unix_seconds"), F.col("id"), name="nth"), "vectors")
    clusters = materialise(D.threshold_clusters(rows.withColumnRenamed("id", "photo_id"), cfg.threshold, ["nth"], id_column="nth"), "clusters")
    stats = D.cluster_stats(clusters).first()
    counts |= {"clusters": stats["cluster_count"], "singletons": stats["singleton_count"] or 0}
    new = D.assignments(clusters).join(rows.select(F.col("nth").alias("r_nth"), F.col("id").alias("photo_id")), F.col("id") == F.col("r_nth")).select(
        "photo_id", F.lit(model).alias("model_slug"), "cluster_id", F.lit(cfg.threshold).alias("similarity_threshold"), F.lit(cfg.now).cast("long").alias("clustered_at_unix_seconds")
    )
    catalog.commit({"dup_clusters": K.replace_clusters(catalog.read("dup_clusters"), new, prune)})
    return counts


def rows_to_develop(catalog: Catalog, cfg: RunConfig) -> DataFrame:
    return K.develop_rows(catalog.read("photos"), catalog.read("cull_scores"), catalog.read("dup_clusters"), cfg.names.score_model, cfg.names.embedding_model)


def develop(catalog: Catalog, cfg: RunConfig) -> dict[str, int]:
    """Write ratings, labels and keywords into sidecars; the first photo of a sidecar's path decides.

    A photo whose file is gone is counted; a score that isn't finite is a failure of its photo.
    """
    red, green = labels_arg(cfg.names.red_label, cfg.names.green_label)
    a, c = F.col("aesthetic_score"), F.col("cluster_id")
    rows = rows_to_develop(catalog, cfg).withColumn("sidecar", S.with_extension(F.col("source_path"), "xmp"))
    rows = N.first_wins(rows, N.nfc(F.col("sidecar")), ["ingested_at_unix_seconds", "id"])
    rows, wrong = ready(rows, same_content=False)
    unscorable = rows.where(a.isNotNull() & ~S.is_finite(a)).count()
    root = cfg.names.keyword_root
    plan = rows.where(a.isNull() | S.is_finite(a)).select(
        "sidecar", S.rating(a).alias("rating"), S.color_label(a, red, green).alias("label"), a.alias("score"), c.alias("cluster_id"),
        F.col("id").alias("asset_id"), F.lit(float(cfg.now)).alias("last_processed_at"), S.keywords(a, c, root).alias("keywords"), S.hierarchical_keywords(a, c, root).alias("hierarchical_keywords"),
    )
    done = outputs.write_sidecars(plan, [x for x in plan.columns if x != "sidecar"], cfg.force)
    done = materialise(done, "developed")
    counts = count_by(done, "outcome") | wrong
    discard(rows, done)
    return counts | ({"failed": counts.get("failed", 0) + unscorable} if unscorable else {})


def export(catalog: Catalog, cfg: RunConfig, decode: Callable[[DataFrame], DataFrame], long_edge: int | None = None, shadow: float = 0.0, marks: dict[str, str] | None = None) -> dict[str, int]:
    """Render photos of the minimum rating. ``decode``: rows with source_path -> (source_path, width, height, rgb).

    A sidecar's rating goes before that of the score, -1 rejects. Decoded rows may have ``linear``
    (16-bit samples, low byte first), which are toned by the sidecar's exposure. ``marks``: PNG files
    by slot (top_right, bottom_left). Unreadable sidecars, scores that aren't finite without a
    sidecar's rating, undecodable photos and images that a mark doesn't fit are failures.
    """
    pictures = {slot: outputs.load_mark(path) for slot, path in (marks or {}).items()}
    rows = rows_to_develop(catalog, cfg)
    named = rows.withColumn("candidate", S.export_name(F.col("source_path"), F.col("aesthetic_score"), F.col("cluster_id")))
    named = N.without_collisions(named, "candidate", ["ingested_at_unix_seconds", "id"])
    there, wrong = ready(named, same_content=False)
    seen = sidecar.with_sidecars(there.withColumn("sidecar", S.with_extension(F.col("source_path"), "xmp")), ("rating", "exposure"))
    seen = seen.withColumn("stars", S.effective_rating(F.col("xmp_rating"), F.col("aesthetic_score"))).withColumn("target", F.concat(F.lit(cfg.output.rstrip("/") + "/"), F.regexp_replace("file_name", "\\.jpg$", ".png")))
    seen = files.with_facts(seen, "target", derive=False)
    present = F.col("found_error").isNull() & F.lit(not cfg.force)
    judged = F.when(F.col("xmp_error").isNotNull(), "failed").otherwise(K.export_outcome(F.col("stars"), cfg.minimum_rating))
    fate = F.when((judged == "render") & present, "skipped").otherwise(judged)
    seen = materialise(seen.select("source_path", "target", F.col("xmp_exposure").alias("exposure"), fate.alias("outcome")), "export-plan")
    counts = count_by(seen.where("outcome <> 'render'"), "outcome") | wrong
    wanted = seen.where("outcome = 'render'").drop("outcome")
    pixels = decode(wanted.select("source_path"))
    pixels = pixels.select(F.col("source_path").alias("p_path"), "width", "height", "rgb", *(["linear"] if "linear" in pixels.columns else []))
    images = wanted.join(pixels, F.col("source_path") == F.col("p_path"), "left")
    decoded = F.col("rgb").isNotNull() | (F.col("linear").isNotNull() if "linear" in images.columns else F.lit(False))
    w, h = S.fitted_size(F.col("width"), F.col("height"), long_edge) if long_edge else (F.col("width"), F.col("height"))
    margin = F.floor(F.least(w, h) * F.lit(C.MARK_MARGIN) + 0.5).cast("int")
    for slot, mark in pictures.items():
        images = images.withColumn(slot, S.mark_box(w, h, F.lit(mark.shape[1]), F.lit(mark.shape[0]), C.MARK_HEIGHTS[slot], margin, margin, slot))
    fits = F.expr(" AND ".join(f"{slot} IS NOT NULL" for slot in pictures) or "true")
    done = materialise(outputs.write_blobs(outputs.render_images(images.where(decoded & fits), long_edge, False, shadow, pictures), cfg.output, cfg.force), "exported")
    rendered = count_by(done, "outcome")
    failed = counts.pop("failed", 0) + rendered.pop("failed", 0) + wanted.count() - done.count()
    discard(there, seen, done)
    return counts | rendered | ({"failed": failed} if failed else {})


def rename(catalog: Catalog, cfg: RunConfig) -> dict[str, int]:
    """Copy the source tree's photos and sidecars under names that carry cluster and score."""
    rows = rows_to_develop(catalog, cfg).where(S.under_root(F.col("source_path"), cfg.source))
    fallback = F.regexp_extract("source_path", r"([^/]*)$", 1)
    rows = rows.withColumn("candidate", F.coalesce(S.rename_name(F.col("source_path"), F.col("aesthetic_score"), F.col("cluster_id")), fallback))
    named = N.without_collisions(rows, "candidate", ["ingested_at_unix_seconds", "id"])
    named, wrong = ready(named, same_content=False)
    plan = named.select("source_path", F.concat(F.lit(cfg.output.rstrip("/") + "/"), "file_name").alias("target"))
    done = materialise(outputs.copy_pairs(plan, cfg.output, cfg.force), "renamed")
    counts = count_by(done, "outcome")
    discard(named, done)
    return counts | wrong


def watermark(spark: SparkSession, source: str, output: str, mark_path: str, position: str = "bottom_right", scale: float = 5.0, force: bool = False) -> dict[str, int]:
    """Lay a mark over every raster image below a folder; outputs keep their stems.

    An image that the mark doesn't fit is counted as such and gets no output.
    """
    mark = outputs.load_mark(mark_path)
    images = read_rasters(spark, source).where(~S.under_root(F.col("source_path"), os.path.realpath(output)) & ~S.under_root(F.col("source_path"), output))
    good = images.where("error IS NULL").withColumn("box", S.badge_box(F.col("width"), F.col("height"), F.lit(mark.shape[1]), F.lit(mark.shape[0]), position, scale))
    planned = good.withColumn("target", F.concat(F.lit(output.rstrip("/") + "/"), S.stem_of(F.col("source_path")), F.lit(".png")))
    done = outputs.write_blobs(outputs.mark_images(planned.where("box IS NOT NULL"), mark), output, force)
    counts = count_by(materialise(done, "marked"), "outcome")
    misfits = planned.where("box IS NULL").count()
    return counts | {"undecodable": images.where("error IS NOT NULL").count()} | ({"does_not_fit": misfits} if misfits else {})


class Timings:
    """Seconds of stages, appended to a tab-separated log."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, name: str, stage: Callable[[], dict[str, int]]) -> dict[str, int]:
        began = time.monotonic()
        result = stage()
        with open(self.path, "a") as f:
            f.write(f"{name}\t{time.monotonic() - began:.3f}\t{K.summary_line(result)}\n")
        return result


def run(catalog: Catalog, cfg: RunConfig, scorer, embedder, decode, exif=None, timings: Timings | None = None) -> tuple[int, dict[str, dict[str, int]]]:
    """All five stages; strict stops at the first failing one, else the first failure's code is returned."""
    check_folders(cfg.source, cfg.output)
    guards = ["file_missing", "derive_failed", "content_changed"]
    stages = {
        "ingest": (lambda: ingest(catalog, cfg, exif), ["errors", "no_exif", "unknown_camera", "mtime_anomalous"], ["inserted", "already_catalogued", "superseded_previous"]),
        "score": (lambda: score(catalog, cfg, scorer), ["rejected", "derive_failed"], []),  # files that are gone or changed are the user's doing
        "dedup": (lambda: dedup(catalog, cfg, embedder), ["rejected", *guards], []),
        "develop": (lambda: develop(catalog, cfg), ["failed", *guards], []),
        "export": (lambda: export(catalog, cfg, decode), ["failed", *guards], []),
    }
    code, report = 0, {}
    for name, (stage, failures, useful) in stages.items():
        report[name] = timings(name, stage) if timings else stage()
        this = K.exit_code(report[name], failures, failures if name == "export" else [], useful, cfg.strict)
        code = code or this
        if this and cfg.strict:
            break
    return code, report
