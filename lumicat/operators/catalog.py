"""Catalog operators: views, incremental work, writes with their conflict rules, and validation.

A catalog is DataFrames. Writes take the present table and a batch and return outcomes and the next
table; lumicat.store commits it as a snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumicat import config as C
from lumicat.functions import scalars as S

PHOTO_COLUMNS = (
    "id", "source_path", "file_size", "mtime_unix_seconds", "mtime_anomalous", "make", "model", "camera_slug",
    "capture_time_unix_seconds", "width", "height", "exif_orientation", "ingested_at_unix_seconds", "superseded_at_unix_seconds",
)


def active(photos: DataFrame) -> DataFrame:
    return photos.where(F.col("superseded_at_unix_seconds").isNull())


def for_model(rows: DataFrame, model: str) -> DataFrame:
    return rows.where(F.col("model_slug") == model)


def photo_rows(photos: DataFrame) -> DataFrame:
    return photos.select(*PHOTO_COLUMNS)


def unprocessed(photos: DataFrame, done: DataFrame, model: str, key: str = "id", done_key: str = "photo_id") -> DataFrame:
    """Active photos without a row of the model: what a scoring or embedding run has to do."""
    have = for_model(done, model).select(F.col(done_key).alias("done_key"))
    return active(photos).join(have, F.col(key) == F.col("done_key"), "left_anti")


def develop_rows(photos: DataFrame, scores: DataFrame, clusters: DataFrame, score_model: str, cluster_model: str, key: str = "id", row_key: str = "photo_id") -> DataFrame:
    """Active photos with their score and cluster, if any; the models are part of the join condition."""
    s = for_model(scores, score_model).select(F.col(row_key).alias("s_key"), "aesthetic_score")
    c = for_model(clusters, cluster_model).select(F.col(row_key).alias("c_key"), "cluster_id")
    return active(photos).join(s, F.col(key) == F.col("s_key"), "left").join(c, F.col(key) == F.col("c_key"), "left").drop("s_key", "c_key")


def embedding_rows(photos: DataFrame, embeddings: DataFrame, model: str, key: str = "id", row_key: str = "photo_id") -> DataFrame:
    e = for_model(embeddings, model).withColumnRenamed(row_key, "e_key")
    return active(photos).join(e, F.col(key) == F.col("e_key")).drop("e_key")


def one_per_id(batch: DataFrame) -> DataFrame:
    """The row of the least path of each id: the others of a batch are catalogued already when they come.

    As in SQL, a row without a path comes after those with one. Equal paths are told apart by time, then by the other columns, so that reruns agree.
    """
    order = ["source_path", "ingested_at_unix_seconds"]
    order += [c for c in batch.columns if c not in ("id", *order)]
    w = Window.partitionBy("id").orderBy(*(F.asc_nulls_last(c) for c in order))
    return batch.withColumn("nth", F.row_number().over(w))


def upsert(photos: DataFrame, batch: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(outcomes, next table) of ingesting a batch.

    An id that exists in any state changes nothing; a path with an active row of another id gets
    that row superseded. Of several new ids at one path the one ingested last stays active.
    """
    ranked = one_per_id(batch)
    known = photos.select(F.col("id").alias("known_id")).distinct()
    fresh = ranked.join(known, F.col("id") == F.col("known_id"), "left")
    held = active(photos).select(F.col("source_path").alias("held_path"), F.col("id").alias("previous_id"))
    judged = fresh.join(held, F.col("source_path") == F.col("held_path"), "left")
    is_new = F.col("known_id").isNull() & (F.col("nth") == 1)
    at_path = Window.partitionBy("source_path", is_new).orderBy(*(F.asc_nulls_last(c) for c in ("ingested_at_unix_seconds", "id", "previous_id")))
    judged = judged.withColumn("is_new", is_new).withColumn("before", F.when(is_new, F.coalesce(F.lag("id").over(at_path), F.col("previous_id"))))
    judged = judged.withColumn("last", F.when(is_new, F.lead("id").over(at_path).isNull()))
    outcome = F.when(~F.col("is_new"), "already_catalogued").when(F.col("before").isNull(), "inserted").otherwise("superseded_previous")
    judged = judged.withColumn("outcome", outcome)
    outcomes = judged.select("id", "source_path", "outcome", F.col("before").alias("superseded_id"))
    added = judged.where("is_new").withColumn("superseded_at_unix_seconds", F.when(~F.col("last"), F.lit(now)).cast("long")).select(*photos.columns)
    replaced = judged.where("is_new").select(F.col("source_path").alias("new_path")).distinct()
    kept = photos.join(replaced, F.col("source_path") == F.col("new_path"), "left").withColumn(
        "superseded_at_unix_seconds",
        F.when(F.col("superseded_at_unix_seconds").isNull() & F.col("new_path").isNotNull(), F.lit(now)).otherwise(F.col("superseded_at_unix_seconds")).cast("long"),
    ).select(*photos.columns)
    return outcomes, kept.unionByName(added)


def insert_first(table: DataFrame, batch: DataFrame, keys: list[str], valid: Column, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(outcomes, next table) of an insert in which the first writer of a key wins.

    Rows that aren't valid are rejected before anything else.
    """
    w = Window.partitionBy("is_valid", *keys).orderBy(*order)
    ranked = batch.withColumn("is_valid", F.coalesce(valid, F.lit(False))).withColumn("nth", F.row_number().over(w))
    have = table.select(*(F.col(k).alias(f"have_{k}") for k in keys)).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"have_{k}")) for k in keys]
    judged = ranked.join(have, on, "left")
    outcome = F.when(~F.col("is_valid"), "rejected").when(F.col(f"have_{keys[0]}").isNotNull() | (F.col("nth") > 1), "already_there").otherwise("inserted")
    judged = judged.withColumn("outcome", outcome)
    added = judged.where("outcome = 'inserted'").select(*table.columns)
    return judged.select(*batch.columns, "outcome"), table.unionByName(added)


def insert_scores(scores: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    return insert_first(scores, batch, ["photo_id", "model_slug"], S.valid_score(F.col("aesthetic_score")), ["scored_at_unix_seconds", "aesthetic_score"])


def valid_id(photo_id: Column) -> Column:
    """The text of 32 bytes in hex: rows with another id are corrupt and dropped."""
    return F.coalesce(photo_id.rlike(r"^[0-9a-f]{64}\z"), F.lit(False))


def export_outcome(stars: Column, minimum: int) -> Column:
    """What an effective rating means for a photo's export; null stars come from a score that isn't finite."""
    return F.when(stars.isNull(), "failed").when((stars == -1) | (stars < minimum), "skipped_rating").otherwise("render")


def valid_embedding(vector: Column, dim: Column) -> Column:
    return dim.between(1, C.DIM_MAX) & (F.size(vector) == dim)


def insert_embeddings(embeddings: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    return insert_first(embeddings, batch, ["photo_id", "model_slug"], valid_embedding(F.col("embedding"), F.col("dim")), ["embedded_at_unix_seconds"])


def replace_clusters(old: DataFrame, new: DataFrame, prune: bool = False) -> DataFrame:
    """New assignments replace old ones of the same key; old ones without a new one stay, unless pruned."""
    if prune:
        return new
    keys = new.select(F.col("photo_id").alias("n_id"), F.col("model_slug").alias("n_model"))
    stale = old.join(keys, (F.col("photo_id") == F.col("n_id")) & (F.col("model_slug") == F.col("n_model")), "left_anti")
    return stale.unionByName(new)


def key_violations(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def reference_violations(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias("p_key")), F.col(child_key) == F.col("p_key"), "left_anti")


def version_history(photos: DataFrame, path: str, order: list) -> DataFrame:
    """Each version of a path, with when the next one replaced it."""
    w = Window.partitionBy(path).orderBy(*order)
    return photos.withColumn("version", F.row_number().over(w)).withColumn("replaced_at", F.lead(order[0]).over(w)).withColumn("is_current", F.col("replaced_at").isNull())


def camera_lookup(photos: DataFrame, cameras: DataFrame) -> DataFrame:
    """Photos with the slug of their camera: trailing NULs, then blanks trimmed; case counts."""
    def trimmed(c: str) -> Column:
        return F.trim(F.regexp_replace(F.col(c), r"\x00+$", ""))

    known = cameras.select(F.col("make").alias("k_make"), F.col("model").alias("k_model"), F.col("slug").alias("found_slug"))
    on = (trimmed("make") == F.col("k_make")) & (trimmed("model") == F.col("k_model"))
    return photos.join(F.broadcast(known), on, "left").drop("k_make", "k_model")  # the registry is configuration


def unknown_cameras(looked_up: DataFrame) -> DataFrame:
    """Distinct cameras without a slug, with when they were first seen."""
    some = F.col("found_slug").isNull() & F.col("make").isNotNull()
    return looked_up.where(some).groupBy("make", "model").agg(F.min("ingested_at_unix_seconds").alias("first_seen"), F.count("*").alias("n"))


def file_guard(rows: DataFrame, exists: Column, derived: Column, stored: Column) -> DataFrame:
    """Outcome of the checks before a photo is processed, in their order."""
    return rows.withColumn("guard", F.when(~exists, "file_missing").when(derived.isNull(), "derive_failed").when(derived != stored, "content_changed").otherwise("ready"))


def without_existing(planned: DataFrame, existing: DataFrame, column: str, force: bool = False) -> DataFrame:
    """Planned outputs that aren't there yet; all of them if forced."""
    if force:
        return planned
    return planned.join(existing.select(F.col(column).alias("there")), F.col(column) == F.col("there"), "left_anti")


def counters(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """One row with a count for each named outcome."""
    return rows.agg(*(F.count_if(F.col(column) == n).alias(n) for n in names))


def summary_line(counts: dict[str, int]) -> str:
    return " ".join(f"{k}={v}" for k, v in counts.items())


def exit_code(counts: dict[str, int], strict_kinds: list[str], partial_kinds: list[str], useful_kinds: list[str], strict: bool) -> int:
    """1: a strict failure; 64: nothing useful was done; 2: failures of a command that reports partial ones."""
    if strict and any(counts.get(k, 0) for k in strict_kinds):
        return 1
    if any(counts.get(k, 0) for k in partial_kinds):
        return 2
    if useful_kinds and not any(counts.get(k, 0) for k in useful_kinds):
        return 64
    return 0
