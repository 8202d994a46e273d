"""Catalog listings: counts, groups by camera, sorted and limited views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumicat.operators.catalog import active, develop_rows


def counts(photos: DataFrame) -> DataFrame:
    return photos.agg(F.count("*").alias("all_rows"), F.count_if(F.col("superseded_at_unix_seconds").isNull()).alias("active_rows"))


def utc_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")


def by_camera(photos: DataFrame) -> DataFrame:
    """Active photos by camera; those without a slug are a group."""
    g = active(photos).groupBy("camera_slug").agg(
        F.count("*").alias("n"), utc_text(F.min("capture_time_unix_seconds")).alias("first_capture"), utc_text(F.max("capture_time_unix_seconds")).alias("last_capture")
    )
    return g.orderBy(F.desc("n"), F.col("camera_slug").asc_nulls_first())


ORDERS = {
    "capture": "capture_time_unix_seconds",
    "path": "source_path",
    "ingested": "ingested_at_unix_seconds",
    "score": "aesthetic_score",
}


def listing(photos: DataFrame, scores: DataFrame, model: str, order: str = "capture", limit: int = 50, key: str = "id", row_key: str = "photo_id") -> DataFrame:
    """All photos with state, size and score as texts; sorted with nulls first ascending, last descending."""
    s = scores.where(F.col("model_slug") == model).select(F.col(row_key).alias("s_key"), "aesthetic_score")
    rows = photos.join(s, F.col(key) == F.col("s_key"), "left")
    out = rows.select(
        "source_path", "ingested_at_unix_seconds", "capture_time_unix_seconds", "aesthetic_score",
        F.when(F.col("superseded_at_unix_seconds").isNull(), "active").otherwise("superseded").alias("state"),
        utc_text(F.col("capture_time_unix_seconds")).alias("captured"),
        F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string")).alias("size"),
        F.format_string("%.4f", F.col("aesthetic_score")).alias("score_text"),
    )
    out = out.withColumn("score_text", F.when(F.col("aesthetic_score").isNotNull(), F.col("score_text")))
    by = F.col("aesthetic_score").desc_nulls_last() if order == "score" else F.col(ORDERS[order]).asc_nulls_first()
    out = out.orderBy(by, F.col("source_path").asc())
    return out.limit(limit) if limit else out


def shown(total: int, limit: int) -> str:
    return f"Showing {limit} of {total}" if limit and total > limit else f"Showing {total} of {total}"


def has_any(photos: DataFrame, scores: DataFrame, clusters: DataFrame, score_model: str, cluster_model: str, key: str = "id", row_key: str = "photo_id") -> DataFrame:
    """Whether any active photo has a score, and whether any has a cluster."""
    rows = develop_rows(photos, scores, clusters, score_model, cluster_model, key, row_key)
    return rows.agg(F.coalesce(F.bool_or(F.col("aesthetic_score").isNotNull()), F.lit(False)).alias("any_score"), F.coalesce(F.bool_or(F.col("cluster_id").isNotNull()), F.lit(False)).alias("any_cluster"))
