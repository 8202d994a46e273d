"""The catalog's tables, derived deterministically from documents, labels and embeddings.

Exact texts stand for file contents, so copies are files of equal id. ``doc_id`` stays as a key,
because ids repeat until an upsert has removed copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicat import config as C
from lumicat.functions import scalars as S


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    raw_mtime = 700000000 + doc * 4000000
    make = F.when(F.col("lang").isin("en", "de"), "Canon").when(F.col("lang") == "fr", "Acme")
    model = F.when(F.col("lang") == "en", "EOS R8").when(F.col("lang") == "de", "EOS R5").when(F.col("lang") == "fr", "X1")
    return d.select(
        F.sha2(F.col("text").cast("binary"), 256).alias("id"),
        F.concat(F.lit("/shoot/"), F.col("source"), F.lit("/"), doc.cast("string"), F.lit("/IMG_"), (doc % 50).cast("string"), F.lit(".CR3")).alias("source_path"),
        F.col("n_chars").alias("file_size"),
        S.clamp_mtime(raw_mtime).cast("long").alias("mtime_unix_seconds"),
        S.mtime_anomalous(raw_mtime).cast("int").alias("mtime_anomalous"),
        make.alias("make"), model.alias("model"),
        F.when(F.col("lang") == "en", "canon-r8").alias("camera_slug"),
        F.when(doc % 11 != 0, 1700000000 + doc * 3600).alias("capture_time_unix_seconds"),
        F.when(doc % 13 != 0, 4000 + (doc % 3) * 1000).alias("width"),
        F.when(doc % 13 != 0, F.lit(5000)).alias("height"),
        (1 + doc % 8).alias("exif_orientation"),
        (1780000000 + F.floor(doc / 10)).cast("long").alias("ingested_at_unix_seconds"),
        F.when(doc % 17 == 0, F.lit(1790000000)).cast("long").alias("superseded_at_unix_seconds"),
        doc.alias("doc_id"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    score = F.lit(1.0) + ((F.col("doc_id") * 37) % 901) / F.lit(100.0)
    return labels.select("doc_id", F.lit(C.DEFAULT.score_model).alias("model_slug"), score.alias("aesthetic_score"), (1780001000 + F.col("doc_id")).alias("scored_at_unix_seconds"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored assignments for every third vector: stale ones, as an earlier run may have left."""
    e = read(spark, sf_dir, "embeddings")
    return e.where("vec_id % 3 = 0").select(
        F.col("vec_id").alias("doc_id"), F.lit(C.DEFAULT.embedding_model).alias("model_slug"), (F.col("vec_id") % 7).alias("cluster_id"), F.lit(0.45).alias("similarity_threshold")
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("doc_id"), F.lit(C.DEFAULT.embedding_model).alias("model_slug"), F.size("embedding").alias("dim"), "embedding")


def cameras(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(C.CAMERAS), "make string, model string, slug string")
