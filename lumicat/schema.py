"""Table schemas by version, and the migrations between them."""

from __future__ import annotations

from pyspark.sql import types as T

VERSION = 3


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


PHOTOS = _struct(
    ("id", T.StringType(), False), ("source_path", T.StringType(), False), ("file_size", T.LongType(), False), ("mtime_unix_seconds", T.LongType(), False),
    ("mtime_anomalous", T.BooleanType(), False), ("make", T.StringType(), True), ("model", T.StringType(), True), ("camera_slug", T.StringType(), True),
    ("capture_time_unix_seconds", T.LongType(), True), ("width", T.IntegerType(), True), ("height", T.IntegerType(), True), ("exif_orientation", T.IntegerType(), True),
    ("ingested_at_unix_seconds", T.LongType(), False), ("superseded_at_unix_seconds", T.LongType(), True),
)
SCORES = _struct(("photo_id", T.StringType(), False), ("model_slug", T.StringType(), False), ("aesthetic_score", T.DoubleType(), False), ("scored_at_unix_seconds", T.LongType(), False))
EMBEDDINGS = _struct(
    ("photo_id", T.StringType(), False), ("model_slug", T.StringType(), False), ("dim", T.IntegerType(), False),
    ("embedding", T.ArrayType(T.FloatType(), False), False), ("embedded_at_unix_seconds", T.LongType(), False),
)
CLUSTERS = _struct(
    ("photo_id", T.StringType(), False), ("model_slug", T.StringType(), False), ("cluster_id", T.LongType(), False),
    ("similarity_threshold", T.DoubleType(), False), ("clustered_at_unix_seconds", T.LongType(), False),
)

#: Tables that exist from each version on.
ADDED = {1: {"photos": PHOTOS}, 2: {"cull_scores": SCORES}, 3: {"embeddings": EMBEDDINGS, "dup_clusters": CLUSTERS}}


def tables(version: int = VERSION) -> dict[str, T.StructType]:
    return {name: s for v, new in sorted(ADDED.items()) if v <= version for name, s in new.items()}
