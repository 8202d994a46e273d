"""Sharding by vector bin packing over bytes, tokens and rows.

Documents of equal text are a group. Groups of over 1/``FINE`` of a shard's mean bytes, tokens or
rows are placed one by one (there can't be more than three times ``FINE`` times the shards of them);
one that no shard could hold is cut into equal pieces first. The other groups are gathered by hash of their text into
``FINE`` times the shards bundles. So what is placed is of bounded number at any size of the
input. Units are placed from large to small, each in the shard where the dot product of its
vector with the shard's residual capacity is highest, among shards that it still fits in every
component (or, if none, the one with the most bytes left).

Slots are numbered from counts: a unit's n rows are split by hash into about sqrt(n) cells, cells get their first
slot from the counts before them, and rows are numbered inside a cell only, so no task has a
whole shard or a whole group.

Defined results: null text has no bytes (size 16, crc32 0) and is a group of its own, apart from
empty texts; repeated rows are rows of one group; an empty table gives an empty result; columns
beside doc_id and text are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumicat.llm.common import materialise

SHARDS = 40
FINE = 64
ROW_BYTES = 16


def measured(docs: DataFrame) -> DataFrame:
    """Slim rows: doc_id, size, tokens, crc32 and the group's key."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("tokens"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("")).alias("group_key"),
    )


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unit (rows of bytes, tokens, rows), by largest dot product with what is left."""
    total = vectors.sum(0).astype(float)
    capacity = np.where(total > 0, total / shards, 1.0)
    need = vectors / capacity
    left = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), np.int64)
    for i in sorted(range(len(vectors)), key=lambda i: (-need[i].max(), *(-x for x in vectors[i].tolist()), i)):
        fits = (left - need[i] >= -1e-12).all(1)
        if fits.any():
            s = int(np.argmax(np.where(fits, left @ need[i], -np.inf)))
        else:
            s = int(np.argmax(left[:, 0]))
        out[i] = s
        left[s] -= need[i]
    return out


def units(rows: DataFrame, shards: int, fine: int = FINE) -> tuple[DataFrame, DataFrame]:
    """(groups that are placed by themselves, rows with their unit)."""
    # one row
    totals = rows.agg(*(F.sum(c).alias(c) for c in ("size", "tokens")), F.count("*").alias("n_rows")).first()
    mean = {c: max(1.0, (totals[c] or 0) / shards) for c in ("size", "tokens", "n_rows")}
    grouped = rows.groupBy("group_key").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n_rows"))
    share = F.greatest(*(F.col(c) / m for c, m in mean.items()))  # of a shard, in the component it fills most
    large = grouped.select(F.col("group_key").alias("l_key"), share.alias("share")).where(F.col("share") > 1 / fine)
    large = large.select("l_key", F.ceil("share").cast("int").alias("pieces"))
    large = materialise(large, "shard-groups")  # fewer than 3 * fine * shards rows
    tagged = rows.join(F.broadcast(large), F.col("group_key") == F.col("l_key"), "left")
    piece = F.pmod(F.xxhash64("doc_id", "group_key"), F.col("pieces"))
    bundle = F.pmod(F.xxhash64("group_key"), F.lit(fine * shards))
    unit = F.when(F.col("l_key").isNotNull(), F.concat(F.lit("g"), F.col("group_key"), F.lit("."), piece)).otherwise(F.concat(F.lit("b"), bundle))
    return large, tagged.withColumn("unit", unit).drop("l_key", "pieces")


def pack(docs: DataFrame, shards: int = SHARDS, fine: int = FINE) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every document's place."""
    rows = materialise(measured(docs), "shard-rows")
    _, tagged = units(rows, shards, fine)
    summed = tagged.groupBy("unit").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n_rows"))
    # a bounded number of rows, as bundles and pieces of large groups are few
    found = sorted(summed.collect(), key=lambda r: r["unit"])
    spark = docs.sparkSession
    vectors = np.array([[r["bytes"], r["tokens"], r["n_rows"]] for r in found], np.int64).reshape(-1, 3)
    shard_of = place(vectors, shards)
    starts, filled = [], [0] * shards
    for r, s in zip(found, shard_of.tolist()):
        starts.append((r["unit"], s, filled[s], max(1, math.isqrt(r["n_rows"]))))
        filled[s] += r["n_rows"]
    plan = spark.createDataFrame(starts, "u_unit string, shard int, unit_start long, cells int")
    dealt = tagged.join(F.broadcast(plan), F.col("unit") == F.col("u_unit"))
    dealt = dealt.withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit("cell")), "cells"))
    counts = dealt.groupBy("unit", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("unit").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("unit").alias("c_unit"), F.col("cell").alias("c_cell"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cell_start"))
    numbered = dealt.withColumn("within", F.row_number().over(Window.partitionBy("unit", "cell").orderBy("doc_id", "group_key")) - 1)
    out = numbered.join(counts, (F.col("unit") == F.col("c_unit")) & (F.col("cell") == F.col("c_cell")))
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("unit_start") + F.col("cell_start") + F.col("within")).cast("long").alias("slot"), "tokens")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The contract's columns under the law of sizes."""
    return pack(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS) -> DataFrame:
    """Write the documents as Parquet below ``folder``/shard=N; returns their places."""
    placed = materialise(shard_documents(docs, shards), "shard-places")
    rows = docs.withColumn("lm_key", F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long"))
    keys = placed.select(F.col("doc_id").alias("p_doc"), F.col("text_crc32").alias("p_crc"), F.col("size").alias("p_size"), F.col("shard").alias("lm_shard")).distinct()
    joined = rows.join(keys, F.col("doc_id").eqNullSafe(F.col("p_doc")) & (F.col("lm_key") == F.col("p_crc")) & (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES == F.col("p_size")))
    joined.select(*docs.columns, F.col("lm_shard").alias("shard_no")).write.partitionBy("shard_no").parquet(folder)
    return placed
