"""Near-duplicate clusters of embeddings: a blocked similarity join, components and numbering."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicat import config as C
from lumicat.functions import scalars as S
from lumicat.operators.graph import components, global_index
from lumicat.scratch import materialise

BLOCK_BYTES = 64 << 20
PRODUCT_ROWS = 2048
CHECKED_PAIRS = 16384


def valid_embeddings(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with a finite, near-unit vector."""
    n = S.norm(F.col(vector))
    return rows.withColumn("norm", n).where((F.size(vector) > 0) & S.is_finite(n) & n.between(C.NORM_MIN, C.NORM_MAX))


def _matrices(ids: pa.Array, vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) by size of vector, read from Arrow's buffers."""
    i, sizes = ids.to_numpy(), vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    out = {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        out[size] = (i[rows], flat[(ends[rows] - size)[:, None] + np.arange(size)] if len(rows) < len(i) else flat.reshape(-1, size))
    return out


def _over(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], threshold: float, same: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of two matrices over the threshold; each is decided in doubles.

    The matrix product may be of 32-bit floats: what its rounding could have hidden is tried too.
    """
    (ia, va), (ib, vb) = a, b
    rough = (va.shape[1] + 2) * 2.0**-23 * float(np.nan_to_num(np.linalg.norm(va, axis=1)).max() * np.nan_to_num(np.linalg.norm(vb, axis=1)).max())
    x, y = np.nonzero(va @ vb.T >= threshold - rough)
    keep = ia[x] < ib[y] if same else ia[x] != ib[y]
    x, y = x[keep], y[keep]
    for k in range(0, len(x), CHECKED_PAIRS):
        xs, ys = x[k : k + CHECKED_PAIRS], y[k : k + CHECKED_PAIRS]
        sim = np.clip(np.einsum("ij,ij->i", va[xs].astype(np.float64), vb[ys].astype(np.float64)), -1.0, 1.0)
        ok = sim >= threshold
        p, q = ia[xs[ok]], ib[ys[ok]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(sim[ok])], names=["a", "b", "similarity"])


def block_count(n: int, dim: int, width: int, parallelism: int, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks of at most about ``block_bytes``, and of at least 256 rows if more only serve parallelism.

    Each row is sent once to each block, so rows sent are n times this: fewer, larger blocks send less.
    """
    needed = -(-n * max(dim, 1) * width // block_bytes)
    return max(1, needed, min(math.isqrt(2 * parallelism) + 1, -(-n // 256)))


def similar_pairs(rows: DataFrame, threshold: float, id_column: str = "vec_id", vector: str = "embedding", blocks: int | None = None) -> DataFrame:
    """(a, b, similarity) of all pairs a < b of vectors of one size with cosine >= threshold.

    Vectors are dealt into blocks, and each pair of blocks is a tile: its rows come sorted by side, so
    that a task holds one block of bounded bytes and streams the other against it. Only pairs over the
    threshold leave a task. Null vectors, and those with a null element, have no pairs.
    """
    double = dict(rows.dtypes)[vector] != "array<float>"
    dealt = rows.where(F.col(vector).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>" if double else "array<float>").alias("v"))
    if blocks is None:
        facts = dealt.agg(F.count("*").alias("n"), F.avg(F.size("v")).alias("dim")).first()
        blocks = block_count(facts["n"], int(facts["dim"] or 1), 8 if double else 4, rows.sparkSession.sparkContext.defaultParallelism)
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j"), (k < F.col("block")).cast("int").alias("side")))
    sent = dealt.withColumn("block", own).select(F.explode(tiles).alias("t"), "id", "v").select("t.i", "t.j", "t.side", "id", "v")
    spread = max(1, min(blocks * (blocks + 1) // 2, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * rows.sparkSession.sparkContext.defaultParallelism)))
    sent = sent.repartition(spread, "i", "j").sortWithinPartitions("i", "j", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, {}
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            starts = sorted({0, *cuts.tolist(), *range(0, len(keys), PRODUCT_ROWS)}) if len(keys) else []
            for start, end in zip(starts, [*starts[1:], len(keys)]):
                i, j, side = keys[start].tolist()
                if tile != (i, j):
                    tile, held = (i, j), {}
                part = batch.slice(start, end - start)
                for size, m in _matrices(part.column(3), part.column(4)).items():
                    if side == 1 or i == j:
                        for other in held.get(size, ()):
                            yield from _over(other, m, threshold, False)
                    if side == 0:
                        if i == j:
                            yield from _over(m, m, threshold, True)
                        held.setdefault(size, []).append(m)

    return sent.mapInArrow(run, "a long, b long, similarity double")


def threshold_clusters(rows: DataFrame, threshold: float, order: list[str], id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, component, cluster_id, cluster_size) of every row.

    Components are numbered 0.. in the order of their first member by ``order``, singletons
    included, so ids of the clusters that are kept have gaps.
    """
    edges = similar_pairs(rows, threshold, id_column, vector).select(F.col("a").alias("u"), F.col("b").alias("v"))
    found = components(edges)
    others = [o for o in order if o != "id"]
    members = rows.select(F.col(id_column).cast("long").alias("id"), *others).join(found, F.col("id") == F.col("node"), "left")
    members = members.select("id", *others, F.coalesce("root", "id").alias("component"))
    members = materialise(members, "members")
    first = members.groupBy("component").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("cluster_size"))
    numbered = global_index(first, F.col("first"), F.col("component"), name="cluster_id")
    return members.join(numbered.drop("first"), "component").select("id", "component", "cluster_id", "cluster_size")


def assignments(clusters: DataFrame) -> DataFrame:
    """Clusters of two or more."""
    return clusters.where("cluster_size > 1").select("id", "cluster_id")


def cluster_stats(clusters: DataFrame) -> DataFrame:
    """Components, singletons and the largest; with less than two rows there are no clusters."""
    sizes = clusters.groupBy("component").agg(F.count("*").alias("n"))
    stats = sizes.agg(F.count("*").alias("components"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("largest"), F.sum("n").alias("members"))
    return stats.select(F.when(F.col("members") >= 2, F.col("components")).otherwise(0).alias("cluster_count"), F.col("singletons").alias("singleton_count"), "largest")


def dedup(photos: DataFrame, embeddings: DataFrame, model: str, threshold: float, unembedded: int, recluster: bool = False) -> DataFrame | None:
    """Clusters of the active photos' embeddings; None if nothing was embedded anew and none are asked for."""
    if not unembedded and not recluster:
        return None
    from lumicat.operators.catalog import embedding_rows

    rows = valid_embeddings(embedding_rows(photos, embeddings, model))
    return threshold_clusters(rows, threshold, ["ingested_at_unix_seconds", "id"], id_column="id")
