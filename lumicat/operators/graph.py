"""Graph operators: connected components by alternating stars over written edge tables (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicat.scratch import discard, materialise

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1))).alias("h")).first()
    return r["n"], r["h"] or 0


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).withColumn("m", F.least("c", "m"))
    return both.where("v > u").join(least, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.withColumnRenamed("u", "c"), F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that an edge (u, v) of longs touches, roots being the least nodes.

    Each round is written, so that lineage stays short; edges of hub nodes are split by adaptive
    execution, as joins here only meet one row of minima for a node.
    """
    now = materialise(edges.select("u", "v").where("u <> v").distinct(), "edges")
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        last, now = now, materialise(_small_star(_large_star(now)), "edges")
        discard(last)
        before, state = state, _state(now)
        if before == state:
            break
    else:
        raise RuntimeError("connected components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = stars.unionByName(stars.select(F.col("root").alias("node"), "root")).distinct()
    found._scratch = now._scratch  # so that discard() takes it
    return found


def global_index(df: DataFrame, *order, name: str = "position") -> DataFrame:
    """Dense positions 0.. in a total order, without a window over all rows.

    Rows are range-partitioned and sorted; counts by partition give the first position of each.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered = materialise(ordered.withColumn("gi_part", F.spark_partition_id()).withColumn("gi_row", F.monotonically_increasing_id()), "indexed")
    counts = ordered.groupBy("gi_part").agg(F.count("*").alias("n"), F.min("gi_row").alias("first")).collect()  # a row for each partition
    starts, total = [], 0
    for r in sorted(counts, key=lambda r: r["gi_part"]):
        starts.append((r["gi_part"], r["first"], total))
        total += r["n"]
    offsets = spark.createDataFrame(starts, "gi_p int, gi_first long, gi_start long")
    joined = ordered.join(F.broadcast(offsets), F.col("gi_part") == F.col("gi_p"))
    return joined.withColumn(name, F.col("gi_start") + F.col("gi_row") - F.col("gi_first")).drop("gi_part", "gi_row", "gi_p", "gi_first", "gi_start")
