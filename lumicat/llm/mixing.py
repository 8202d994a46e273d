"""Mixing sources to target weights by packed blocks and index permutations.

Each source's words are packed, document after document, into blocks of a fixed length (the last
one may be shorter). A source's target gives its number of slots, which are dealt to the output shards
by a multinomial draw, each shard alike: of the slots of one shard, the counts by source are then a
multinomial draw with the targets as weights, and all shards together use exactly the slots there are.
The draw is made in two steps, over runs of shards and within a run, by generators that are seeded with
source and run, so executors make it, and reruns agree. A source's j-th slot takes
block ``perm(j mod n)`` of its n blocks, perm being a keyed Feistel permutation for each pass, so
a block is taken once in every pass, and no more often than the target is times the size. Slots
and blocks meet by (source, block index).

Sources, draws, slots, blocks and documents are all tables; the driver sees sums over the sources only.
A source of any size is laid out from bucket sums, never in one task.

Defined results: null text has size 0; a null source is a source of its own, after all others;
documents without words take nothing; repeated rows are laid out one after another and share
the mean of what they take, so each gets its own row; an empty table gives an empty result.
Columns beside doc_id, text and source are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumicat.llm.common import byte_chunks, frugal, materialise, shuffle_partitions
from lumicat.operators.graph import global_index

#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
BLOCK = 128
SLOTS_PER_SHARD = 4096
#: Shards of a run: a task draws for so many at a time.
RUN = 4096
#: A table of sources with more rows is joined by a shuffle.
BROADCAST_ROWS = 100_000
SEED = 17
ROUNDS = 6


def water_fill(sizes: list[int], weights=WEIGHTS, repeat: int = MAX_REPEAT) -> list[float]:
    """Targets that share the total by weight, none above ``repeat`` times its size."""
    total = float(sum(sizes))
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    target = [0.0] * len(sizes)
    free = set(range(len(sizes)))
    left = total
    while free:
        share = left / sum(w[i] for i in free)
        over = [i for i in free if share * w[i] > repeat * sizes[i]]
        if not over:
            for i in free:
                target[i] = share * w[i]
            break
        for i in over:
            target[i] = float(repeat * sizes[i])
            left -= target[i]
            free.remove(i)
    return target


def _generator(*key: int) -> np.random.Generator:
    return np.random.default_rng(list(key))


def draw_runs(source: int, quota: int, shards: int, run: int = RUN, seed: int = SEED) -> list[tuple[int, int, int]]:
    """(run of shards, first slot, slots): a source's slots dealt to runs of shards."""
    runs = -(-shards // run)
    sizes = np.full(runs, run)
    sizes[-1] = shards - run * (runs - 1)
    counts = _generator(seed, source, 0).multinomial(quota, sizes / shards)
    firsts = np.cumsum(counts) - counts
    return [(int(r), int(firsts[r]), int(counts[r])) for r in np.flatnonzero(counts)]


def draw_shards(source: int, runs: list[tuple[int, int, int]], shards: int, run: int = RUN, seed: int = SEED) -> list[tuple[int, int, int]]:
    """(shard, first slot, slots) of those runs."""
    out = []
    for r, first, n in runs:
        size = min(run, shards - r * run)
        counts = _generator(seed, source, r + 1).multinomial(n, np.full(size, 1.0 / size))
        firsts = first + np.cumsum(counts) - counts
        out += [(r * run + int(k), int(firsts[k]), int(counts[k])) for k in np.flatnonzero(counts)]
    return out


def permuted(index: np.ndarray, n: int, key: str) -> np.ndarray:
    """A pseudorandom permutation of [0, n): a Feistel network that walks on until it is in range."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.frombuffer(hashlib.blake2b(key.encode(), digest_size=8 * ROUNDS).digest(), np.uint64)

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    x = network(index.astype(np.uint64))
    while len(out := np.flatnonzero(x >= n)):
        x[out] = network(x[out])
    return x.astype(np.int64)


def with_targets(per_source: DataFrame) -> DataFrame:
    """(source, docs, source_size) with source_no, by code point and null last, and target.

    The level that the free sources share is found by sums over the table: each round takes out those
    that it would lift above the limit, as ``water_fill`` does.
    """
    w = F.element_at(F.array(*(F.lit(x) for x in WEIGHTS)), (F.col("source_no") % len(WEIGHTS) + 1).cast("int"))
    numbered = global_index(per_source, F.col("source").isNull(), F.col("source"), name="source_no").withColumn("weight", w)
    numbered = materialise(numbered, "mix-sources")
    most = F.lit(float(MAX_REPEAT)) * F.col("source_size")
    level, before = 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > most
        r = numbered.agg(F.sum("source_size").alias("total"), F.sum(F.when(over, most)).alias("fixed"), F.sum(F.when(~over, F.col("weight"))).alias("free"), F.count_if(over).alias("n")).first()  # one row
        if r["n"] == before or not r["free"]:
            break
        level, before = (r["total"] - (r["fixed"] or 0.0)) / r["free"], r["n"]
    return numbered.withColumn("target", F.least(F.lit(level) * F.col("weight"), most))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def layout(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, source, copies, size, start): where each document's words lie in its source's stream; the sources).

    A source of n documents is cut into about sqrt(n) hash buckets; running sums are taken within a
    bucket, and bucket sums give the buckets' starts, so no task sorts more than about sqrt(n) rows.
    """
    d = docs.select(
        "doc_id", "source", F.xxhash64("text").alias("text_key"),
        F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).cast("long").alias("size"),
    )
    d = d.groupBy("source", "doc_id", "text_key", "size").agg(F.count("*").alias("copies"))
    d = materialise(d.withColumn("space", F.col("size") * F.col("copies")), "mix-sizes")
    sources = with_targets(d.groupBy("source").agg(F.count("*").alias("docs"), F.sum("space").alias("source_size")))
    names = sources.select("source_no", F.col("source").alias("s_source"), "source_size", "target", F.greatest(F.lit(1), F.floor(F.sqrt("docs"))).cast("long").alias("buckets"))
    d = d.join(_small(names), F.col("source").eqNullSafe(F.col("s_source")))
    d = d.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_key"), "buckets"))
    sums = d.groupBy("source_no", "bucket").agg(F.sum("space").alias("bucket_space"))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source_no").alias("b_no"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("bucket_space").over(before), F.lit(0)).alias("bucket_start"))
    inside = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("within", F.coalesce(F.sum("space").over(inside), F.lit(0)))
    d = d.join(sums, (F.col("source_no") == F.col("b_no")) & (F.col("bucket") == F.col("b_bucket")))
    laid = d.select("doc_id", "text_key", "source_no", "source", "source_size", "target", "size", "copies", "space", (F.col("bucket_start") + F.col("within")).alias("start"))
    return materialise(laid, "mix-layout"), sources


def plan_slots(sources: DataFrame, block: int = BLOCK, slots_per_shard: int = SLOTS_PER_SHARD, seed: int = SEED, run_: int = RUN) -> DataFrame:
    """(shard, source_no, first, n_slots, blocks): which of its slots each source has in each shard."""
    quotas = sources.where("source_size > 0").select("source_no", F.ceil(F.col("source_size") / block).cast("long").alias("blocks"), "target", "source_size")
    quotas = quotas.select("source_no", "blocks", F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long").alias("quota"))
    total = quotas.agg(F.sum("quota")).first()[0] or 0
    shards = max(1, -(-total // slots_per_shard))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, blocks, quota in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [(source, blocks, *r) for r in draw_runs(source, quota, shards, run_, seed)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=["source_no", "blocks", "run", "first", "n_slots"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, blocks, run, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [(s, source, f, k, blocks) for s, f, k in draw_shards(source, [(run, first, n)], shards, run_, seed)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=["shard", "source_no", "first", "n_slots", "blocks"])

    tasks = shuffle_partitions(sources.sparkSession)
    drawn = quotas.mapInArrow(frugal(runs), "source_no long, blocks long, run long, first long, n_slots long").repartition(tasks, "source_no", "run")
    return drawn.mapInArrow(frugal(within), "shard long, source_no long, first long, n_slots long, blocks long")


SLOTS = "shard long, slot long, source_no long, block long, pass int"


def map_slots(plan: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per slot of the mix: its shard, its place there, and the source's block it takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, source, first, count, n in zip(*(c.to_pylist() for c in batch.columns)):
                for a in range(first, first + count, 1 << 18):
                    j = np.arange(a, min(a + (1 << 18), first + count), dtype=np.int64)
                    passes, index = j // n, j % n
                    block = np.empty_like(j)
                    for p in np.unique(passes):
                        block[passes == p] = permuted(index[passes == p], n, f"{seed}:{source}:{p}")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(j), shard)), pa.array(j), pa.array(np.full(len(j), source)), pa.array(block), pa.array(passes.astype(np.int32))],
                        names=["shard", "slot", "source_no", "block", "pass"],
                    )

    spread = plan.repartition(shuffle_partitions(plan.sparkSession), "shard", "source_no")
    return spread.mapInArrow(frugal(run), SLOTS)


def pieces(laid: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per (document, block it has words in): the words of the block's stretch by offsets.

    ``from_word`` and ``to_word`` are offsets in the document's space, copies one after another.
    """
    b = laid.where("space > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + space - 1) div {block}"))))
    return b.withColumn("from_word", F.greatest(F.lit(0), F.col("block") * block - F.col("start"))).withColumn(
        "to_word", F.least("space", (F.col("block") + 1) * block - F.col("start"))
    )


def join_blocks(laid: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pieces of documents with the number of times that the mix takes their block, and in which passes."""
    times = slots.groupBy(F.col("source_no").alias("t_no"), F.col("block").alias("t_block")).agg(F.count("*").alias("times"))
    p = pieces(laid, block)
    # slots grow with the input, though the plan they are made from is small: never broadcast them
    return p.join(times.hint("merge"), (p.source_no == F.col("t_no")) & (p.block == F.col("t_block")))


def mix(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words of each document that the mix takes."""
    laid, sources = layout(docs)
    slots = map_slots(plan_slots(sources, block, seed=seed), seed)
    taken = (
        join_blocks(laid, slots, block)
        .groupBy(F.col("source_no").alias("k_no"), F.col("doc_id").alias("k_doc"), F.col("text_key").alias("k_key"))
        .agg(F.sum((F.col("to_word") - F.col("from_word")) * F.col("times")).alias("words"))
    )
    out = laid.join(taken, (F.col("source_no") == F.col("k_no")) & F.col("doc_id").eqNullSafe(F.col("k_doc")) & (F.col("text_key") == F.col("k_key")), "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    share = F.expr("coalesce(words, 0) div copies + cast(copy <= coalesce(words, 0) % copies as long)")
    return out.select("doc_id", "size", "source_size", "target", share.alias("taken"))


def mixed_ranges(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Per document, copy and pass: the word ranges of the document that the mix takes in that pass."""
    laid, sources = layout(docs)
    slots = map_slots(plan_slots(sources, block, seed=seed), seed).select(F.col("source_no").alias("t_no"), F.col("block").alias("t_block"), "pass")
    p = pieces(laid, block)
    p = p.join(slots.hint("merge"), (p.source_no == F.col("t_no")) & (p.block == F.col("t_block")))
    p = p.withColumn("copy", F.explode(F.sequence(F.expr("from_word div size"), F.expr("(to_word - 1) div size"))))
    p = p.withColumn("start", F.greatest(F.lit(0), F.col("from_word") - F.col("copy") * F.col("size"))).withColumn("stop", F.least("size", F.col("to_word") - F.col("copy") * F.col("size")))
    return p.groupBy("doc_id", "text_key", "source", "copies", "copy", "pass").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("ranges"))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix as documents: a row for each document and pass, its text cut to the words taken.

    ``n_chars`` (if a column) is that of the cut text; other columns stay as they are. Documents
    of which no word is taken are not in the mix.
    """
    import re

    word = re.compile(rb"[^\x20\x09-\x0d]+")
    ranges = materialise(mixed_ranges(docs, block, seed), "mix-ranges")
    ranges = ranges.groupBy(F.col("doc_id").alias("r_doc"), F.col("text_key").alias("r_key"), F.col("source").alias("r_source"), F.col("copies").alias("r_copies")).agg(F.collect_list("ranges").alias("lm_ranges"))
    row = docs.select(F.struct(*docs.columns).alias("lm_row"))
    joined = row.join(ranges, F.col("lm_row.doc_id").eqNullSafe(F.col("r_doc")) & (F.xxhash64("lm_row.text") == F.col("r_key")) & F.col("lm_row.source").eqNullSafe(F.col("r_source")))
    if not ranges.where("r_copies > 1").isEmpty():  # one of repeated rows stands for all of them
        repeated = joined.where("r_copies > 1").dropDuplicates(["r_doc", "r_key", "r_source"])
        joined = joined.where("r_copies = 1").unionByName(repeated)
    spread = joined.select("lm_row.*", F.explode("lm_ranges").alias("lm_range_list"))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in byte_chunks(batches, "text", 1 << 20):
            texts, cut = batch.column(at).to_pylist(), []
            for text, ranges_ in zip(texts, batch.column(len(names)).to_pylist()):
                raw = text.encode()
                spots = [m.span() for m in word.finditer(raw)]
                parts = [raw[spots[a][0] : spots[b - 1][1]] for a, b in merged([(r["start"], r["stop"]) for r in ranges_])]
                cut.append(raw.decode() if parts and len(parts) == 1 and len(parts[0]) >= len(raw.strip()) else b"\n".join(parts).decode())
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(cut, batch.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([len(t) for t in cut], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return spread.mapInArrow(frugal(run), docs.schema)
