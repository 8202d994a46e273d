"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, high bit first; a decision's context is the decisions of its
byte so far and up to ``depth`` bytes before. Each context node has a Krichevsky-Trofimov
estimate from its counts of zeros and ones; a node's weighted probability is half its own
estimate and half the product of its children's (those with one more byte of context), so all
depths are mixed by how well each codes the training texts. The block probabilities depend on
counts alone, so training is one distributed count of (context, byte) pairs, and a decision's
probability mixes the nodes on its path by their posterior weights.

The tree is a table, and no task holds more of it than the subtree of ``SPLIT`` newest context bytes
(at most 2**24 pairs at depth 5; what a language uses of them, in fact), whatever the corpus:

1. Runs of documents (shards of bounded bytes and pairs) put out their distinct pairs, counted over training
   texts, and their texts. Pairs only of held-out texts count 0: such nodes change no probability.
2. Subtrees are weighted bottom-up, each in one task; the levels above them are grouped sums.
3. Mixed probabilities come down again by joins of each level with the one above, then within subtrees,
   which gives the cost of every pair in the corpus.
4. Costs go to the shards that asked for them, and a shard's texts are scored by a table of its own pairs.

The depth is the same at every size.

Texts are lower-cased (A-Z), start in a context of 0xFF bytes (which no UTF-8 text holds) and end
in one. Base: add-one unigrams of words and one end token. The most frequent ``HEAD`` tokens of at most
``HEAD_BYTES`` bytes are broadcast with their counts; all others meet their counts in a join, so no token
is left out and the frequent ones make no hot key.

Defined results: null text is empty (its end is all there is to code); a null doc_id counts as
the empty string in the choice of training texts; without training texts every count is 0;
repeated rows each get their row; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumicat.llm.common import byte_chunks, discard, frugal, materialise

DEPTH = 5
#: Newest context bytes that a subtree, held in one task, shares.
SPLIT = 3
EDGE = 0xFF
HEAD, HEAD_BYTES = 100_000, 64
END_TOKEN = b" "  # no word holds a blank
FOLDS, HELD_OUT = 7, 2
CHUNK_BYTES = 1 << 20
#: A shard ends after so many bytes of text or distinct pairs.
SHARD_BYTES, SHARD_PAIRS = 64 << 20, 1_000_000
FLUSH_TOKENS = 150_000
FLUSH_PAIRS = 500_000
#: Rows of whole subtrees that a task weights at once.
GROUP_ROWS = 200_000
LN10 = math.log(10.0)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


# --- the tree ---------------------------------------------------------------------------------


def sequence(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with ``depth`` edge bytes before and between texts; place of the first byte to code
    and of the end byte of each text)."""
    edge = bytes([EDGE]) * max(1, depth)
    data = np.frombuffer(edge + edge.join(t.lower() for t in texts) + edge, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = len(edge) + np.cumsum(sizes + len(edge)) - len(edge)
    return data, ends - sizes, ends


def windows(data: np.ndarray, depth: int) -> np.ndarray:
    """For every place from ``depth`` on, its context bytes and its byte in one integer."""
    key = np.zeros(len(data) - depth, np.uint64)
    for j in range(depth + 1):
        key <<= np.uint64(8)
        key |= data[j : len(data) - depth + j]
    return key


def coded_keys(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(context and byte of every coded place, first place of each text)."""
    data, starts, ends = sequence(texts, depth)
    keys = windows(data, depth)
    lag = max(1, depth) - 1  # edge bytes after the end byte are not coded
    coded = np.ones(len(data), bool)
    coded[: max(1, depth)] = False
    for k in range(1, lag + 1):
        coded[np.minimum(ends + k, len(data) - 1)] = False
    coded[ends] = True
    sizes = ends - starts + 1
    return keys[coded[depth:]], np.cumsum(sizes) - sizes


def count_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive values: Stirling's series after a shift by eight."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    z = 1.0 / (y * y)
    series = (1.0 / 12 - z * (1.0 / 360 - z * (1.0 / 1260 - z / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of a block with these counts under the KT estimator."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def _node_counts(pairs: np.ndarray, n: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of the b-th decision with their zeros and ones; sorted pairs give sorted nodes."""
    byte = pairs & np.uint64(0xFF)
    keys = (pairs & ~np.uint64(0xFF)) | np.uint64(1 << b) | (byte >> np.uint64(8 - b))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if not len(keys):
        return keys, np.zeros(0), np.zeros(0)
    one = ((byte >> np.uint64(7 - b)) & np.uint64(1)) * n.astype(float)
    total, ones = np.add.reduceat(n.astype(float), first), np.add.reduceat(one, first)
    return keys[first], total - ones, ones


def _drop_oldest(pairs: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of contexts one byte shorter, with summed counts."""
    short = pairs & np.uint64((1 << (8 * depth)) - 1)
    order = np.argsort(short, kind="stable")
    short = short[order]
    if not len(short):
        return short, n
    first = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]]))
    return short[first], np.add.reduceat(n[order], first)


def _levels(pairs: np.ndarray, n: np.ndarray, low: int, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted pairs with their counts, for contexts of ``low`` to ``depth`` bytes."""
    out = [(pairs, n)]
    for d in range(depth, low, -1):
        out.append(_drop_oldest(*out[-1], d))
    return out[::-1]


def weighted(zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight of a node's own estimate, log weighted block probability), from its counts and its children's product."""
    own = log_kt(zeros, ones)
    return 1.0 / (1.0 + np.exp(np.clip(children - own, -700, 700))), np.logaddexp(own, children) - math.log(2.0)


def _climb(levels: list[tuple[np.ndarray, np.ndarray]], low: int, b: int):
    """Of the b-th decision: nodes of each level, their places in the level above, their weights; blocks of the lowest level."""
    nodes = [_node_counts(p, c, b) for p, c in levels]
    parent = [np.zeros(0, np.int64)] + [
        np.searchsorted(nodes[i - 1][0], nodes[i][0] & np.uint64((1 << (8 * (low + i))) - 1)) for i in range(1, len(nodes))
    ]
    weight: list[np.ndarray] = [np.zeros(0)] * len(nodes)
    below = np.zeros(0)
    for i in range(len(nodes) - 1, -1, -1):
        _, zeros, ones = nodes[i]
        if i == len(nodes) - 1:
            weight[i], below = np.ones(len(zeros)), log_kt(zeros, ones)
        else:
            weight[i], below = weighted(zeros, ones, np.bincount(parent[i + 1], weights=below, minlength=len(zeros)))
    return nodes, parent, weight, below


def subtree_blocks(pairs: np.ndarray, n: np.ndarray, low: int, depth: int) -> tuple[np.ndarray, ...]:
    """(node, zeros, ones, log weighted block probability) of the nodes of ``low`` context bytes."""
    levels = _levels(pairs, n, low, depth)
    rows = []
    for b in range(8):
        nodes, _, _, below = _climb(levels, low, b)
        rows.append((*nodes[0], below))
    return tuple(np.concatenate(x) for x in zip(*rows))


def subtree_costs(pairs: np.ndarray, n: np.ndarray, low: int, depth: int, above: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 probability of each of the sorted pairs. ``above``: the nodes of ``low`` context bytes, sorted, with
    the probability of a one that the levels above have mixed, and the weight that they leave."""
    levels = _levels(pairs, n, low, depth)
    costs = np.zeros(len(pairs))
    byte = pairs & np.uint64(0xFF)
    for b in range(8):
        nodes, parent, weight, _ = _climb(levels, low, b)
        at = np.searchsorted(above[0], nodes[0][0])
        mixed, left = above[1][at], above[2][at]
        for i, (_, zeros, ones) in enumerate(nodes):
            kt = (ones + 0.5) / (zeros + ones + 1.0)
            if i:
                mixed, left = mixed[parent[i]], left[parent[i]]
            mixed, left = mixed + left * weight[i] * kt, left * (1.0 - weight[i])
        leaf = np.searchsorted(nodes[-1][0], (pairs & ~np.uint64(0xFF)) | np.uint64(1 << b) | (byte >> np.uint64(8 - b)))
        bit = ((pairs >> np.uint64(7 - b)) & np.uint64(1)).astype(bool)
        costs += np.log(np.where(bit, mixed[leaf], 1.0 - mixed[leaf])) / LN10
    return costs


EMPTY = np.uint64((1 << 64) - 1)
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _slots(keys: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An open hash table of the pairs, at least twice as large as their number."""
    bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
    table, values = np.full(1 << bits, EMPTY), np.zeros(1 << bits)
    todo = np.arange(len(keys))
    at = ((keys * SPREAD) >> np.uint64(64 - bits)).astype(np.int64)
    while len(todo):
        free = table[at] == EMPTY
        table[at[free]] = keys[todo[free]]  # of those that want one slot, the last has it
        placed = table[at] == keys[todo]
        values[at[placed]] = costs[todo[placed]]
        todo, at = todo[~placed], (at[~placed] + 1) & ((1 << bits) - 1)
    return table, values


def costs_of(slots: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The costs of pairs, all of which are in the table."""
    table, values = slots
    bits = len(table).bit_length() - 1
    at = ((keys * SPREAD) >> np.uint64(64 - bits)).astype(np.int64)
    out = values[at]
    todo = np.flatnonzero(table[at] != keys)
    at = at[todo]
    while len(todo):
        if (table[at] == EMPTY).any():
            raise ValueError("a pair without a cost")
        at = (at + 1) & ((1 << bits) - 1)
        hit = table[at] == keys[todo]
        out[todo[hit]] = values[at[hit]]
        todo, at = todo[~hit], at[~hit]
    return out


def log10_probabilities(slots: tuple[np.ndarray, np.ndarray], texts: list[bytes], depth: int) -> np.ndarray:
    keys, firsts = coded_keys(texts, depth)
    return np.add.reduceat(costs_of(slots, keys), firsts)


# --- distributed ------------------------------------------------------------------------------


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, n) over all texts, counted within tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])

        for chunk in byte_chunks(batches, "text", CHUNK_BYTES):
            for text in chunk.column("text").to_pylist():
                seen.update(text.lower().split())
            seen[END_TOKEN] += chunk.num_rows
            if len(seen) > FLUSH_TOKENS:
                yield out()
                seen.clear()
        if seen:
            yield out()

    return texts.mapInArrow(frugal(run), "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in parts)])
    n = np.concatenate([np.zeros(0, np.int64), *(c for _, c in parts)])
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n[order], first)


SHARDS = "shard long, pair long, n long, texts binary"
TEXTS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("row_key", pa.int64()), ("text", pa.binary())])


def shards(docs: DataFrame, depth: int = DEPTH, most_bytes: int = SHARD_BYTES, most_pairs: int = SHARD_PAIRS) -> DataFrame:
    """Runs of documents: a row for each distinct pair, with its count over training texts, and rows of packed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        number = size = held = 0
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def rows(keys: np.ndarray, n: np.ndarray, texts: list[bytes | None]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), base + number)), pa.array(keys.view(np.int64)), pa.array(n), pa.array(texts, pa.binary())], names=["shard", "pair", "n", "texts"])

        for chunk in byte_chunks(batches, "text", CHUNK_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, TEXTS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(chunk.columns, TEXTS)], schema=TEXTS))
            yield rows(np.zeros(1, np.uint64), np.zeros(1, np.int64), [sink.getvalue().to_pybytes()])
            texts, skipped = chunk.column("text").to_pylist(), chunk.column("held_out").to_pylist()
            for of, weight in ((False, 1), (True, 0)):
                some = [t for t, h in zip(texts, skipped) if h is of]
                if some:
                    keys, n = count_keys(coded_keys(some, depth)[0])
                    waiting.append((keys, n * weight))
                    held += len(keys)
            size += sum(map(len, texts))
            if held > FLUSH_PAIRS + len(waiting[0][0]):
                waiting = [_merged(waiting)]
                held = len(waiting[0][0])
            if size >= most_bytes or held >= most_pairs + FLUSH_PAIRS or len(waiting[0][0]) >= most_pairs:
                keys, n = _merged(waiting)
                for a in range(0, len(keys), GROUP_ROWS):
                    yield rows(keys[a : a + GROUP_ROWS], n[a : a + GROUP_ROWS], [None] * len(keys[a : a + GROUP_ROWS]))
                waiting, number, size, held = [], number + 1, 0, 0
        keys, n = _merged(waiting)
        for a in range(0, len(keys), GROUP_ROWS):
            yield rows(keys[a : a + GROUP_ROWS], n[a : a + GROUP_ROWS], [None] * len(keys[a : a + GROUP_ROWS]))

    return docs.select(*TEXTS.names).mapInArrow(frugal(run), SHARDS)


def whole_groups(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of rows sorted by the first one, in runs of whole groups of about ``least`` rows."""
    parts: list[tuple[np.ndarray, ...]] = []
    rows, wanted = 0, least
    for batch in batches:
        if not batch.num_rows:
            continue
        parts.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        rows += batch.num_rows
        if rows < wanted:
            continue
        held = tuple(np.concatenate(x) for x in zip(*parts))
        cut = int(np.argmax(held[0] == held[0][-1]))
        if cut:
            yield tuple(x[:cut] for x in held)
        parts = [tuple(x[cut:] for x in held)]
        rows = len(parts[0][0])
        wanted = max(least, 2 * rows)
    if rows:
        yield tuple(np.concatenate(x) for x in zip(*parts))


def pair_costs(counts: DataFrame, depth: int = DEPTH, split: int = SPLIT) -> DataFrame:
    """(pair, cost): log10 probabilities of counted pairs (pair, n) under the tree of all of them."""
    if not 0 <= depth <= 6:
        raise ValueError("a context has 0 to 6 bytes")
    low = min(split, depth)
    node_of = lambda column, d: column.bitwiseAND(F.lit((1 << (8 * (d + 1))) - 1))
    group_of = lambda column: F.shiftright(node_of(column, low), 8)

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pair, n in whole_groups(batches, GROUP_ROWS):
            order = np.argsort(pair)
            node, zeros, ones, block = subtree_blocks(pair[order].view(np.uint64), n[order], low, depth)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(zeros), pa.array(ones), pa.array(block)], names=["node", "zeros", "ones", "block"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            zeros, ones, children = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("zeros", "ones", "children"))
            weight, block = weighted(zeros, ones, children)
            columns = [*(batch.column(c) for c in ("node", "zeros", "ones")), pa.array(weight), pa.array(block)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "zeros", "ones", "weight", "block"])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, n, mixed, left in whole_groups(batches, GROUP_ROWS):
            node = np.flatnonzero(n < 0)
            node = node[np.argsort(key[node])]
            pair = np.flatnonzero(n >= 0)
            pair = pair[np.argsort(key[pair])]
            pairs = key[pair].view(np.uint64)
            costs = subtree_costs(pairs, n[pair], low, depth, (key[node].view(np.uint64), mixed[node], left[node]))
            yield pa.RecordBatch.from_arrays([pa.array(key[pair]), pa.array(costs)], names=["pair", "cost"])

    grouped = counts.select(group_of(F.col("pair")).alias("g"), "pair", "n")
    nodes = materialise(grouped.repartition("g").sortWithinPartitions("g").mapInArrow(frugal(up), "node long, zeros double, ones double, block double"), "ctw-nodes")
    levels = [nodes]
    for d in reversed(range(low)):
        sums = levels[0].groupBy(node_of(F.col("node"), d).alias("node")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("block").alias("children"))
        levels.insert(0, materialise(sums.mapInArrow(frugal(weigh), "node long, zeros double, ones double, weight double, block double"), "ctw-level"))
    kt = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)
    known = None
    for d in range(low):
        level = levels[d]
        if known is None:
            start = level.withColumn("up_mixed", F.lit(0.0)).withColumn("up_left", F.lit(1.0))
        else:  # the level above has at most 255 nodes for each of 256 ** (d - 1) contexts
            above = known.select(F.col("node").alias("up"), F.col("mixed").alias("up_mixed"), F.col("left").alias("up_left"))
            start = level.join(F.broadcast(above) if d <= 2 else above.hint("merge"), node_of(F.col("node"), d - 1) == F.col("up"))
        known = start.select("node", (F.col("up_mixed") + F.col("up_left") * F.col("weight") * kt).alias("mixed"), (F.col("up_left") * (1.0 - F.col("weight"))).alias("left"))
    if known is None:
        above = nodes.select("node", F.lit(0.0).alias("mixed"), F.lit(1.0).alias("left"))
    else:
        known = known.select(F.col("node").alias("up"), "mixed", "left")
        above = nodes.select("node").join(known.hint("merge"), node_of(F.col("node"), low - 1) == F.col("up")).select("node", "mixed", "left")
    above = above.select(group_of(F.col("node")).alias("g"), F.col("node").alias("key"), F.lit(-1).cast("long").alias("n"), "mixed", "left")
    both = above.unionByName(grouped.select("g", F.col("pair").alias("key"), "n", F.lit(0.0).alias("mixed"), F.lit(0.0).alias("left")))
    out = materialise(both.repartition("g").sortWithinPartitions("g").mapInArrow(frugal(down), "pair long, cost double"), "ctw-costs")
    discard(*levels)
    return out


SCORED = "doc_id long, held_out boolean, row_key long, n_tokens long, n_known long, known_sum double, score double, n_bytes long, rare array<struct<token:binary,n:long>>"


def score_documents(docs: DataFrame, depth: int = DEPTH, head: int = HEAD, most_pairs: int = SHARD_PAIRS, split: int = SPLIT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)."""
    spark = docs.sparkSession
    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.xxhash64("doc_id", "text").alias("row_key"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    counts = materialise(count_tokens(d.where("not held_out").select("text")), "tokens")
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()  # one row
    total, distinct = sums["n"] or 0, sums["v"] or 0
    short = F.octet_length("token") <= HEAD_BYTES
    frequent = counts.where(short).orderBy(F.desc("n"), "token").limit(head).toArrow()  # at most ``head`` rows of ``HEAD_BYTES``
    times = frequent.column("n").to_pylist()
    known = spark.sparkContext.broadcast({t: math.log10(n + 1) for t, n in zip(frequent.column("token").to_pylist(), times)})

    runs = materialise(shards(d, depth, most_pairs=most_pairs), "ctw-shards")
    asked = runs.where("texts is null")
    pairs = materialise(asked.groupBy("pair").agg(F.sum("n").alias("n")), "ctw-pairs")
    costs = pair_costs(pairs, depth, split)
    told = asked.select("shard", "pair").join(costs.hint("merge"), "pair").select("shard", "pair", "cost", F.lit(None).cast("binary").alias("texts"))
    packed = runs.where("texts is not null").select("shard", "pair", F.lit(0.0).alias("cost"), "texts")
    met = told.unionByName(packed).repartition("shard").sortWithinPartitions("shard", F.col("texts").isNotNull())

    def scored_texts(slots: tuple[np.ndarray, np.ndarray], batch: pa.RecordBatch) -> pa.RecordBatch:
        logs, texts = known.value, batch.column("text").to_pylist()
        columns: list[list] = [[], [], [], [], []]
        for text in texts:
            tokens = text.lower().split()
            tokens.append(END_TOKEN)
            found = [logs[t] for t in tokens if t in logs]
            rare = Counter(t for t in tokens if t not in logs) if len(found) < len(tokens) else {}
            row = (len(tokens), len(found), math.fsum(found), len(text), [{"token": t, "n": n} for t, n in rare.items()])
            for c, x in zip(columns, row):
                c.append(x)
        rare_type = pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "held_out", "row_key")), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()),
             pa.array(log10_probabilities(slots, texts, depth)), pa.array(columns[3], pa.int64()), pa.array(columns[4], rare_type)],
            names=["doc_id", "held_out", "row_key", "n_tokens", "n_known", "known_sum", "score", "n_bytes", "rare"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, slots = None, None
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            of, pair, cost = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            text = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(of) != 0) | np.diff(text)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if of[a] != shard:
                    shard, slots, parts = of[a], None, []
                if not text[a]:
                    parts.append((pair[a:b].view(np.uint64).copy(), cost[a:b].copy()))
                    continue
                if slots is None:
                    slots, parts = _slots(*(np.concatenate(x) for x in zip(*parts))), []
                for i in range(a, b):
                    for packed_texts in pa.ipc.open_stream(batch.column(3)[i].as_buffer()):
                        yield scored_texts(slots, packed_texts)

    scored = materialise(met.mapInArrow(frugal(run), SCORED), "scored")
    discard(runs, pairs, costs)
    rare = scored.select(F.col("doc_id").alias("r_doc"), F.col("row_key").alias("r_key"), F.explode("rare").alias("r")).select("r_doc", "r_key", "r.token", F.col("r.n").alias("times"))
    if not scored.groupBy("doc_id", "row_key").count().where("count > 1").isEmpty():  # equal rows meet their counts once
        rare = rare.distinct()
    least = min(times, default=0) if len(times) >= head else 0  # rarer and longer tokens were not all sent out
    met_counts = rare.join(counts.where((F.col("n") <= least) | ~short), "token")
    more = met_counts.groupBy("r_doc", "r_key").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_sum"))
    out = scored.drop("rare").join(more, F.col("doc_id").eqNullSafe(F.col("r_doc")) & (F.col("row_key") == F.col("r_key")), "left")
    floor = math.log10(total + distinct + 1)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("known_sum") + F.coalesce("more_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        "score", (F.col("score") * (-1.0 / math.log10(2.0)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
