"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints of 64 bits link at 3 or fewer differing bits. One half of the word then holds at
most one of them, so every fingerprint emits, for each half, all variants within half the radius
(one bit, rounded down: 33 for a half, 66 in all). Variants are shuffled; where one meets the
half of another fingerprint, the pair is verified over all 64 bits. No link is lost: of two
fingerprints that link, a variant of each is the other's half in at least one of the halves.
(Balls of radius two in the whole word have 2081 variants each; see the README for figures.)

Rows of one fingerprint are one node, so copies cost nothing after the first aggregation. Of the
pairs that meet at one key only a minimum spanning forest is put out. A key with over ``MAX_CHECKS``
pairs to check, or ``MAX_HELD`` rows, is dealt out again with the variants of each quarter of the other
half (one of which also holds at most one differing bit), and such a group with those of each eighth of
the other quarter. What then shares a key agrees in all but 8 bits, save one flipped bit each in the
half, the quarter and the eighth: at most 33 x 17 x 9 x 256, about 1.3 million, fingerprints.

Defined results: null text is empty; texts without words have fingerprint 0 and link as any
other; a component is named by its smallest doc_id (null if it has none); repeated rows each get
their row; columns beside doc_id and text are ignored (``keep_one`` keeps them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumicat.llm.common import byte_chunks, discard, frugal, materialise, shuffle_partitions
from lumicat.operators.graph import components

RADIUS = 3
WIDTH = 3
SEED = 42
MAX_CHECKS = 1 << 28
BLOCK_CELLS = 1 << 22
#: Rows of one key that a task holds; of a key with more, all are dealt out again as they come.
MAX_HELD = 1 << 20
CHUNK_BYTES = 1 << 20


def shingle_hashes(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """XXH64 of each space-joined shingle, repeats included; of all words if they are fewer."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    reach = ends[min(width, len(words)) - 1 :]
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), reach.tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    return majority(shingle_hashes(text.lower().split(), width))


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text, as a signed long."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in byte_chunks(batches, "text", CHUNK_BYTES):
            fps = np.array([fingerprint(t, width) for t in chunk.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return d.mapInArrow(frugal(run), "doc_id long, fp long")


def ball(values: np.ndarray, bits: int) -> np.ndarray:
    """(n, bits + 1): each value and its variants of one flipped bit."""
    flips = np.concatenate([[0], 1 << np.arange(bits, dtype=np.int64)]).astype(np.uint64)
    return values.astype(np.uint64)[:, None] ^ flips[None, :]


def _half(fp: np.ndarray, half: int) -> np.ndarray:
    return (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)


def _emit(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (half number, variant of the half) and the fingerprints that emit them."""
    keys = [(ball(_half(fp, h), 32) | np.uint64(h << 32)).ravel() for h in (0, 1)]
    return np.concatenate(keys), np.tile(np.repeat(fp, 33), 2)


def _emit_again(key: np.ndarray, more: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, more, fingerprint) rows that deal a group out again. ``more`` is 0 for a key of a half; with a
    mark, the number and the variant of a quarter of the other half; then also those of an eighth of the other quarter."""
    other = 1 - (key >> np.uint64(32)).astype(np.int64)
    rest = np.where(other == 1, _half(fp, 1), _half(fp, 0))
    first = more == 0
    out = []
    for now, width in ((first, 16), (~first, 8)):
        if not now.any():
            continue
        k, m, f, r = key[now], more[now], fp[now], rest[now]
        if width == 8:  # the quarter that ``more`` doesn't name
            r = (r >> (np.uint64(16) * (np.uint64(1) - ((m >> np.uint64(16)) & np.uint64(1))))) & np.uint64(0xFFFF)
        for q in (0, 1):
            part = ball((r >> np.uint64(width * q)) & np.uint64((1 << width) - 1), width)
            if width == 16:
                code = part | np.uint64(q << 16) | np.uint64(1 << 17)
            else:
                code = m[:, None] | (part << np.uint64(20)) | np.uint64(q << 28) | np.uint64(1 << 29)
            out.append((np.repeat(k, width + 1), code.ravel(), np.repeat(f, width + 1)))
    return tuple(np.concatenate(x) for x in zip(*out))


def forest(fp: np.ndarray, centre: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of links between centres and all members, nearest links first."""
    root = np.arange(len(fp))
    edges: list[tuple[int, int]] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    rows = np.flatnonzero(centre)
    step = max(1, BLOCK_CELLS // len(fp))
    for a in range(0, len(rows), step):
        block = rows[a : a + step]
        d = np.bitwise_count(fp[block][:, None] ^ fp[None, :])
        while True:
            while not np.array_equal(up := root[root], root):
                root[:] = up
            label = root
            open_ = np.where((d > radius) | (label[block][:, None] == label[None, :]), np.uint8(255), d)
            col = open_.argmin(1)
            best = open_[np.arange(len(block)), col]
            row = open_.argmin(0)
            best_col = open_[row, np.arange(len(fp))]
            found = [(int(x), int(block[i]), int(col[i])) for i, x in enumerate(best) if x <= radius]
            found += [(int(x), int(block[row[j]]), j) for j, x in enumerate(best_col) if x <= radius]
            if not found:
                break
            for _, i, j in sorted(found):
                x, y = find(i), find(j)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    edges.append((i, j))
    return edges


FOUND = "u long, v long, key long, more long, fp long"


def _rows(links_: list[tuple[int, int]], again: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    u, v = (pa.array([x[i] for x in links_], pa.int64()) for i in (0, 1))
    keys, more = (np.concatenate([np.full(len(x[2]), x[i], np.int64) for x in again] or [np.zeros(0, np.int64)]) for i in (0, 1))
    fps = np.concatenate([x[2] for x in again] or [np.zeros(0, np.int64)])
    none = pa.nulls(len(keys), pa.int64()), pa.nulls(len(u), pa.int64())
    whole = [pa.concat_arrays([x, none[0]]) for x in (u, v)] + [pa.concat_arrays([none[1], pa.array(x)]) for x in (keys, more, fps)]
    return pa.RecordBatch.from_arrays(whole, names=["u", "v", "key", "more", "fp"])


def _meet(refine: bool, radius: int, max_checks: int, max_held: int):
    """Reads rows sorted by key; puts out forests of links, and the rows of keys with too many pairs."""

    def flush(keys: np.ndarray, more: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(keys) != 0) | (np.diff(more) != 0)]))
        sizes = np.diff(np.append(starts, len(keys)))
        word = fps.view(np.uint64)
        half = keys.view(np.uint64) >> np.uint64(32)
        own = np.where(half == 1, _half(word, 1), _half(word, 0)) == (keys.view(np.uint64) & np.uint64(0xFFFFFFFF))
        centres = np.add.reduceat(own.astype(np.int64), starts)
        out: list[tuple[int, int]] = []
        again: list[tuple[int, int, np.ndarray]] = []
        for k in np.flatnonzero((sizes > 1) & (centres > 0)):
            a, b = starts[k], starts[k] + sizes[k]
            if refine and int(centres[k]) * int(sizes[k]) > max_checks:
                again.append((int(keys[a]), int(more[a]), fps[a:b]))
                continue
            members, first = np.unique(fps[a:b], return_index=True)
            out += [(int(members[i]), int(members[j])) for i, j in forest(members.view(np.uint64), own[a:b][first], radius)]
        if out or again:
            yield _rows(out, again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.zeros(0, np.int64) for _ in range(3))
        passing: tuple[int, int] | None = None  # a key of which too many rows have come
        for batch in batches:
            now = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if passing is not None:
                n = int(((now[0] == passing[0]) & (now[1] == passing[1])).sum())
                if n:
                    yield _rows([], [(*passing, now[2][:n])])
                now = tuple(x[n:] for x in now)
            if not len(now[0]):
                continue
            passing = None
            now = tuple(np.concatenate([x, y]) for x, y in zip(held, now))
            last = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            cut = len(last) - int(last.sum())
            if cut:
                yield from flush(*(x[:cut] for x in now))
            held = tuple(x[cut:] for x in now)
            if refine and len(held[0]) > max_held:
                passing = int(held[0][0]), int(held[1][0])
                yield _rows([], [(*passing, held[2])])
                held = tuple(x[:0] for x in held)
        if len(held[0]):
            yield from flush(*held)

    return run


def links(distinct_fps: DataFrame, radius: int = RADIUS, max_checks: int = MAX_CHECKS, max_held: int = MAX_HELD) -> DataFrame:
    """(u, v): spanning links among distinct fingerprints (a column ``fp`` of longs)."""
    if not 0 <= radius <= 3:
        raise ValueError("one flipped bit in each half covers radii up to 3")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for a in range(0, len(fp), 4096):
                keys, fps = _emit(fp[a : a + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.zeros(len(keys), np.int64)), pa.array(fps.view(np.int64))], names=["key", "more", "fp"])

    def emit_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = tuple(c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns)
            for a in range(0, len(rows[0]), 4096):
                dealt = _emit_again(*(x[a : a + 4096] for x in rows))
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in dealt], names=["key", "more", "fp"])

    keyed = "key long, more long, fp long"
    # each row becomes 66, so few small partitions are dealt out first
    spread = distinct_fps.select("fp").repartition(shuffle_partitions(distinct_fps.sparkSession), "fp")
    variants, out = spread.mapInArrow(frugal(emit), keyed), None
    for level in range(3):
        met = variants.repartition("key", "more").sortWithinPartitions("key", "more", "fp").mapInArrow(frugal(_meet(level < 2, radius, max_checks, max_held)), FOUND)
        met = materialise(met, "links")
        found = met.where("u is not null").select("u", "v")
        out = found if out is None else out.unionByName(found)
        again = met.where("key is not null").select("key", "more", "fp").distinct()
        if level == 2 or again.isEmpty():
            return out
        variants = again.mapInArrow(frugal(emit_again), keyed)


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    fps = materialise(fingerprints(docs, width), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(nodes, radius))
    named = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialise(named, "components")
    least = named.groupBy(F.col("root").alias("c_root")).agg(F.min("least").alias("component_id"))
    of = named.join(least, F.col("root") == F.col("c_root")).select(F.col("fp").alias("n_fp"), "component_id")
    return fps.join(of, F.col("fp") == F.col("n_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- documents: one of each group stays ------------------------------------------------------

SIMILARITY = 0.8
SHINGLE = 5
BROADCAST_ROWS = 1_000_000
#: Longs of a text's parity bitmap.
SIGNATURE = 16
#: One text of so many is counted to see which shingles are frequent, and so many of those are kept.
SAMPLED, FREQUENT, MIN_SAMPLED = 16, 200_000, 4
#: Longs of the smaller bitmap that is carried with each shingle.
FOLDED = 4
#: While unconnected texts have more pairs than so many a row, a round joins each shingle's texts with so many of them,
#: unless the last such round linked less than one text in so many rows.
PAIRS_PER_ROW, CENTRES, ROWS_PER_LINK, MAX_STARS = 8, 4, 500, 4


def shingle_set(text: bytes, width: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes(text.lower().split(), width))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if counted rows (of a few longs) are under the bound; joined by a shuffle beyond it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _need(similarity: float, sizes):
    """The least overlap of two sets of these sizes in all that are that similar."""
    return sizes * (similarity / (1 + similarity)) - 1e-6


def prefix(shingles: np.ndarray, frequent: np.ndarray, times: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in the total order (times seen in the sample, hash).

    Sets that are similar enough share one of these, whatever the order is; rare ones first keep groups small.
    """
    n = len(shingles)
    if not n:
        return np.zeros(1, np.uint64)  # texts without words meet at one key
    rank = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        rank = np.where(frequent[at] == shingles, times[at], 0)
    keep = n - math.ceil(similarity * n - 1e-6) + 1
    return shingles[np.lexsort((shingles, rank))[:keep]]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Parities of the set's hashes by cell: sets differ in at least as many elements as these in bits."""
    cells = np.bincount((shingles >> np.uint64(20)).astype(np.int64) % (64 * SIGNATURE), minlength=64 * SIGNATURE) & 1
    return np.packbits(cells.astype(bool), bitorder="little").view(np.int64)


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample of the texts, sorted, and how often they are; only speed depends on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in byte_chunks(batches, "text", CHUNK_BYTES):
            seen = np.concatenate([shingle_set(t) for t in chunk.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64))], names=["shingle"])

    some = docs.where(F.pmod("text_key", F.lit(SAMPLED)) == 0).select("text").mapInArrow(frugal(run), "shingle long")
    top = some.groupBy("shingle").count().where(F.col("count") >= MIN_SAMPLED).orderBy(F.desc("count"), "shingle").limit(FREQUENT).toArrow()  # at most FREQUENT rows
    shingles, times = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(shingles)
    return shingles[order], times[order]


def _shingled(docs: DataFrame, similarity: float) -> DataFrame:
    """(k, fp, n, prefix, s0..): of each text its fingerprint, its number of shingles, their prefix and their signature."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs))
    names = [f"s{i}" for i in range(SIGNATURE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in byte_chunks(batches, "text", CHUNK_BYTES):
            hashes = [shingle_hashes(t.lower().split(), SHINGLE) for t in chunk.column("text").to_pylist()]
            fps = pa.array(np.array([majority(x) for x in hashes], np.uint64).view(np.int64))
            sets = [np.unique(x) for x in hashes]
            first = [prefix(x, *frequent.value, similarity).view(np.int64) for x in sets]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in first])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first)))
            signs = np.array([signature(x) for x in sets])
            sizes = pa.array([len(x) for x in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([chunk.column("text_key"), fps, sizes, lists, *(pa.array(signs[:, i].copy()) for i in range(SIGNATURE))], names=["k", "fp", "n", "prefix", *names])

    return docs.select("text_key", "text").mapInArrow(frugal(run), "k long, fp long, n int, prefix array<long>, " + ", ".join(f"{s} long" for s in names))


def _verified(pairs: DataFrame, signs: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """(u, v): the pairs (a, b) that are similar; those whose signatures rule it out go before texts are read."""
    pairs = materialise(pairs, "met")
    ends = pairs.select(F.col("a").alias("e")).unionByName(pairs.select(F.col("b").alias("e"))).distinct()
    some = signs.join(_small(ends), F.col("k") == F.col("e"), "left_semi")
    left = some.select(F.col("k").alias("a"), F.col("n").alias("na"), *(F.col(f"s{i}").alias(f"a{i}") for i in range(SIGNATURE)))
    right = some.select(F.col("k").alias("b"), F.col("n").alias("nb"), *(F.col(f"s{i}").alias(f"b{i}") for i in range(SIGNATURE)))
    apart = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(SIGNATURE)), F.lit(0))
    close = pairs.join(left, "a").join(right, "b").where(F.col("na") + F.col("nb") - apart >= 2 * _need(similarity, F.col("na") + F.col("nb")))
    close = materialise(close.select("a", "b"), "candidates")
    ends = close.select(F.col("a").alias("e")).unionByName(close.select(F.col("b").alias("e"))).distinct()
    texts = docs.select("text_key", "text").join(_small(ends), F.col("text_key") == F.col("e"), "left_semi")
    texts = materialise(texts.dropDuplicates(["text_key"]), "candidate-texts")
    half = close.join(texts.select(F.col("text_key").alias("a"), F.col("text").alias("text_a")), "a")
    full = half.join(texts.select(F.col("text_key").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in byte_chunks(batches, "text_a", CHUNK_BYTES):
            sets: dict[int, np.ndarray] = {}
            keep = []
            for a, b, x, y in zip(*(c.to_pylist() for c in chunk.columns)):
                for k, t in ((a, x), (b, y)):
                    if k not in sets:
                        sets[k] = shingle_set(t)
                keep.append(jaccard(sets[a], sets[b]) >= similarity)
            kept = chunk.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["u", "v"])

    out = materialise(full.mapInArrow(frugal(verify), "u long, v long"), "verified")
    discard(pairs, close, texts)
    return out


def _ball_pairs(shingled: DataFrame) -> DataFrame:
    """(a, b): texts of one fingerprint with the least of them, and the least texts of fingerprints that link."""
    nodes = materialise(shingled.groupBy("fp").agg(F.min("k").alias("least")), "text-fingerprints")
    found = links(nodes)
    left, right = (nodes.select(F.col("fp").alias(x), F.col("least").alias(y)) for x, y in (("u", "a"), ("v", "b")))
    between = found.join(left, "u").join(right, "v").select("a", "b")
    within = shingled.select("fp", "k").join(nodes.withColumnRenamed("fp", "f"), F.col("fp") == F.col("f")).where("k <> least").select(F.col("least").alias("a"), F.col("k").alias("b"))
    return between.unionByName(within)


def text_links(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(u, v): links of text keys whose sets of five-word shingles are at least that similar; their
    components are those of all such pairs.

    First come the pairs whose SimHash fingerprints (of five-word shingles) meet in a ball, verified. A forest
    of balls can miss pairs behind a link that fails, and similar short texts can lie outside of every ball,
    so an exact join completes them: similar sets share a shingle of their prefixes, so all pairs of texts that
    share one and are not yet connected are candidates, less those that sizes, positions or signatures
    rule out. While these pairs are many for the rows there are, a round joins each shingle's texts with a few
    of them only, and connects what it can; the last round verifies every pair that is left.
    """
    shingled = materialise(_shingled(docs, similarity).dropDuplicates(["k"]), "shingled")
    signs = shingled.drop("prefix", "fp")
    out = _verified(_ball_pairs(shingled), signs, docs, similarity)
    place = F.col("n").cast("long") * F.lit(1 << 32) + F.col("at")
    posted = shingled.select("k", "n", F.posexplode("prefix").alias("at", "shingle")).select("k", place.alias("place"), "shingle")
    of = Window.partitionBy("shingle")
    shared = posted.withColumn("texts", F.count("*").over(of)).where("texts > 1")
    shared = shared.select("k", "shingle", F.expr("cast(shiftright(place, 32) as int)").alias("n"), F.expr("cast(place & 4294967295 as int)").alias("at"))
    names = [f"f{j}" for j in range(FOLDED)]
    folded = [reduce(lambda x, y: x.bitwiseXOR(y), (F.col(f"s{i}") for i in range(j, SIGNATURE, FOLDED))).alias(f) for j, f in enumerate(names)]
    marks = shingled.select(F.col("k").alias("mk"), *folded)
    before = materialise(shared, "shared-shingles")
    shared = materialise(before.join(marks, F.col("k") == F.col("mk")).drop("mk").withColumn("c", F.col("k")), "marked-shingles")
    discard(before)
    sizes = F.col("n") + F.col("n2")
    apart = sum((F.bit_count(F.col(f).bitwiseXOR(F.col(f"{f}2"))) for f in names), F.lit(0))
    possible = (F.least("n", "n2") >= F.greatest("n", "n2") * F.lit(similarity) - 1e-6) & (F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) >= _need(similarity, sizes)) & (sizes - apart >= 2 * _need(similarity, sizes))
    ordered = (F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b"))
    columns = ["k", "n", "at", "c", *names]
    links_ = out
    for turn in range(MAX_STARS + 1):
        found = components(out)
        named = shared.drop("c").join(found, F.col("k") == F.col("node"), "left").select("shingle", *columns[:3], F.coalesce("root", "k").alias("c"), *names)
        parts = named.groupBy(F.col("shingle").alias("o"), F.col("c").alias("oc")).agg(F.count("*").alias("m"))
        open_ = parts.groupBy("o").agg(F.count("*").alias("kinds"), F.sum("m").alias("all"), F.sum(F.col("m").cast("double") * F.col("m")).alias("inside")).where("kinds > 1")
        open_ = materialise(open_, "open")
        before, shared = shared, materialise(named.join(open_.select("o"), F.col("shingle") == F.col("o"), "left_semi"), "open-shingles")
        discard(before)
        rows, pairs = open_.agg(F.sum("all"), F.sum((F.col("all").cast("double") * F.col("all") - F.col("inside")) / 2)).first()  # one row
        enough = not turn or links_.count() * ROWS_PER_LINK >= (rows or 0)
        last = turn == MAX_STARS or not enough or (pairs or 0) <= PAIRS_PER_ROW * (rows or 0)
        if last:
            other = shared.select(F.col("shingle").alias("o"), *(F.col(x).alias(f"{x}2") for x in columns))
            met = shared.join(other, (F.col("shingle") == F.col("o")) & (F.col("k") < F.col("k2")) & (F.col("c") != F.col("c2")) & possible)
        else:
            some = [F.min(F.struct(F.xxhash64("k", F.lit(turn * CENTRES + i)).alias("h"), *(F.col(x).alias(f"{x}2") for x in columns))) for i in range(CENTRES)]
            other = shared.groupBy(F.col("shingle").alias("o")).agg(F.array(*some).alias("m")).select("o", F.explode("m").alias("m")).select("o", *(f"m.{x}2" for x in columns)).distinct()
            met = shared.join(other, (F.col("shingle") == F.col("o")) & (F.col("c") != F.col("c2")) & possible)
        links_ = _verified(met.select(*ordered).distinct(), signs, docs, similarity)
        out = out.unionByName(links_)
        discard(found, open_)
        if last:
            break
    discard(shared, shingled)
    return out


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The document of the smallest doc_id of each near-duplicate group, with all its columns.

    Texts without words are equal to each other. A document without doc_id stays only if no other
    of its group has one.
    """
    keyed = docs.select(F.col("doc_id").alias("k_doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = keyed.groupBy("text_key").agg(F.min("k_doc").alias("least"))
    found = components(text_links(texts, similarity))
    named = rows.join(found, F.col("text_key") == F.col("node"), "left").select("text_key", "least", F.coalesce("root", "text_key").alias("root"))
    best = named.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least"), F.col("text_key"))).alias("m"))
    keepers = best.select(F.col("m.least").alias("k_doc"), F.col("m.text_key").alias("k_key"))
    copies = keyed.groupBy("k_doc", "text_key").agg(F.count("*").alias("n")).select(F.col("k_doc").alias("c_doc"), F.col("text_key").alias("c_key"), "n")
    marked = copies.join(keepers, F.col("k_doc").eqNullSafe(F.col("c_doc")) & (F.col("k_key") == F.col("c_key")), "left")
    # rows that go, and keepers of which equal rows would stay
    marked = materialise(marked.select("c_doc", "c_key", "n", F.col("k_key").isNotNull().alias("keeper")).where("not keeper or n > 1"), "keepers")
    row = docs.select(F.struct(*docs.columns).alias("lm_row"))
    meets = F.col("lm_row.doc_id").eqNullSafe(F.col("c_doc")) & (F.xxhash64(F.coalesce("lm_row.text", F.lit(""))) == F.col("c_key"))
    kept = row.join(_small(marked.select("c_doc", "c_key")), meets, "left_anti")
    twice = marked.where("keeper")
    if not twice.isEmpty():
        kept = kept.unionByName(row.join(_small(twice), meets).dropDuplicates(["c_doc", "c_key"]).select("lm_row"))
    return kept.select("lm_row.*")
