"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of consecutive rows of a task, bounded by words. Its index holds the words that
occur in the benchmark; other words and the ends of texts are separators (no window crosses them),
and stretches between separators that are shorter than the shortest window are left out. The
Burrows-Wheeler transform of that word sequence is kept in a wavelet matrix with rank counts;
every test window is found by backward search, all windows at once; occurrences are located by
walking back to suffix positions sampled at every eighth place; overlapping spans are merged.

The index needs no shuffle, and its size is bounded by the shard. The benchmark is cut into parts of about
``PART_BYTES`` of text (a long item into pieces that overlap by a window less one word), which executors
encode and write to the shared folder; the driver sees their paths only. Every shard is searched for each
part in turn, and spans and items are merged, so a benchmark of any size gives whole results, and a worker
holds one part at a time.

Defined results: a null or empty text has no words and no hits; an item without words has no
window; items of equal text all count; a null item_id is left out of the list of items; repeated
rows each get their row; an empty benchmark hits nothing; columns beside those named are ignored
(``clean`` keeps them).
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicat.llm.common import ALNUM_TABLE, byte_chunks, frugal, open_fs, scratch_path

WINDOW = 10
SAMPLE = 8
SHARD_BYTES = 4 << 20
CHUNK_BYTES = 1 << 20
PATTERNS_AT_ONCE = 8192
PART_BYTES = 4 << 20
SENTINEL, SEPARATOR, FIRST_WORD = 0, 1, 2

HITS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,stop:long>>"
WORD_SPANS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(ALNUM_TABLE).split()


class RankBits:
    """Bits with the number of ones before any place in constant time: 64-bit words and block counts."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.ones = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Symbols by bit levels, highest first; rank of a symbol before a place, and access."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels: list[tuple[int, RankBits, int]] = []
        for shift in reversed(range(max(1, int(size - 1).bit_length()))):
            bits = (symbols >> shift) & 1
            ranked = RankBits(bits)
            zeros = len(symbols) - ranked.ones
            self.levels.append((shift, ranked, zeros))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        low = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            a, b = bits.rank(low), bits.rank(i)
            low = np.where(one, zeros + a, low - a)
            i = np.where(one, zeros + b, i - b)
        return i - low

    def access(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(i)
        for _, bits, zeros in self.levels:
            one = bits.get(i).astype(bool)
            ones = bits.rank(i)
            symbol = symbol * 2 + one
            i = np.where(one, zeros + ones, i - ones)
        return symbol


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    new = np.concatenate([[True], np.diff(text[order]) != 0])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    step = 1
    while True:
        alone = new & np.concatenate([new[1:], [True]])
        places = np.flatnonzero(~alone)
        if not len(places):
            return order
        suffix = order[places]
        following = np.where(suffix + step < n, rank[np.minimum(suffix + step, n - 1)] + 1, 0)
        key = rank[suffix] * (n + 1) + following
        by = np.argsort(key, kind="stable")
        order[places] = suffix[by]
        key = key[by]
        fresh = np.concatenate([[True], np.diff(key) != 0])
        new[places] = fresh
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[places]] = start[places]
        step *= 2


class FMIndex:
    """Backward search and location over a sequence of symbols that ends in the sole SENTINEL."""

    def __init__(self, text: np.ndarray, size: int):
        sa = suffix_array(text)
        self.n = len(text)
        bwt = text[sa - 1]
        self.wavelet = WaveletMatrix(bwt, size)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        kept = sa % SAMPLE == 0
        self.marked = RankBits(kept)
        self.samples = sa[kept]

    def count(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns, given as right-aligned rows of symbols."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        for k in range(width):
            live = np.flatnonzero((lengths > k) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, width - 1 - k]
            base = self.smaller[symbol]
            low[live] = base + self.wavelet.rank(symbol, low[live])
            high[live] = base + self.wavelet.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        place = np.empty(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            sampled = self.marked.get(at).astype(bool)
            hit = todo[sampled]
            place[hit] = self.samples[self.marked.rank(at[sampled])] + steps
            todo, at = todo[~sampled], at[~sampled]
            if len(todo):
                symbol = self.wavelet.access(at)
                at = self.smaller[symbol] + self.wavelet.rank(symbol, at)
            steps += 1
        return place


class _Ids(dict):
    def __missing__(self, key):
        return SEPARATOR


@dataclass
class Benchmark:
    """Vocabulary, distinct windows and the items that each window belongs to."""

    ids: dict = field(default_factory=dict)
    windows: np.ndarray = None
    lengths: np.ndarray = None
    owner_cuts: np.ndarray = None
    owners: np.ndarray = None
    item_names: list = field(default_factory=list)

    @property
    def shortest(self) -> int:
        return int(self.lengths.min()) if len(self.lengths) else 0


def build_benchmark(items: list[tuple[str | None, bytes]], window: int = WINDOW) -> Benchmark:
    """Of (name, text) items, the distinct windows in one matrix, and the items of each."""
    b = Benchmark(item_names=[name for name, _ in items])
    rows, sizes, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, (_, text) in enumerate(items):
        coded = np.array([b.ids.setdefault(w, len(b.ids) + FIRST_WORD) for w in words_of(text)], np.int32)
        if not len(coded):
            continue
        if len(coded) < window:
            coded = np.concatenate([np.zeros(window - len(coded), np.int32), coded])
        found = np.lib.stride_tricks.sliding_window_view(coded, window)
        rows.append(found)
        sizes.append(np.count_nonzero(found, axis=1))
        owners.append(np.full(len(found), k))
    every, size, owner = np.concatenate(rows), np.concatenate(sizes), np.concatenate(owners)
    b.windows, first, which = np.unique(every, axis=0, return_index=True, return_inverse=True)
    b.lengths = size[first]
    pairs = np.unique(which.reshape(-1) * (len(items) + 1) + owner)
    b.owners = pairs % (len(items) + 1)
    b.owner_cuts = np.searchsorted(pairs // (len(items) + 1), np.arange(len(b.windows) + 1))
    return b


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All integers of [start, start + count) of each pair, one after another."""
    total = int(counts.sum())
    jump = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return jump + np.arange(total)


def search_shard(texts: list[bytes], bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text; text, start and stop of each merged span; distinct (text, item) pairs)."""
    ids = _Ids(bench.ids)
    code = ids.__getitem__
    codes = []
    for t in texts:  # one text's words at a time
        words = words_of(t)
        codes.append(np.fromiter(map(code, words), np.int32, len(words)))
    n_words = np.array([len(c) for c in codes], np.int64)
    none = np.zeros(0, np.int64)
    empty = (n_words, none, none, none, np.zeros((0, 2), np.int64))
    if not len(bench.lengths):
        return empty
    # a separator after each text
    bases = np.concatenate([[0], np.cumsum(n_words + 1)])
    symbols = np.full(int(bases[-1]), SEPARATOR, np.int64)
    for base, c in zip(bases, codes):
        symbols[base : base + len(c)] = c
    del codes
    known = np.concatenate([[0], (symbols != SEPARATOR).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(known))
    starts, stops = edges[::2], edges[1::2]
    long = stops - starts >= bench.shortest
    starts, counts = starts[long], (stops - starts)[long]
    if not len(starts):
        return empty
    # each stretch with the separator that follows it
    origin = _ranges(starts, counts + 1)
    text = np.append(symbols[origin], SENTINEL)
    index = FMIndex(text, len(bench.ids) + FIRST_WORD)
    found_at, found_len, pairs = [], [], []
    for k in range(0, len(bench.lengths), PATTERNS_AT_ONCE):
        lengths = bench.lengths[k : k + PATTERNS_AT_ONCE]
        low, high = index.count(bench.windows[k : k + PATTERNS_AT_ONCE].astype(np.int64), lengths)
        hit = np.flatnonzero(high > low)
        if not len(hit):
            continue
        times = (high - low)[hit]
        at = origin[index.locate(_ranges(low[hit], times))]
        found_at.append(at)
        found_len.append(np.repeat(lengths[hit], times))
        window = np.repeat(hit + k, times)
        doc = np.searchsorted(bases, at, side="right") - 1
        seen = np.unique(np.stack([doc, window], 1), axis=0)
        owners = bench.owner_cuts[seen[:, 1] + 1] - bench.owner_cuts[seen[:, 1]]
        item = bench.owners[_ranges(bench.owner_cuts[seen[:, 1]], owners)]
        pairs.append(np.unique(np.stack([np.repeat(seen[:, 0], owners), item], 1), axis=0))
    if not found_at:
        return empty
    start, stop = merged(np.concatenate(found_at), np.concatenate(found_len))
    doc = np.searchsorted(bases, start, side="right") - 1
    return n_words, doc, start - bases[doc], stop - bases[doc], np.unique(np.concatenate(pairs), axis=0)


def merged(at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops): spans that overlap or touch are one; a separator keeps those of different texts apart."""
    order = np.argsort(at, kind="stable")
    at, reach = at[order], np.maximum.accumulate((at + size)[order])
    first = np.concatenate([[True], at[1:] > reach[:-1]])
    return at[first], reach[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(at) - 1]])]


def write_parts(benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> list[str]:
    """Encode the benchmark in parts on the executors; their paths in the shared folder."""
    b = benchmark.select(F.col("item_id").cast("string").alias("name"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, piece = max(1, -(-size // part_bytes)), max(1, part_bytes // 4)
    folder = scratch_path(benchmark.sparkSession, "benchmark")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in byte_chunks(batches, "text", CHUNK_BYTES):
            for name, text in zip(chunk.column("name").to_pylist(), chunk.column("text").to_pylist()):
                words, start = words_of(text), 0
                ends = np.cumsum([len(w) + 1 for w in words])
                while start < len(words):
                    base = ends[start - 1] if start else 0
                    stop = max(start + window, int(np.searchsorted(ends, base + piece, side="right")))
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([b" ".join(words[start:stop])], pa.binary())], names=["name", "text"])
                    if stop >= len(words):
                        break
                    start = stop - window + 1

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str | None, bytes]] = []
        part = None

        def out() -> pa.RecordBatch:
            fs, path = open_fs(f"{folder}/{part}")
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            draft = f"{path}.{uuid.uuid4().hex}"  # moved, so that a task that runs again leaves one file
            with fs.open_output_stream(draft, compression=None) as f:
                pickle.dump(build_benchmark(sorted(held, key=repr), window), f, protocol=5)
            fs.move(draft, path)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{part}"])], names=["path"])

        for batch in batches:
            for p, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held and p != part:
                    yield out()
                    held.clear()
                part = p
                held.append((name, text))
        if held:
            yield out()

    pieces = b.mapInArrow(frugal(cut), "name string, text binary").select(F.pmod(F.xxhash64("name", "text"), F.lit(parts)).alias("part"), "name", "text")
    written = pieces.repartition("part").sortWithinPartitions("part").mapInArrow(frugal(write), "path string")
    return sorted(r[0] for r in written.collect())  # a path for each part


_loaded: dict[str, Benchmark] = {}


def load_part(uri: str) -> Benchmark:
    """A part of the benchmark; the worker keeps the last one that it has read."""
    if uri not in _loaded:
        _loaded.clear()
        fs, path = open_fs(uri)
        with fs.open_input_stream(path, compression=None) as f:
            _loaded[uri] = pickle.load(f)
    return _loaded[uri]


def search(texts: list[bytes], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
    """(words of each text; text, start and stop of each merged span; names of the items that each text has)."""
    names: list[set[str]] = [set() for _ in texts]
    found, n_words = [], None
    for uri in paths:
        bench = load_part(uri)
        n_words, doc, start, stop, pairs = search_shard(texts, bench)
        found.append((doc, start, stop))
        for d, item in pairs.tolist():
            if bench.item_names[item] is not None:
                names[d].add(bench.item_names[item])
    if n_words is None:
        n_words = np.array([len(words_of(t)) for t in texts], np.int64)
    doc, start, stop = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
    if len(found) > 1 and len(doc):
        bases = np.concatenate([[0], np.cumsum(n_words + 1)])
        start, stop = merged(bases[doc] + start, stop - start)
        doc = np.searchsorted(bases, start, side="right") - 1
        start, stop = start - bases[doc], stop - bases[doc]
    return n_words, doc, start, stop, names


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per document: words, words inside any occurrence of a window, items met, merged word spans."""
    paths = write_parts(benchmark, window, part_bytes)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in byte_chunks(batches, "text", SHARD_BYTES):
            n_words, doc, start, stop, names = search(chunk.column("text").to_pylist(), paths)
            n = chunk.num_rows
            n_hit = np.bincount(doc, weights=stop - start, minlength=n).astype(np.int64)
            lists = [sorted(x) for x in names]
            cuts = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
            spans = pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(stop, pa.int64())], ["start", "stop"]))
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit), pa.array([len(x) for x in lists], pa.int64()),
                 pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists]), pa.array(n_hit > 0), spans],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )

    return d.mapInArrow(frugal(run), HITS)


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans; a line break marks each cut."""
    places = [m.span() for m in WORD_SPANS.finditer(text)]
    out, at = [], 0
    for start, stop in spans:
        out += [text[at : places[start][0]], b"\n"]
        at = places[stop - 1][1]
    return b"".join([*out, text[at:]])


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """Documents with every occurrence cut from their text, and ``n_chars`` (if a column) after it.

    Cut texts are searched again until none has an occurrence, for the words on both sides of a cut
    follow one another. Other columns stay; a document of which no word is left goes.
    """
    paths = write_parts(benchmark, window, part_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in byte_chunks(batches, "text", SHARD_BYTES):
            at = chunk.schema.get_field_index("text")
            texts = chunk.column(at).cast(pa.binary()).to_pylist()
            todo, touched = list(range(len(texts))), set()
            while todo:
                _, doc, start, stop, _ = search([texts[i] or b"" for i in todo], paths)
                spans: dict[int, list] = {}
                for d_, a, b in zip(doc.tolist(), start.tolist(), stop.tolist()):
                    spans.setdefault(todo[d_], []).append((a, b))
                for i, s in spans.items():
                    texts[i] = cut_spans(texts[i], s)
                touched.update(spans)
                todo = sorted(spans)
            if touched:
                text = [None if t is None else t.decode() for t in texts]
                chunk = chunk.set_column(at, chunk.schema.field(at), pa.array(text, chunk.schema.field(at).type))
                if "n_chars" in chunk.schema.names:
                    k = chunk.schema.get_field_index("n_chars")
                    sizes = chunk.column(k).to_pylist()
                    for i in touched:
                        sizes[i] = len(text[i])
                    chunk = chunk.set_column(k, chunk.schema.field(k), pa.array(sizes, chunk.schema.field(k).type))
                gone = {i for i in touched if not words_of(texts[i])}
                chunk = chunk.filter(pa.array([i not in gone for i in range(len(texts))]))
            yield chunk

    return docs.mapInArrow(frugal(run), docs.schema)
