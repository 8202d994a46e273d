"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the smallest of its inner s-mers (by hash) is its
first or its last one. That depends on the k-mer alone, so an anchor survives any edit outside it:
a text and its edited copy keep the anchors of what they share, at positions that differ by one
offset for each shared stretch. A fingerprint is the ``size`` smallest distinct anchor hashes;
likeness is the share of the smallest hashes of both that both hold (an estimate of the Jaccard
similarity of the anchor sets). Beside it stands what positional matching of all anchors finds: the offset
that most anchors of the text and its edited text share, how many do, and how many lie at any shared offset.

Defined results: null text is empty; an empty text has the empty fingerprint and is like (1.0)
another empty one only; a text without a syncmer, as a short one, has its own hash as sole anchor;
equal texts have equal fingerprints. Rows of equal doc_id are put in the order of their text,
rows without one come last; each repeated row gets its row; a sole row is its own next.
Columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicat.llm.common import byte_chunks, frugal, shuffle_partitions

K, S, SIZE = 16, 8, 64
BASE = 0x9E3779B97F4A7C15
CHUNK_CHARS = 1 << 20
MASK = (1 << 64) - 1

OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_anchors long, edited_offset long, edited_at_offset long, edited_matched long, next_matched long"
)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _grams(codes: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every window of ``width`` (a power of two) codes."""
    h, step = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1
    while step < width:
        h = h[:-step] * np.uint64(pow(BASE, step, 1 << 64)) + h[step:]
        step *= 2
    return h


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def anchors_of(texts: list[str], k: int = K, s: int = S) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, 32-bit hashes) of the closed syncmers of each text, texts hashed in one array."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(codes) >= k:
        inner = _mix(_grams(codes, s))
        lowest = _window_min(inner, k - s + 1)
        n = len(lowest)
        at = np.flatnonzero((inner[:n] == lowest) | (inner[k - s : k - s + n] == lowest))
        doc = np.searchsorted(ends, at, side="right")
        inside = at + k <= ends[doc]
        at, doc = at[inside], doc[inside]
        hashes = (_mix(_grams(codes, k)[at]) >> np.uint64(32)).astype(np.uint32)
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    else:
        at, hashes, cuts = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    out = []
    for i, text in enumerate(texts):
        a, b = cuts[i], cuts[i + 1]
        if a == b and text:
            own = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "big")
            out.append((np.zeros(1, np.int64), np.array([own], np.uint32)))
        else:
            out.append((at[a:b] - (ends[i] - lengths[i]), hashes[a:b]))
    return out


def _ranked(anchors: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(anchors told apart by how often the hash came before, in order; positions)."""
    positions, hashes = anchors
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    nth = np.arange(len(h)) - np.maximum.accumulate(np.where(first, np.arange(len(h)), 0)) if len(h) else np.zeros(0, np.int64)
    return (h.astype(np.uint64) << np.uint64(32)) | nth.astype(np.uint64), positions[order]


def match_positions(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int, int]:
    """Positional matching of two texts' anchors: (most frequent offset, anchors at it, anchors that lie at any
    offset that two or more share, or at offset 0). Equal anchors are paired in their order in the texts."""
    (va, pa_), (vb, pb) = _ranked(a), _ranked(b)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0, 0, 0
    offsets, n = np.unique(pb[ib] - pa_[ia], return_counts=True)
    best = int(np.argmax(n))
    return int(offsets[best]), int(n[best]), int(n[(n > 1) | (offsets == 0)].sum())


def sketch(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    return np.unique(hashes)[:size]


def to_hex(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:size]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def edited(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut] if cut else text


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = chars = 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= CHUNK_CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _anchors(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [x for a, b in _slices(texts) for x in anchors_of(texts[a:b])]


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order; each is put out when the one after it is known. A tail is only a next row."""
    names = [x.strip().split(" ")[0] for x in OUT.split(",")]
    types = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.strip().split(" ")[1]] for x in OUT.split(",")]
    held: tuple | None = None
    for batch in byte_chunks(batches, "text", CHUNK_CHARS):
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("tail", "doc_id", "text"))))
        texts = [r[2] or "" for r in rows]
        line = ([held] if held else []) + [(*r[:2], t, x, sketch(x[1])) for r, t, x in zip(rows, texts, _anchors(texts))]
        held = line[-1]
        pairs = [(x, y) for x, y in zip(line, line[1:]) if not x[0]]
        changed = [edited(x[2], y[2]) for x, y in pairs]
        out = []
        for (x, y), c, found in zip(pairs, changed, _anchors(changed)):
            e = sketch(found[1])
            out.append(
                (x[1], len(x[2]), hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest(), to_hex(x[4]), to_hex(e), likeness(x[4], e), likeness(x[4], y[4]), len(x[3][1]),
                 *match_positions(x[3], found), match_positions(x[3], y[3])[2])
            )
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likeness to that and to the next text.

    The order by descending doc_id is cut into spans of about equal counts; each span is one
    partition of the only shuffle of the texts, sorted there and read as a stream. The first row of
    each span (one for each partition) is also sent, as a tail, to the end of the span before it.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = sorted({float(x) for x in d.approxQuantile("doc_id", [i / parts for i in range(1, parts)], min(0.001, 0.1 / parts))}) if parts > 1 else []
    if cuts:
        from pyspark.ml.feature import Bucketizer

        b = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="as_double", outputCol="bucket", handleInvalid="keep")
        d = b.transform(d.withColumn("as_double", F.col("doc_id").cast("double")))
        d = d.select(F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(len(cuts) - F.col("bucket")).cast("int").alias("span"), "doc_id", "text")
    else:
        d = d.select(F.col("doc_id").isNull().cast("int").alias("span"), "doc_id", "text")
    # one row for each span
    firsts = {r["span"]: r["first"] for r in d.groupBy("span").agg(F.max("doc_id").alias("first")).collect()}
    spans = sorted(firsts)
    if not spans:
        return spark.createDataFrame([], OUT)
    before = [(s, firsts[s], spans[i - 1]) for i, s in enumerate(spans)]
    wanted = spark.createDataFrame(before, "h_span int, h_first long, to_span int")
    tails = (
        d.join(F.broadcast(wanted), (F.col("span") == F.col("h_span")) & F.col("doc_id").eqNullSafe(F.col("h_first")))
        .groupBy("to_span", "doc_id").agg(F.min(F.struct(F.col("text"))).alias("m"))
        .select(F.col("to_span").alias("span"), F.lit(True).alias("tail"), "doc_id", F.col("m.text").alias("text"))
    )
    dealt = d.select("span", F.lit(False).alias("tail"), "doc_id", "text").unionByName(tails)
    ordered = dealt.repartitionById(max(spans) + 1, F.col("span")).sortWithinPartitions("span", "tail", F.desc("doc_id"), "text")
    return ordered.mapInArrow(frugal(_fingerprint), OUT)
