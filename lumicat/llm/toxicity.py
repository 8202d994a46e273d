"""Toxicity by a classifier chain of linear models.

The categories are predicted one after another: the model of each takes the words of a text and
the probabilities (as log-odds) of the categories before it. While training, those come from
out-of-fold predictions, so that a later model learns from probabilities as uncertain as the
ones it meets afterwards. Features are the distinct
words of the whole text and their first ``PREFIXES`` bytes, hashed, and kept if they go with a label by a
likelihood-ratio test. The test is part of the training: a fold's prediction uses features that were
chosen on the other folds only. The threshold of a category is the one with the best F1 over the
out-of-fold probabilities.

Training takes a bounded sample: ``MAX_TRAINING`` labelled documents with the smallest hash of
doc_id, of whose features the ``MAX_FEATURES`` that tell most may be used. Features are counted on executors;
the driver gets the chosen ones and each sampled row's numbers of these. Every document is scored, over
its whole text, in one pass without a shuffle.

Defined results: null text is empty and gets the prior of each category; documents with a null
label are not trained on; several labels of a document count as their maximum; without labels
every probability is 0 and nothing is toxic; repeated rows each get their row; columns beside
doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicat.llm.common import ALNUM_TABLE, byte_chunks, discard, frugal, materialise, release_memory

#: Chain order: label column and the value that makes the category true.
CHAIN = (("low_quality", "quality", 0), ("toxic", "toxic", 1))
MAX_TRAINING = 6000
MIN_DOCS = 3
#: Likelihood-ratio statistic (one degree of freedom) from which a feature is kept.
MIN_G = 20.0
MAX_FEATURES = 200_000
PREFIXES = (4, 5, 6)
FOLDS = 3
RIDGE = 1.0
ITERATIONS = 60
CACHE_WORDS = 100_000


def text_words(text: bytes) -> set[bytes]:
    return set(text.lower().translate(ALNUM_TABLE).split())


def features_of(word: bytes) -> list[int]:
    """Hashes of the word and of its prefixes, marked so that no prefix equals a word."""
    from xxhash import xxh64_intdigest

    return [xxh64_intdigest(word)] + [xxh64_intdigest(b"%d^%b" % (n, word[:n])) for n in PREFIXES if len(word) >= n]


def text_features(text: bytes) -> np.ndarray:
    """Sorted distinct features of a text."""
    found = {f for w in text_words(text) for f in features_of(w)}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


class Rows:
    """A binary sparse matrix: feature numbers of each row."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.index = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.sizes)
        self.width = width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.index], minlength=len(self.sizes))

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, weights=r[self.row], minlength=self.width)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_linear(x: Rows, extra: np.ndarray, y: np.ndarray, ridge: float = RIDGE, iterations: int = ITERATIONS) -> np.ndarray:
    """Ridge logistic regression by L-BFGS; parameters are features, extras, bias."""
    n_extra = extra.shape[1]

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.dot(p[: x.width]) + extra @ p[x.width : x.width + n_extra] + p[-1]
        e = sigmoid(z) - y
        value = float((np.logaddexp(0, z) - y * z).sum() + 0.5 * ridge * (p[:-1] ** 2).sum())
        grad = np.concatenate([x.back(e), extra.T @ e, [e.sum()]])
        grad[:-1] += ridge * p[:-1]
        return value, grad

    p = np.zeros(x.width + n_extra + 1)
    value, grad = loss(p)
    memory: list[tuple[np.ndarray, np.ndarray, float]] = []
    for k in range(iterations):
        q, alphas = grad.copy(), []
        for s, t, rho in reversed(memory):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * t
        if memory:
            s, t, _ = memory[-1]
            q *= (s @ t) / (t @ t)
        for (s, t, rho), a in zip(memory, reversed(alphas)):
            q += (a - rho * (t @ q)) * s
        slope, step = grad @ q, 1.0 if memory else 1.0 / max(1e-9, float(np.linalg.norm(grad)))
        while True:
            new = p - step * q
            new_value, new_grad = loss(new)
            if new_value <= value - 1e-4 * step * slope or step < 1e-9:
                break
            step *= 0.5
        s, t = new - p, new_grad - grad
        if s @ t > 1e-12:
            memory = [*memory[-7:], (s, t, 1.0 / (s @ t))]
        done = k > 4 and value - new_value < 1e-6 * max(1.0, abs(value))
        p, value, grad = new, new_value, new_grad
        if done:
            break
    return p


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The midpoint threshold with the largest F1 of those that are right at least half of the time; 0.5 if there is none."""
    if not y.sum():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit, called = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    last = np.append(np.diff(p[order]) != 0, True)  # ties stay together
    f1 = np.where(last & (2 * hit >= called), 2 * hit / (called + y.sum()), -1)
    k = int(np.argmax(f1))
    if f1[k] <= 0:
        return 0.5
    below = p[order][k + 1] if k + 1 < len(y) else 0.0
    return float((p[order][k] + below) / 2)


@dataclass
class Chain:
    names: list[str]
    weights: dict[int, np.ndarray]
    links: list[np.ndarray]
    bias: list[float]
    thresholds: list[float]

    def word_weight(self, word: bytes) -> np.ndarray:
        total = np.zeros(len(self.names))
        for f in features_of(word):
            w = self.weights.get(f)
            if w is not None:
                total += w
        return total

    def probabilities(self, linear: np.ndarray) -> np.ndarray:
        """From the sums of feature weights (rows by categories), the chain's probabilities."""
        out = np.zeros_like(linear)
        for c in range(linear.shape[1]):
            z = linear[:, c] + self.bias[c]
            if c:
                z = z + log_odds(out[:, :c]) @ self.links[c]
            out[:, c] = sigmoid(z)
        return out


def likelihood_ratio(has: np.ndarray, hits: np.ndarray, total: float, positive: float) -> np.ndarray:
    """The statistic of features that ``has`` texts have, ``hits`` of them with the label."""

    def part(count: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(count > 0, count * np.log(np.maximum(count, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    cells = ((hits, has, positive), (has - hits, has, total - positive), (positive - hits, total - has, positive), (total - positive - has + hits, total - has, total - positive))
    return 2 * sum(part(count, r * k / total) for count, r, k in cells)


def chosen_for(has: np.ndarray, hits: np.ndarray, totals: np.ndarray, positives: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask, largest statistic) of features, from counts by fold (features x folds; x categories; folds; folds x categories).

    Bit ``s * categories + c`` says that the feature tells category c in training set s: 0 is all
    folds, k + 1 all but fold k.
    """
    folds, categories = positives.shape
    mask, most = np.zeros(len(has), np.int64), np.zeros(len(has))
    for s in range(folds + 1):
        use = np.arange(folds) != s - 1
        n = has[:, use].sum(1)
        for c in range(categories):
            if totals[use].sum():
                g = likelihood_ratio(n, hits[:, use, c].sum(1), float(totals[use].sum()), float(positives[use, c].sum()))
                tells = (g >= MIN_G) & (n >= MIN_DOCS)
                mask |= tells.astype(np.int64) << (s * categories + c)
                most = np.maximum(most, np.where(tells, g, 0.0))
    return mask, most


def train_chain(rows: list[np.ndarray], labels: np.ndarray, fold: np.ndarray, features: np.ndarray, mask: np.ndarray, names: list[str], folds: int = FOLDS) -> Chain:
    """Fit the chain on rows of feature numbers and their 0/1 labels (rows by categories)."""
    earlier = np.zeros((len(rows), 0))
    weights: dict[int, np.ndarray] = {}
    links, bias, thresholds = [], [], []

    def part(of: np.ndarray, s: int, c: int) -> Rows:
        chosen = np.flatnonzero(mask >> (s * len(names) + c) & 1)
        local = np.full(len(features), -1, np.int64)
        local[chosen] = np.arange(len(chosen))
        return Rows([(r := local[rows[i]])[r >= 0] for i in of], len(chosen))

    for c in range(len(names)):
        y = labels[:, c].astype(float)
        out_of_fold = np.full(len(y), 0.5)
        for k in range(folds):
            train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if not len(train) or not len(test):
                continue
            x = part(train, k + 1, c)
            p = fit_linear(x, earlier[train], y[train])
            z = part(test, k + 1, c).dot(p[: x.width]) + earlier[test] @ p[x.width : -1] + p[-1]
            out_of_fold[test] = sigmoid(z)
        x = part(np.arange(len(y)), 0, c)
        p = fit_linear(x, earlier, y)
        for i, k in enumerate(np.flatnonzero(mask >> c & 1).tolist()):
            weights.setdefault(int(features[k]), np.zeros(len(names)))[c] = p[i]
        links.append(p[x.width : -1])
        bias.append(float(p[-1]))
        thresholds.append(best_threshold(out_of_fold, y))
        earlier = np.column_stack([earlier, log_odds(out_of_fold)])
    return Chain(names, weights, links, bias, thresholds)


def training_sample(docs: DataFrame, labels: DataFrame, chain=CHAIN, most: int = MAX_TRAINING) -> DataFrame:
    """(t_doc, t_fold, t_y, t_features): labelled texts with the smallest hashes of doc_id, ``most`` of them."""
    columns = sorted({c for _, c, _ in chain})
    known = labels.select("doc_id", *columns).groupBy(F.col("doc_id").alias("l_doc")).agg(*(F.max(c).alias(f"l_{c}") for c in columns)).where("l_doc is not null")
    known = known.dropna().orderBy(F.xxhash64("l_doc"), "l_doc").limit(most)
    known = known.select("l_doc", F.array(*((F.col(f"l_{c}") == F.lit(v)).cast("int") for _, c, v in chain)).alias("l_y"))
    picked = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("l_doc"))
    picked = picked.groupBy("l_doc", "l_y").agg(F.min("text").alias("text"))  # of rows with one id, the least text
    fold = F.pmod(F.xxhash64("l_doc", F.lit("fold")), F.lit(FOLDS)).cast("int")
    d = picked.select(F.col("l_doc").cast("long").alias("t_doc"), fold.alias("t_fold"), F.col("l_y").alias("t_y"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in byte_chunks(batches, "text", 1 << 20):
            found = [text_features(t) for t in chunk.column("text").to_pylist()]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(chunk.column(c) for c in ("t_doc", "t_fold", "t_y")), lists], names=["t_doc", "t_fold", "t_y", "t_features"])

    return materialise(d.mapInArrow(frugal(run), "t_doc long, t_fold int, t_y array<int>, t_features array<long>"), "toxicity-sample")


def fit(docs: DataFrame, labels: DataFrame, chain=CHAIN, most: int = MAX_TRAINING, max_features: int = MAX_FEATURES) -> Chain:
    if most >= 1 << 20:
        raise ValueError("counts of a fold are packed in 20 bits")
    names = [n for n, _, _ in chain]
    sample = training_sample(docs, labels, chain, most)
    sums = sample.groupBy("t_fold").agg(F.count("*").alias("n"), *(F.sum(F.col("t_y")[c]).alias(f"y{c}") for c in range(len(names)))).collect()  # a row for each fold
    if not sums:
        return Chain(names, {}, [np.zeros(c) for c in range(len(names))], [-40.0] * len(names), [0.5] * len(names))
    totals, positives = np.zeros(FOLDS), np.zeros((FOLDS, len(names)))
    for r in sums:
        totals[r["t_fold"]], positives[r["t_fold"]] = r["n"], [r[f"y{c}"] for c in range(len(names))]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(1 + len(names))]
            has, *hits = ((x[:, None] >> (20 * np.arange(FOLDS))) & ((1 << 20) - 1) for x in packed)
            mask, most_ = chosen_for(has.astype(float), np.stack(hits, 2).astype(float), totals, positives)
            keep = np.flatnonzero(mask)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(mask[keep]), pa.array(most_[keep])], names=["feature", "mask", "g"])

    one = F.expr("shiftleft(1L, 20 * t_fold)")
    seen = sample.select(one.alias("one"), "t_y", F.explode("t_features").alias("feature"))
    counts = seen.groupBy("feature").agg(F.sum("one").alias("has"), *(F.sum(F.col("one") * F.col("t_y")[c]).alias(f"h{c}") for c in range(len(names))))
    telling = counts.mapInArrow(frugal(choose), "feature long, mask long, g double").orderBy(F.desc("g"), "feature").limit(max_features).toArrow()  # at most ``max_features``
    features = telling["feature"].to_numpy().view(np.uint64)
    order = np.argsort(features)
    features, mask = features[order], telling["mask"].to_numpy()[order]
    shared = docs.sparkSession.sparkContext.broadcast(features)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = []
            for x in batch.column("t_features"):
                at = np.flatnonzero(np.isin(known, x.values.to_numpy().view(np.uint64), assume_unique=True)) if len(x.values) else np.zeros(0, np.int64)
                found.append(at.astype(np.int32))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("t_doc", "t_fold", "t_y")), lists], names=["t_doc", "t_fold", "t_y", "numbers"])

    rows = sample.mapInArrow(frugal(number), "t_doc long, t_fold int, t_y array<int>, numbers array<int>").toArrow().sort_by("t_doc")  # at most ``most`` rows
    discard(sample)
    numbers = [np.asarray(x.values.to_numpy(), np.int64) for x in rows["numbers"]]
    model = train_chain(numbers, np.array(rows["t_y"].to_pylist(), float), rows["t_fold"].to_numpy(), features, mask, names)
    release_memory()
    return model


def score(docs: DataFrame, model: Chain) -> DataFrame:
    """(doc_id, p_<category>..., <last category>): probabilities, and whether the last one's passes its threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = model.names
    schema = "doc_id long, " + ", ".join(f"p_{n} double" for n in names) + f", {names[-1]} boolean"
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for chunk, p in _scored(byte_chunks(batches, "text", 1 << 20), "text", chain):
            columns = [pa.array(p[:, c]) for c in range(len(names))]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), *columns, pa.array(p[:, -1] >= chain.thresholds[-1])], names=["doc_id", *(f"p_{n}" for n in names), names[-1]])

    return d.mapInArrow(frugal(run), schema)


def _scored(chunks: Iterator[pa.RecordBatch], column: str, chain: Chain) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    numbers: dict[bytes, int] = {}
    weights = np.zeros((1024, len(chain.names)))
    for chunk in chunks:
        if len(numbers) > CACHE_WORDS:
            numbers = {}
        linear = np.zeros((chunk.num_rows, len(chain.names)))
        for i, text in enumerate(chunk.column(column).cast(pa.binary()).to_pylist()):
            words = text_words(text or b"")
            fresh = words.difference(numbers)
            for w in fresh:
                k = len(numbers)
                if k >= len(weights):
                    weights = np.concatenate([weights, np.zeros_like(weights)])
                numbers[w] = k
                weights[k] = chain.word_weight(w)
            if words:
                # in a fixed order, so that reruns add alike
                linear[i] = weights[np.sort(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))].sum(0)
        yield chunk, chain.probabilities(linear)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the chain doesn't call toxic, with all their columns."""
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, p in _scored(byte_chunks(batches, "text", 1 << 20), "text", shared.value):
            yield chunk.filter(pa.array(p[:, -1] < shared.value.thresholds[-1]))

    return docs.mapInArrow(frugal(run), docs.schema)
