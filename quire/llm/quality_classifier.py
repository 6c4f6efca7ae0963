"""Quality classifier: naive Bayes support vectors.

Every document becomes a set of n-gram indicators: word unigrams and bigrams, one- to three-grams of
word shapes, three-grams of "is this word the one before it", and a few rates cut into bins.  An
indicator's value is its log-count ratio between the classes (naive Bayes); on these scaled, unit
length vectors a linear hinge-loss model is fitted by dual coordinate descent.  A logistic curve
fitted to the training margins turns the margin into a score.

Fitting reads at most ``max_per_class`` labelled documents of each class, those with the smallest
hash of the id, so its cost on the driver is bounded; scoring is one pass without a shuffle.

Defined cases: null and empty texts have only the rate indicators of an empty text; texts are read
whole, however long, and counted as sets, so a row costs memory by its distinct windows; a null label,
a label without document and a document without label are no training rows; an id counts once for
each label it has, repeated labels or documents add nothing; with one class or none in training every
score is that class or 0.5; every row is scored, null and repeated ids too; other columns of the
documents are passed over, whatever their names, by ``classify`` and kept by ``keep``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import WordHashes, by_rows, documents, fold, forget, least_hashed, scramble

BITS = 18
_SHAPE = re.compile(rb"[a-z\x80-\xff]+|[0-9]+|(.)\1*", re.S)
_SALT = {k: np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1) for i, k in enumerate(("w1", "w2", "s1", "s2", "s3", "eq", "rate"))}


def _shape(m: re.Match) -> bytes:
    c = m[0][:1]
    return b"a" if c >= b"a" and c <= b"z" or c >= b"\x80" else b"0" if c.isdigit() else c


class Shapes(dict):
    """word -> hash of its shape: letters a, digits 0, runs of one sign once."""

    def __init__(self, bound: int = 200_000):
        super().__init__()
        self.bound, self.hashes = bound, WordHashes()

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        got = self[word] = self.hashes[_SHAPE.sub(_shape, word)[:12]]
        return got

    of = WordHashes.of


class Kinds(dict):
    """word -> 1 if it holds no letter or digit, plus 2 if it ends in a sign that closes no word or clause."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        text = word.decode("utf-8", "replace")
        got = self[word] = (not any(map(str.isalnum, text))) + 2 * (not (text[-1].isalnum() or text[-1] in ".,;:!?)]}\"'»”’…"))
        return got


class Features:
    """text -> sorted distinct indicator numbers below 2**BITS."""

    def __init__(self):
        self.words, self.shapes, self.kinds = WordHashes(), Shapes(), Kinds()

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        h, s, found = self.words.of(words), self.shapes.of(words), []

        def add(kind: str, *parts: np.ndarray) -> None:
            total = np.full(len(parts[0]), _SALT[kind], np.uint64)
            for p in parts:
                total = scramble(total + p)
            found.append(total)

        add("w1", h)
        s = np.unique(s[:0]) if not len(s) else s
        add("s1", s)
        if len(h) > 1:
            same = (h[1:] == h[:-1]).astype(np.uint64)
            add("w2", h[:-1], h[1:])
            add("s2", s[:-1], s[1:])
            add("s3", s[:-2], s[1:-1], s[2:])
            add("eq", same[:-2] + same[1:-1] * np.uint64(2) + same[2:] * np.uint64(4))
        n = max(len(h), 1)
        kinds = np.fromiter(map(self.kinds.__getitem__, words), np.uint8, len(words))
        rates = [1 - len(np.unique(h)) / n, float((kinds & 1).sum()) / n, float((kinds >> 1).sum()) / n, float((h[1:] == h[:-1]).sum()) / n]
        bins = [int(r * 10) for r in rates] + [min(len(h).bit_length(), 20)]
        add("rate", np.array([i * 64 + b for i, b in enumerate(bins)], np.uint64))
        return np.unique((np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int32))


@dataclass
class Model:
    """Weights with the log-count ratios, the ratios alone, the bias and the logistic curve."""

    weight: np.ndarray
    ratio: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, ids: np.ndarray) -> float:
        norm = float(np.sqrt((self.ratio[ids].astype(np.float64) ** 2).sum() + 1))
        return (float(self.weight[ids].sum(dtype=np.float64)) + self.bias) / norm

    def score(self, ids: np.ndarray) -> float:
        z = self.slope * self.margin(ids) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    counts = [np.full(1 << BITS, alpha), np.full(1 << BITS, alpha)]
    for ids, label in zip(rows, y, strict=True):
        counts[int(label)][ids] += 1
    p, q = counts[1] / counts[1].sum(), counts[0] / counts[0].sum()
    ratio = np.log(p / q)
    ratio[(counts[0] + counts[1]) < 2 * alpha + 3] = 0.0  # seen in fewer than three rows: noise
    return ratio


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, dim: int, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """min |w|^2/2 + sum cost_i * max(0, 1 - y_i w.x_i), in the dual, one coordinate at a time."""
    w, a, order = np.zeros(dim), np.zeros(len(rows)), np.arange(len(rows))
    rng = np.random.default_rng(seed)
    square = np.array([float((v * v).sum()) for _, v in rows])
    for _ in range(epochs):
        rng.shuffle(order)
        most = 0.0
        for i in order:
            ids, v = rows[i]
            if not square[i]:
                continue
            g = y[i] * float(w[ids] @ v) - 1.0
            new = min(max(a[i] - g / square[i], 0.0), cost[i])
            if new != a[i]:
                most = max(most, abs(new - a[i]))
                w[ids] += (new - a[i]) * y[i] * v
                a[i] = new
        if most < 1e-4:
            break
    return w


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps; the targets are softened so that separable data stay finite."""
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, b = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    each = np.where(y == 1, 0.5 / n1, 0.5 / n0)  # both classes weigh the same
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (each * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (each * (t - p)) - 1e-4 * b)
        b = b + np.clip(step, -5, 5)
        if abs(step).max() < 1e-6:
            break
    return float(b[0]), float(b[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0) -> Model:
    dim, ones = 1 << BITS, int(labels.sum())
    if not rows or ones in (0, len(rows)):
        z = 0.0 if not rows else 10.0 if ones else -10.0
        return Model(np.zeros(dim, np.float32), np.zeros(dim, np.float32), 0.0, 0.0, z)
    ratio = log_count_ratios(rows, labels)
    scaled = []
    for ids in rows:
        v = np.append(ratio[ids], 1.0)
        scaled.append((np.append(ids, dim), v / np.sqrt(v @ v)))
    each = np.where(labels == 1, cost * len(rows) / (2 * ones), cost * len(rows) / (2 * (len(rows) - ones)))
    w = dual_coordinate_descent(scaled, labels * 2.0 - 1, each, dim + 1)
    model = Model((w[:dim] * ratio).astype(np.float32), ratio.astype(np.float32), float(w[dim]), 1.0, 0.0)
    model.slope, model.shift = logistic_curve(np.array([model.margin(ids) for ids in rows]), labels.astype(float))
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, k: int, held: int, max_per_class: int) -> DataFrame:
    """doc_id, text, label of at most ``max_per_class`` ids of each class outside the held-out fold.

    The ids are cut first, by the smallest hash, so only their texts are read on; of rows that share
    an id the one with the least text hash stands for it, so repeated rows do not widen the sample.
    """
    id_ = F.col("doc_id").cast("long")
    known = labels.select(id_.alias("_id"), F.col(target).cast("int").alias("label")).filter(F.col("_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("_id"), k) != held)).distinct()
    parts = [least_hashed(known.filter(F.col("label") == c), "_id", max_per_class) for c in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * max_per_class rows of two integers at most
    rows = docs.select(id_.alias("doc_id"), F.col("text").cast("binary").alias("text")).join(chosen, F.col("doc_id") == F.col("_id"))
    return rows.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "label")


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", k: int = 3, held: int = 1, max_per_class: int = 3000) -> Model:
    sample = labelled_sample(docs, labels, target, k, held, max_per_class)
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("ids", pa.binary())])

    def make():
        features = Features()
        return lambda row: (row[0], row[2], features(row[1]).tobytes())

    got = sorted(sample.mapInArrow(by_rows(make, schema), "doc_id long, label int, ids binary").collect())  # 2 * max_per_class rows at most
    return fit([np.frombuffer(r["ids"], np.int32) for r in got], np.array([r["label"] for r in got], dtype=np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 * 2**BITS floats
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def make():
        features, m = Features(), shared.value
        return lambda row: (row[0], m.score(features(row[1])))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(by_rows(make, schema), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    k, held = how.get("k", 3), how.get("held", 1)
    scored = score(docs, train(docs, labels, **how))
    return scored.select("doc_id", (fold(F.col("doc_id"), k) == held).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, unchanged, in one pass over them."""
    model = train(docs, labels, **how)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        forget()
        features, m = Features(), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(place).cast(pa.binary()).to_pylist()
                yield part.filter(pa.array([m.score(features(t)) >= 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
