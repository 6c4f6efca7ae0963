"""Toxicity: a counterfactual-regularised linear classifier.

A document is the set of its words' features: the word, its first and last three to five characters
and its inner four-grams.  Features whose rate differs clearly between the classes (a z test over the
training rows) enter a logistic model.

Counterfactuals are made of every labelled text.  Where it names identity groups of a list, each copy
swaps those names for other members of the list, every member in turn.  Where it names none, a member of
one list is put in between its words (list and place by a hash of the text), and swapped for each other member: neutral mentions that any corpus
yields, whether or not its labelled texts happen to name groups.  Names are only ever compared with names,
never with a word of the text, which may be what makes it toxic.  The loss adds ``swap_penalty`` times
the mean squared change of the linear score over all swaps, so naming one group in place
of another hardly moves the score: a feature that some group names share with insults is given up for
others of the insult.  ``Model.swaps`` tells how many swaps took part and how much they move the score.

Fitting reads at most ``max_per_class`` labelled ids of each class (smallest hash of the id);
scoring is one pass without a shuffle.  Case is Unicode's.

Defined cases: null and empty texts have no features and get the score of the intercept; texts are
read whole, however long, as the set of their words; null labels and labels without a document are no
training rows; an id counts once for each label it has; every row is scored, null and repeated ids
too; other columns are passed over, whatever their names; without two classes in training every score
is that class's (0.5 without any).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import by_rows, documents, fold
from quire.llm.quality_classifier import labelled_sample, logistic_curve

BITS = 20
#: lists of terms of one kind; a term is swapped for the next of its list
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "african", "european", "indigenous", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual"),
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"), ("girl", "boy"),
    ("immigrants", "refugees", "foreigners", "natives"), ("immigrant", "refugee", "foreigner", "native"),
    ("disabled", "deaf", "blind"), ("old", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
_EDGES_TEXT = ".,;:!?\"'()[]{}<>|*#$%&"


def bare(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(_EDGES_TEXT)


def feature_numbers(word: bytes) -> list[int]:
    """Feature numbers of one word, with repeats."""
    w = bare(word)
    if not w:
        return []
    parts = [f"={w}", *(f"^{w[:k]}" for k in (3, 4, 5) if len(w) >= k), *(f"{w[-k:]}$" for k in (3, 4, 5) if len(w) >= k), *(w[i : i + 4] for i in range(len(w) - 3))]
    return [xxhash.xxh3_64_intdigest(p) >> (64 - BITS) for p in parts]


def word_features(word: bytes) -> np.ndarray:
    """Sorted distinct feature numbers of one word."""
    return np.unique(np.array(feature_numbers(word), np.int32))


class Memo(dict):
    def __init__(self, of, bound: int = 150_000):
        super().__init__()
        self.of, self.bound = of, bound

    def __missing__(self, word):
        if len(self) >= self.bound:
            self.clear()
        got = self[word] = self.of(word)
        return got


def text_features(words: list[bytes], memo: Memo) -> np.ndarray:
    each = [memo[w] for w in set(words)]
    return np.unique(np.concatenate(each)) if each else np.zeros(0, np.int32)


def counterfactuals(words: list[bytes], terms=IDENTITY_TERMS) -> tuple[list[bytes], list[list[bytes]]]:
    """A text, which has a name put in if it has none, and its copies with other names; word lists."""
    lists = {t: (n, i) for n, group in enumerate(terms) for i, t in enumerate(group)}
    named = [(at, *lists[w]) for at, word in enumerate(words) if (w := bare(word)) in lists]
    if not words or not terms:
        return words, []
    if not named:
        h = xxhash.xxh3_64_intdigest(b" ".join(words))
        n, at = h % len(terms), (h >> 20) % (len(words) + 1)
        put = lambda w: [*words[:at], w.encode(), *words[at:]]
        return put(terms[n][0]), [*map(put, terms[n][1:])]
    copies = []
    for n in sorted({n for _, n, _ in named}):
        for step in range(1, len(terms[n])):
            other = list(words)
            for at, m, i in named:
                if m == n:
                    other[at] = terms[n][(i + step) % len(terms[n])].encode()
            copies.append(other)
    return words, copies


def change(one: list[bytes], other: list[bytes], memo: Memo) -> np.ndarray:
    """What ``other`` has and ``one`` lacks: feature numbers, and -1 - number where it is the other way round."""
    a, b = set(one), set(other)
    lost, new = (set().union(*(memo[w].tolist() for w in x)) for x in (a - b, b - a))
    if not lost and not new:
        return np.zeros(0, np.int32)
    both = set(np.concatenate([memo[w] for w in a & b]).tolist()) if a & b else set()
    return np.array(sorted(new - lost - both) + [-1 - f for f in sorted(lost - new - both)], np.int32)


@dataclass
class Model:
    place: dict[int, int] = field(default_factory=dict)  # feature number -> place in weight
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    swaps: tuple[int, float] = (0, 0.0)  # number, mean absolute change of the score

    def scorer(self):
        """A function text -> score that looks every distinct word up once."""
        place = self.place
        memo = Memo(lambda word: tuple({place[i] for i in feature_numbers(word) if i in place}))

        def score(text: bytes | None) -> float:
            found = set()
            for some in map(memo.__getitem__, set((text or b"").lower().split())):
                found.update(some)
            z = self.slope * (self.bias + float(self.weight[sorted(found)].sum())) + self.shift
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def select(rows: list[np.ndarray], y: np.ndarray, least_z: float = 4.5, most: int = 512) -> np.ndarray:
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    c1, c0 = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for ids, label in zip(rows, y, strict=True):
        (c1 if label else c0)[ids] += 1
    p = (c1 + c0) / (n1 + n0)
    z = np.abs(c1 / n1 - c0 / n0) / np.sqrt(np.maximum(p * (1 - p) * (1 / n1 + 1 / n0), 1e-12))
    z[(c1 + c0) < 5] = 0
    best = np.lexsort((np.arange(len(z)), -z))[:most]
    return np.sort(best[z[best] >= least_z])


def fit(rows: list[np.ndarray], labels: np.ndarray, changes: list[np.ndarray], swap_penalty: float = 300.0, ridge: float = 0.02) -> Model:
    """``changes``: feature changes between a text and its counterfactual copies, as ``change`` gives them.

    Minimised are 50 times the mean logistic loss of each class, ``ridge`` / 2 times the squared weights
    and ``swap_penalty`` times the mean squared change of the linear score over the counterfactuals.
    """
    ones = int(labels.sum()) if len(labels) else 0
    if ones in (0, len(rows)):
        return Model(shift=0.0 if not len(rows) else 10.0 if ones else -10.0)
    chosen = select(rows, labels)
    place = {int(f): i for i, f in enumerate(chosen)}
    d = len(chosen)
    x = np.zeros((len(rows), d + 1), np.float32)
    for i, ids in enumerate(rows):
        x[i, np.searchsorted(chosen, ids[np.isin(ids, chosen, assume_unique=True)])] = 1
    x[:, d] = 1
    y = labels.astype(np.float64)
    moved = np.zeros((len(changes), d + 1), np.float32)
    for i, ids in enumerate(changes):
        for f in ids.tolist():
            if (at := place.get(f if f >= 0 else -1 - f)) is not None:
                moved[i, at] += 1 if f >= 0 else -1
    pull = (moved.T @ moved).astype(np.float64) * (2 * swap_penalty / max(len(changes), 1))
    pull[np.arange(d), np.arange(d)] += ridge
    each = np.where(y == 1, 50 / ones, 50 / (len(y) - ones))  # both classes weigh the same
    b = np.zeros(d + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (each * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + pull + 1e-6 * np.eye(d + 1)
        step = np.linalg.solve(h, x.T @ (each * (y - p)) - pull @ b)
        b = b + np.clip(step, -3, 3)
        if abs(step).max() < 1e-6:
            break
    model = Model(place, b[:d].copy(), float(b[d]))
    model.slope, model.shift = logistic_curve((x @ b).astype(np.float64), y)
    if len(changes):
        model.swaps = len(changes), float(np.abs(moved @ b * model.slope).mean())
    return model


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", k: int = 5, held: int = 0, max_per_class: int = 3000, terms=IDENTITY_TERMS, swap_penalty: float = 300.0) -> Model:
    sample = labelled_sample(docs, labels, target, k, held, max_per_class)
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("ids", pa.binary()), ("changes", pa.list_(pa.binary()))])

    def make():
        memo = Memo(word_features, 50_000)

        def one(row):
            words = (row[1] or b"").lower().split()
            text, copies = counterfactuals(words, terms)
            return row[0], row[2], text_features(words, memo).tobytes(), [change(text, other, memo).tobytes() for other in copies]

        return one

    # 2 * max_per_class rows at most, each with as many changes as the lists that it names have members
    got = sorted(sample.mapInArrow(by_rows(make, schema), "doc_id long, label int, ids binary, changes array<binary>").collect(), key=lambda r: (r["doc_id"], r["label"]))
    array = lambda b: np.frombuffer(b, np.int32)
    return fit([array(r["ids"]) for r in got], np.array([r["label"] for r in got], dtype=np.int64), [array(c) for r in got for c in r["changes"]], swap_penalty)


def score(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 512 weights at most
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def make():
        of = shared.value.scorer()
        return lambda row: (row[0], of(row[1]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(by_rows(make, schema), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    k, held = how.get("k", 5), how.get("held", 0)
    scored = score(docs, train(docs, labels, **how))
    return scored.select("doc_id", (fold(F.col("doc_id"), k) == held).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
