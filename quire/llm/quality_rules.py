"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Every text becomes counts of words, symbols, repeated lines and repeated five-word windows; from them
a vector of transformed statistics.  Per language and source the centre and covariance come from the
``share`` of rows whose covariance has the least determinant, found as in FAST-MCD: many random starts
on a sample of the group (all of it, if it has no more than ``sample`` rows) with concentration steps,
the best of them concentrated further on all rows of the group; then scaled to be consistent for
normal rows and reweighted once by the rows within the 97.5 % ellipsoid.  A row is rejected whose
squared Mahalanobis distance a normal row exceeds with probability ``tail`` at most.

One rule serves groups of every size: to the rows of a group ``prior`` rows are added that have the
centre and covariance of the same estimate over the whole corpus.  A group of one row is so judged
by the corpus, one of thousands by itself.  Statistics that are counts have their sampling variance
added, since most rows may have none of what is counted; covariances are drawn towards the variances
of all rows as far as their condition number, in units of those, needs to stay within ``condition``.

A concentration step is one aggregation by group and bin of distance (an eighth of a doubling, 400
at most): the nearest whole bins that hold the share are the next subset.  A group of any size costs a
row per task and bin.

Rows that fail the base rules take no part in the estimates; they would only widen them.

Defined cases: a null or empty text has zero counts and fails the base rule; texts are counted whole,
however long; a null language or source is a value of its own; repeated ids are separate rows; ties in
distance fall in one bin and go together; columns of the documents but the four used are passed over,
whatever their names.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import WordHashes, by_rows, documents, few, least_hashed, stored, windows

#: blanks and the later bytes of a code point
_NOT_COUNTED = b" \t\n\r\x0b\x0c" + bytes(range(0x80, 0xC0))
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: the transformed statistics
NAMES = ("log_words", "word_length", "symbols", "dup_lines", "repeats")
#: sampling variance of each, by the transform: what a statistic that is constant in most rows may still vary by
NOISE = np.array([0.0, 0.0, 1.0, 1.0, 1.0])
_PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i, len(NAMES))]
MOMENTS = ["n", *(f"s_{a}" for a in NAMES), *(f"p_{NAMES[i]}_{NAMES[j]}" for i, j in _PAIRS)]
GROUP = ["lang", "source"]


def statistics() -> dict[str, Column]:
    """Counts of events are taken for 100 words and as twice the root, which gives a count sampling noise of variance 1 whatever its mean."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    count = lambda n: 2 * F.sqrt(100.0 * n / words + 0.375)
    return {
        "log_words": F.log1p(F.col("n_words").cast("double")),
        "word_length": F.col("word_chars") / words,
        "symbols": count(F.col("n_symbols")),
        "dup_lines": count(F.col("n_dup_lines")),
        "repeats": count(F.col("n_repeat_words") / 5),
    }


def counts_of(text: bytes | None, hashes: WordHashes, n: int = 5) -> tuple[int, int, int, int, int]:
    text = text or b""
    words = text.split()
    if not words:
        return 0, 0, len(_SYMBOLS.findall(text)), 0, 0
    chars = len(text.translate(None, _NOT_COUNTED))
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\r\x0b\x0c")]
    repeat = 0
    if len(words) > n:
        w = windows(hashes.of(words), n)
        _, back, times = np.unique(w, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(times[back] > 1)
        if len(twice):
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, twice, 1)
            np.add.at(cover, twice + n, -1)
            repeat = int((np.cumsum(cover) > 0).sum())
    return len(words), chars, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeat


def counted(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), *((c, pa.int64()) for c in COUNTS)])

    def make():
        hashes = WordHashes()
        return lambda row: (row[0], row[1], row[2], *counts_of(row[3], hashes))

    kinds = ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("binary")).mapInArrow(by_rows(make, schema), f"doc_id long, lang string, source string, {kinds}")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def chi2_below(x: float, p: int) -> float:
    """Probability that a chi-square with ``p`` degrees is at most ``x``, by the series of the incomplete gamma function."""
    a, half = p / 2, x / 2
    if half <= 0:
        return 0.0
    term = math.exp(a * math.log(half) - half - math.lgamma(a + 1))
    total, k = term, 0
    while term > 1e-18 * total and k < 10_000:
        k += 1
        term *= half / (a + k)
        total += term
    return min(total, 1.0)


def chi2_quantile(q: float, p: int) -> float:
    lo, hi = 0.0, 2000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_below(mid, p) < q else (lo, mid)
    return hi


def consistency(share: float, p: int) -> float:
    """What the covariance of the innermost ``share`` of normal rows is to be multiplied with."""
    return share / chi2_below(chi2_quantile(share, p), p + 2) if share < 1 else 1.0


@dataclass
class Rule:
    """How an estimate comes from moments: the same on samples and on whole groups."""

    variance: np.ndarray  # of all rows, by statistic
    condition: float = 50.0
    prior: float = 0.0
    centre: np.ndarray | None = None  # of the prior rows
    scatter: np.ndarray | None = None

    def estimate(self, n: float, mean: np.ndarray, cov: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        cov = cov * factor + np.diag(NOISE)
        if self.prior:
            d, k = self.centre - mean, self.prior
            cov = (n * cov + k * self.scatter + n * k / (n + k) * np.outer(d, d)) / (n + k)
            mean = (n * mean + k * self.centre) / (n + k)
        unit = np.sqrt(self.variance)
        eig = np.linalg.eigvalsh(cov / np.outer(unit, unit))
        a = max(float(eig[-1]) - self.condition * max(float(eig[0]), 0.0), 0.0)
        rho = a / (self.condition - 1 + a) if eig[-1] > 0 else 1.0
        return mean, (1 - rho) * cov + rho * np.diag(self.variance)

    def of_moments(self, row: dict, factor: float) -> tuple[np.ndarray, np.ndarray]:
        n = row["n"]
        mean = np.array([row[f"s_{a}"] for a in NAMES]) / n
        cov = np.zeros((len(NAMES), len(NAMES)))
        for i, j in _PAIRS:
            cov[i, j] = cov[j, i] = row[f"p_{NAMES[i]}_{NAMES[j]}"] / n - mean[i] * mean[j]
        return self.estimate(n, mean, cov, factor)


def squared(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    d = x - mean
    return np.einsum("ij,ij->i", d, np.linalg.solve(cov, d.T).T)


def fast_mcd(x: np.ndarray, rule: Rule, share: float, starts: int = 60, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance of the ``share`` of the rows ``x`` with the least determinant, over random starts."""
    n, p = x.shape
    h = -(-int(share * 1000) * n // 1000)
    factor = consistency(share, p)
    of = lambda rows: rule.estimate(len(rows), rows.mean(axis=0), np.cov(rows.T, bias=True).reshape(p, p), factor)

    def concentrated(est, steps: int):
        det = np.inf
        for _ in range(steps):
            est = of(x[np.argsort(squared(x, *est), kind="stable")[:h]])
            new = np.linalg.slogdet(est[1])[1]
            if new >= det - 1e-12:
                break
            det = new
        return det, est

    rng = np.random.default_rng(seed)
    firsts = [of(x)] + [of(x[rng.choice(n, min(n, p + 1), replace=False)]) for _ in range(starts if h < n else 0)]
    tried = sorted((concentrated(e, 2) for e in firsts), key=lambda t: t[0])[:5]
    return min((concentrated(e, 50) for _, e in tried), key=lambda t: t[0])[1]


def _distance() -> Column:
    """Squared Mahalanobis distance to the row's own ``centre`` and ``inverse`` arrays."""
    d = [F.col(a) - F.col("centre")[i] for i, a in enumerate(NAMES)]
    inverse = lambda i, j: F.col("inverse")[i * len(NAMES) + j]
    return F.greatest(F.lit(0.0), sum((d[i] * d[j] * inverse(i, j) * (1 if i == j else 2) for i, j in _PAIRS), F.lit(0.0)))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    sums = [F.count("*").alias("n"), *(F.sum(a).alias(f"s_{a}") for a in NAMES), *(F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p_{NAMES[i]}_{NAMES[j]}") for i, j in _PAIRS)]
    return rows.groupBy(*keys).agg(*sums)


def _nearest(far: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Moments, by ``keys``, of the nearest whole bins of ``distance`` that hold the share of the rows."""
    bin_ = F.least(F.lit(320), F.greatest(F.lit(-80), F.floor(F.log2(F.col("distance") + 1e-12) * 8))).alias("bin")
    bins = _moments(far.withColumn("bin", bin_), [*keys, "bin"])
    within = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))  # 400 rows at most
    before = F.coalesce(F.sum("n").over(within.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    near = bins.withColumn("before", before).withColumn("all", F.sum("n").over(within)).filter(F.col("before") < F.ceil(share * F.col("all")))
    return near.groupBy(*keys).agg(*(F.sum(m).alias(m) for m in MOMENTS))


def _arrays(est: tuple[np.ndarray, np.ndarray]) -> tuple[list[float], list[float]]:
    """Rounded, so that the order of summation changes no bin."""
    short = lambda v: [float(f"{x:.10g}") for x in v.ravel()]
    return short(est[0]), short(np.linalg.inv(est[1]))


def _given(rows: DataFrame, est: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    centre, inverse = _arrays(est)
    return rows.withColumn("centre", F.array(*map(F.lit, centre))).withColumn("inverse", F.array(*map(F.lit, inverse))).withColumn("distance", _distance())


def corpus_estimate(good: DataFrame, share: float, steps: int, sample: int, condition: float) -> Rule | None:
    """The estimate over all rows: numbers of the driver, from aggregates and a bounded sample. None without rows."""
    sums = _moments(good, []).first().asDict()
    if not sums["n"]:
        return None
    variance = np.array([sums[f"p_{a}_{a}"] / sums["n"] - (sums[f"s_{a}"] / sums["n"]) ** 2 for a in NAMES])
    rule = Rule(np.where(variance > 1e-9, variance, 1.0) + NOISE, condition)
    some = least_hashed(good.select("doc_id", *NAMES), ["doc_id", *NAMES], sample).collect()  # ``sample`` rows
    est = fast_mcd(np.array([r[1:] for r in some], np.float64), rule, share)
    factor = consistency(share, len(NAMES))
    for _ in range(steps):
        est = rule.of_moments(_nearest(_given(good, est), [], share).first().asDict(), factor)
    edge = chi2_quantile(0.975, len(NAMES))
    inner = _moments(_given(good, est).filter(F.col("distance") <= edge), []).first().asDict()
    if inner["n"]:
        est = rule.of_moments(inner, consistency(0.975, len(NAMES)))
    return Rule(rule.variance, condition, 0.0, *est)


def _joined(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with the estimate of their group: a row per group, broadcast where they are few."""
    own = few(table.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "centre", "inverse"), 20_000)
    return rows.join(own, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source").withColumn("distance", _distance())


def mcd(rows: DataFrame, share: float = 0.75, steps: int = 3, sample: int = 512, prior: float = 10.0, condition: float = 50.0) -> DataFrame:
    """``rows`` (doc_id, lang, source, statistics, failed) with ``distance`` under the estimate of its group; null where no row is good."""
    good = rows.filter(~F.col("failed")).select("doc_id", *GROUP, *NAMES)
    whole = corpus_estimate(good, share, steps, 4 * sample, condition)
    if whole is None:
        return rows.withColumn("distance", F.lit(None).cast("double"))
    rule = Rule(whole.variance, condition, prior, whole.centre, whole.scatter)
    kinds = "lang string, source string, centre array<double>, inverse array<double>"

    def start(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["hash", "doc_id", *NAMES])
        centre, inverse = _arrays(fast_mcd(group[list(NAMES)].to_numpy(np.float64), rule, share))
        return pd.DataFrame({"lang": group["lang"].iloc[:1], "source": group["source"].iloc[:1], "centre": [centre], "inverse": [inverse]})

    sizes = stored(good.groupBy(*GROUP).agg(F.count("*").alias("all")).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "all"))
    sized = good.join(few(sizes, 20_000), F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))).drop("_lang", "_source").withColumn("hash", F.xxhash64("doc_id", *NAMES))
    some = sized.filter((F.col("hash") / 2.0**64 + 0.5) * F.col("all") <= 2 * sample)  # about 2 * sample rows of a group
    first = some.withColumn("at", F.row_number().over(W.partitionBy(*GROUP).orderBy("hash", "doc_id"))).filter(F.col("at") <= sample)
    table = stored(first.select("lang", "source", "doc_id", "hash", *NAMES).groupBy(*GROUP).applyInPandas(start, kinds))

    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("centre", pa.list_(pa.float64())), ("inverse", pa.list_(pa.float64()))])

    def estimates(moments: DataFrame, factor: float) -> DataFrame:
        def make():
            return lambda row: (row[0], row[1], *_arrays(rule.of_moments(dict(zip(MOMENTS, row[2:], strict=True)), factor)))

        return stored(moments.select(*GROUP, *MOMENTS).mapInArrow(by_rows(make, schema), kinds))

    for _ in range(steps):
        table = estimates(_nearest(_joined(good, table), GROUP, share), consistency(share, len(NAMES)))
    edge = chi2_quantile(0.975, len(NAMES))
    table = estimates(_moments(_joined(good, table).filter(F.col("distance") <= edge), GROUP), consistency(0.975, len(NAMES)))
    # groups without a row inside the ellipsoid or without a good row are judged by the corpus
    centre, inverse = _arrays((whole.centre, whole.scatter))
    known = _joined(rows, table).withColumn("centre", F.coalesce("centre", F.array(*map(F.lit, centre)))).withColumn("inverse", F.coalesce("inverse", F.array(*map(F.lit, inverse))))
    return known.withColumn("distance", _distance()).drop("centre", "inverse")


def judge(docs: DataFrame, tail: float = 1e-8, **how) -> DataFrame:
    """Counts, base_failed, distance and kept of every row of ``docs``.

    ``tail``: how probable so great a distance is for a row of normal statistics; lengths have heavier
    tails than normal ones, so it is small.
    """
    rows = stored(counted(docs).withColumn("failed", base_failed()).withColumns(statistics()))
    known, cutoff = mcd(rows, **how), chi2_quantile(1 - tail, len(NAMES))
    return known.select("doc_id", *COUNTS, F.col("failed").alias("base_failed"), (~F.col("failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"), "distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).drop("distance")
