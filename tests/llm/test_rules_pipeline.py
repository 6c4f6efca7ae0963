import re

import numpy as np
from llm_rows import ODD
from pyspark.sql import functions as F

from quire.llm import quality_rules
from quire.llm.common import WordHashes


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= set(range(i, i + 5))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines)), len(covered))


def test_counts():
    hashes = WordHashes()
    texts = [t for _, t, *_ in ODD if not t or len(t) < 5000] + ["a b c d e a b c d e f", "x " * 12, "é # | é\n\né # | é", "\n".join(["q w"] * 4) + "\n \n "]
    for t in texts:
        assert quality_rules.counts_of(None if t is None else t.encode(), hashes) == plain_counts(t), t


def test_verdicts(spark, documents, labels):
    got = quality_rules.judge(documents).join(labels, "doc_id").collect()
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    good = [r for r in got if r.quality == 1 and not r.base_failed]
    bad = [r for r in got if r.quality == 0 and not r.base_failed]
    assert np.mean([r.kept for r in good]) > 0.99 and np.mean([r.kept for r in bad]) < 0.5


SCHEMA = "doc_id long, lang string, source string, failed boolean, log_words double, word_length double, symbols double, dup_lines double, repeats double"


def test_centre_ignores_a_minority_of_outliers(spark):
    """With a fifth of wild rows, distances of the rest stay those of the rest alone."""
    rng = np.random.default_rng(0)
    calm = [(i, "en", "s", False, *map(float, rng.normal([5, 6, 1.2, 1.2, 1.2], [1, 0.3, 0.1, 0.1, 0.05]))) for i in range(400)]
    wild = [(1000 + i, "en", "s", False, 5.0, 6.0, 12.0, 9.0, 8.0) for i in range(100)]
    got = {r.doc_id: r.distance for r in quality_rules.mcd(spark.createDataFrame(calm + wild, SCHEMA)).collect()}
    assert max(got[i] for i, *_ in calm) < 30 and min(got[i] for i, *_ in wild) > 60
    assert quality_rules.mcd(spark.createDataFrame(calm[:3], SCHEMA)).filter(F.col("distance").isNull()).count() == 0


def test_chi_square():
    assert abs(quality_rules.chi2_quantile(0.975, 5) - 12.8325) < 1e-3 and abs(quality_rules.chi2_below(9.2364, 5) - 0.9) < 1e-4
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200_000, 5))
    near = x[np.argsort((x**2).sum(axis=1))[:150_000]]
    assert abs(np.cov(near.T).diagonal().mean() * quality_rules.consistency(0.75, 5) - 1) < 0.02


def test_least_determinant_of_all_subsets():
    """Against every subset of the share: none has a smaller determinant."""
    from itertools import combinations

    rng = np.random.default_rng(6)
    for prior in (0.0, 3.0):
        rule = quality_rules.Rule(np.ones(5), 50.0, prior, np.zeros(5), np.eye(5))
        for _ in range(3):
            x = np.concatenate([rng.normal(size=(9, 5)), rng.normal(size=(3, 5)) + 6])
            got = quality_rules.fast_mcd(x, rule, 0.75, starts=200)
            factor = quality_rules.consistency(0.75, 5)
            dets = [np.linalg.slogdet(rule.estimate(9, (s := x[list(c)]).mean(axis=0), np.cov(s.T, bias=True), factor)[1])[1] for c in combinations(range(12), 9)]
            assert np.linalg.slogdet(got[1])[1] <= min(dets) + 1e-9


def test_equals_a_dense_estimate(spark):
    """The distributed estimate of two groups, one larger than the sample, against plain numpy on whole groups."""
    rng = np.random.default_rng(8)
    data = []
    for source, n in (("a", 300), ("b", 40), ("c", 2)):
        mix = rng.normal(size=(5, 5)) * 0.3 + np.eye(5)
        x = rng.normal(size=(n, 5)) @ mix + rng.normal(size=5)
        x[: n // 8] += 15
        data += [(len(data) + i, "en", source, False, *map(float, v)) for i, v in enumerate(x)]
    got = {r.doc_id: r.distance for r in quality_rules.mcd(spark.createDataFrame(data, SCHEMA), sample=100, steps=12).collect()}
    x, source = np.array([r[4:] for r in data]), np.array([r[2] for r in data])
    inner, edge = quality_rules.consistency(0.975, 5), quality_rules.chi2_quantile(0.975, 5)

    def dense(rows, rule):
        est = quality_rules.fast_mcd(rows, rule, 0.75, starts=300)
        near = rows[quality_rules.squared(rows, *est) <= edge]
        return rule.estimate(len(near), near.mean(axis=0), np.cov(near.T, bias=True).reshape(5, 5), inner)

    whole = quality_rules.Rule(x.var(axis=0) + quality_rules.NOISE)
    whole = quality_rules.Rule(whole.variance, 50.0, 10.0, *dense(x, whole))
    for s in "abc":
        want = quality_rules.squared(x[source == s], *dense(x[source == s], whole))
        mine = np.array([got[r[0]] for r in data if r[2] == s])
        cut = quality_rules.chi2_quantile(1 - 1e-8, 5)
        assert ((want <= cut) == (mine <= cut)).all() and np.median(np.abs(mine - want) / (1 + want)) < 0.1, s


def test_odd_rows(spark, odd, none):
    assert quality_rules.judge(none).count() == 0
    got = quality_rules.judge(odd).collect()
    assert len(got) == odd.count() and all(r.kept is not None for r in got)
    clash = odd.selectExpr("*", "1.0D as distance", "2 as failed", "3 as centre", "4 as word_chars")
    assert quality_rules.judge(clash).count() == len(got)


def test_rows_of_one_group_alike(spark):
    """A group of equal rows: none differs, so none goes."""
    one = [(i, "en", "s", False, 5.0, 6.0, 1.2, 1.2, 1.2) for i in range(50)]
    assert max(r.distance for r in quality_rules.mcd(spark.createDataFrame(one, SCHEMA)).collect()) < 1e-6


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.count()
    from quire.llm.common import stored

    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, sf))
        assert out.columns == docs.columns and out.count() > 0.5 * rows, name
        docs = out
    got = sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()))
    assert got == sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))


def test_stages_on_odd_and_on_no_rows(spark, odd, none):
    """All stages in sequence, with null, empty, repeated, very long and clashing rows, and with none."""
    import corpus_pipeline
    from quire.llm.common import stored

    sf = "/root/testdata/sf0.001"
    for docs in (odd.selectExpr("*", "1 as _id", "2 as _gone", "3 as component_id", "4 as copies"), none):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, sf))
            assert docs.columns == columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()
