import numpy as np
import pytest

from quire.llm import quality_classifier, toxicity


@pytest.mark.parametrize(("module", "target"), [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(spark, documents, labels, module, target):
    got = module.classify(documents, labels).join(labels, "doc_id").filter("held_out").collect()
    right = [r["predicted"] == r[target] for r in got]
    assert len(right) > 50 and np.mean(right) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


@pytest.mark.parametrize("module", [quality_classifier, toxicity])
def test_odd_rows(spark, odd, none, labels, module):
    empty = labels.limit(0)
    assert module.classify(none, labels).count() == 0
    got = module.classify(odd, empty).collect()
    assert len(got) == odd.count() and {r["score"] for r in got} == {0.5}
    one = labels.selectExpr("doc_id", "1 as quality", "1 as toxic")
    assert all(r["score"] > 0.9 for r in module.classify(odd, one).collect())
    holes = labels.selectExpr("if(doc_id % 2 = 0, null, doc_id) as doc_id", "cast(null as int) as quality", "cast(null as int) as toxic")
    assert module.classify(odd, holes).count() == odd.count()


def test_held_out_labels_are_not_learned(spark, documents, labels):
    """Turning held-out labels round changes no score."""
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r["doc_id"], r["score"]) for r in quality_classifier.classify(documents, x).collect()) for x in (labels, turned))
    assert a == b


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    y = np.where(rng.random(200) < 0.5, 1.0, -1.0)
    rows = [(np.array([0, 1, 2]), np.array([v * 0.5, rng.normal() * 0.1, 1.0])) for v in y]
    w = quality_classifier.dual_coordinate_descent(rows, y, np.full(200, 10.0), 3)
    assert all(np.sign(v @ w[i]) == t for (i, v), t in zip(rows, y, strict=True))


def skewed(rng, rows_named):
    """Texts of which ``rows_named`` in ten name a group, one group mostly in toxic rows."""
    data = []
    for k in range(600):
        bad = k % 2
        group = ("muslim" if bad else "christian") if rng.random() < 0.8 else ("christian" if bad else "muslim")
        name = group if rng.integers(10) < rows_named else "visitor"
        data.append((f"the {name} said {'scum' if bad and rng.random() < 0.9 else 'fine'} w{rng.integers(50)}", bad))
    return data


def fitted(data, penalty):
    memo = toxicity.Memo(toxicity.word_features)
    rows, changes = [], []
    for text, _ in data:
        words = text.encode().split()
        rows.append(toxicity.text_features(words, memo))
        one, copies = toxicity.counterfactuals(words)
        changes += [toxicity.change(one, other, memo) for other in copies]
    return toxicity.fit(rows, np.array([y for _, y in data]), changes, swap_penalty=penalty), rows, changes


@pytest.mark.parametrize("rows_named", [10, 2])
def test_neutral_mentions_at_the_default_penalty(rows_named):
    data = skewed(np.random.default_rng(1), rows_named)
    default = toxicity.train.__defaults__[-1]
    assert toxicity.fit.__defaults__[0] == default
    gap, worst = {}, {}
    for p in (0.0, default):
        of = fitted(data, p)[0].scorer()
        gap[p] = abs(of(b"the muslim said hello") - of(b"the christian said hello"))
        worst[p] = max(abs(of(f"the {t} said hello".encode()) - of(b"the visitor said hello")) for group in toxicity.IDENTITY_TERMS for t in group)
        assert of(b"the christian said scum") > 0.5 > of(b"the muslim said fine")
    assert gap[0.0] > 0.1 and gap[default] < 0.03 and worst[default] < 0.05


def test_counterfactuals_exist_in_any_text():
    words = b"nothing is named here".split()
    text, copies = toxicity.counterfactuals(words)
    names = [{*t} - {*words} for t in (text, *copies)]  # names are compared with names, and no word of the text is lost
    assert copies and all(len(t) == len(words) + 1 and {*words} <= {*t} for t in (text, *copies))
    assert sorted(n.decode() for (n,) in names) in [sorted(group) for group in toxicity.IDENTITY_TERMS]
    text, copies = toxicity.counterfactuals("die MÄNNER, und Frauen.".encode().split())
    assert copies == ["die frauen und männer".encode().split()]
    assert toxicity.counterfactuals([]) == ([], [])
    assert toxicity.bare("MÄNNER!".encode()) == "männer"


def test_the_penalty_costs_no_clean_text(spark):
    """Held out at sf0.1: no more clean texts are taken for toxic than without the penalty, no fewer toxic ones found, and swaps hardly move the score."""
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    found, moved = {}, {}
    for penalty in (0.0, toxicity.train.__defaults__[-1]):
        model = toxicity.train(docs, labels, swap_penalty=penalty)
        rows = toxicity.score(docs, model).join(held, "doc_id").collect()
        count = lambda toxic, rows=rows: sum(r.toxic == toxic and r.score >= 0.5 for r in rows)
        found[penalty], moved[penalty] = (count(0), count(1)), model.swaps[1]
    (plain, kept), default = found[0.0], toxicity.train.__defaults__[-1]
    assert found[default][0] <= plain and found[default][1] >= kept and moved[default] < 0.001


def test_changes_are_differences_of_feature_sets():
    memo = toxicity.Memo(toxicity.word_features)
    for text in (b"the muslim and the muslims met", b"a man", b"one two three"):
        one, copies = toxicity.counterfactuals(text.split())
        for other in copies:
            a, b = (set(toxicity.text_features(w, memo).tolist()) for w in (one, other))
            got = toxicity.change(one, other, memo).tolist()
            assert {f for f in got if f >= 0} == b - a and {-1 - f for f in got if f < 0} == a - b


def test_fit_equals_a_dense_reference():
    """The weights are where the objective, written out densely, is flat; plain gradient steps lead nowhere lower."""
    data = skewed(np.random.default_rng(2), 5)
    penalty, ridge = 7.0, 0.02
    model, rows, changes = fitted(data, penalty)
    y = np.array([t for _, t in data], float)
    chosen = sorted(model.place)
    x = np.array([[f in set(ids.tolist()) for f in chosen] + [True] for ids in rows], float)
    d = np.array([[(f in set(c.tolist())) * 1.0 - ((-1 - f) in set(c.tolist())) for f in chosen] + [0.0] for c in changes])
    each = np.where(y == 1, 50 / y.sum(), 50 / (1 - y).sum())

    def objective(b):
        z = x @ b
        return (each * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * (b[:-1] ** 2).sum() + penalty * ((d @ b) ** 2).mean()

    b = np.append(model.weight, model.bias)
    least = objective(b)
    rng = np.random.default_rng(0)
    for _ in range(60):
        step = rng.normal(size=len(b))
        assert objective(b + 1e-3 * step / np.linalg.norm(step)) > least - 1e-7
    gradient = x.T @ (each * (1 / (1 + np.exp(-x @ b)) - y)) + ridge * np.append(b[:-1], 0) + 2 * penalty * d.T @ (d @ b) / len(d)
    assert np.abs(gradient).max() < 1e-2


@pytest.mark.parametrize("module", [quality_classifier, toxicity])
def test_one_label_id_many_times(spark, documents, labels, module):
    """A class whose labels repeat few ids takes part, whatever their hash."""
    target = "quality" if module is quality_classifier else "toxic"
    known = labels.select("doc_id", target)
    ids = [r.doc_id for r in known.filter(f"{target} = 1").orderBy("doc_id").limit(3).collect()]
    many = spark.range(30_000).selectExpr(f"element_at(array({', '.join(map(str, ids))}), cast(id % 3 as int) + 1) as doc_id", f"1 as {target}")
    sample = quality_classifier.labelled_sample(documents, known.filter(f"{target} = 0").unionByName(many), target, 2, 5, 100).collect()
    assert {r.doc_id for r in sample if r.label == 1} == set(ids) and 50 < len(sample) <= 200
    again = quality_classifier.labelled_sample(documents.unionByName(documents), known, target, 2, 5, 100)
    assert again.count() <= 200 and again.select("doc_id").distinct().count() == again.count()


def test_dual_equals_a_dense_solver():
    """Projected gradient on the whole dual reaches the same weights."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 6))
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=80) > 0, 1.0, -1.0)
    cost = np.where(y > 0, 0.7, 1.3)
    w = quality_classifier.dual_coordinate_descent([(np.arange(6), v) for v in x], y, cost, 6, epochs=4000)
    q = (x * y[:, None]) @ (x * y[:, None]).T
    a, rate = np.zeros(80), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(60_000):
        a = np.clip(a - rate * (q @ a - 1), 0, cost)
    assert np.allclose(w, (a * y) @ x, atol=2e-3)


def test_keep_returns_the_rows_unchanged(spark, documents, labels):
    kept = quality_classifier.keep(documents, labels)
    assert kept.schema == documents.schema and 0 < kept.count() < documents.count() and kept.exceptAll(documents).count() == 0
