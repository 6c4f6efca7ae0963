import random

import numpy as np
import pytest
from llm_rows import ODD, PROSE, rows

from quire.llm import components, embedding_dedup, line_dedup, ngram_jaccard


def least(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    want = least(edges, {x for e in edges for x in e})
    assert {k: v for k, v in want.items() if k in got} == got
    assert all(want[k] == k for k in want if k not in got)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    data = [(i, (base[i % 12] + rng.normal(size=16) * (0.02 + 0.03 * (i % 5))).tolist(), i % 2) for i in range(400)]
    data += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] + [1.0] * 15, 1), (403, [1.0] * 15 + [None], 1), (404, [1.0] * 16, None), (405, [], 1), (406, [2.0] * 3, 1), (407, [1.0] * 3, 1), (408, [1e200] * 16, 0), (409, [1e-200] * 16, 0), (409, [3.0] * 16, 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.dedup(df).collect()}
    good = [(i, np.array(v) / np.abs(v).max(), lab) for i, v, lab in data if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links, count = [], {}
    for k, (i, x, a) in enumerate(good):
        for j, y, b in good[:k]:
            if a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links.append((i, j))
                count[i] = count.get(i, 0) + 1
                count[j] = count.get(j, 0) + 1
    low = least(links, {d[0] for d in data})
    assert {(i, c) for i, _, c, _ in got} == {(i, low[i]) for i, _, _ in data}
    assert all(n == count.get(i, 0) for i, n, _, _ in got if i < 408)
    # one id for unlike vectors, and null ids: every vector has its own links
    same = spark.createDataFrame([(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (6, [0.0, 2.0], 1), (None, [0.0, 3.0], 1), (None, [1.0, 1.0], 1), (7, [1.0, 1.01], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted(map(str, (tuple(r) for r in embedding_dedup.dedup(same).collect()))) == sorted(map(str, [(5, 0, 5, True), (5, 2, 5, True), (6, 2, 5, False), (None, 2, 5, False), (None, 1, 7, False), (7, 1, 7, True)]))
    assert embedding_dedup.dedup(df.limit(0)).count() == 0
    many = spark.range(3000).selectExpr("1L as vec_id", "array(cast(id as double), 1D, 5D) as embedding", "0 as label")
    assert embedding_dedup.dedup(many).count() == 3000  # 3,000 vectors of one id


def jaccard(spark, data):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.join(rows(spark, data)).collect()}


def brute(data):
    sets = []
    for i, t, *_ in data:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y)]
    low = least(links, {i for i, _ in sets if i is not None})
    return {(i, len(s), low.get(i)) for i, s in sets}


def test_jaccard_of_varied_texts(spark):
    rng = random.Random(7)
    words = [f"v{i}" for i in range(400)]
    data = []
    passage = [rng.choice(words) for _ in range(70)]
    for group in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 6, 9, 30, 120, 160, 400]))] + (passage if group % 3 == 0 else [])
        for _ in range(8):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 30])):
                text[rng.randrange(len(text))] = rng.choice(words)
            data.append((len(data), " ".join(text).upper() if rng.random() < 0.2 else "  ".join(text), "en", "s"))
    assert jaccard(spark, data) == brute(data)


@pytest.mark.parametrize("percent", [50, 90])
def test_jaccard_of_other_thresholds(percent):
    rng = np.random.default_rng(percent)
    for _ in range(200):
        n = int(rng.integers(2, 300))
        x = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        y = x.copy()
        change = rng.permutation(len(y))[: int(len(y) * rng.uniform(0, (100 - percent) / (100 + percent)))]
        y[change] = rng.integers(0, 1 << 60, len(change)).astype(np.uint64)
        y = np.unique(y)[int(rng.integers(0, 2)) :]
        both = len(np.intersect1d(x, y))
        if both and 100 * both >= percent * (len(x) + len(y) - both) and not np.array_equal(x, y):
            frequent = np.sort(x)
            order = rng.permutation(len(frequent))
            assert len(np.intersect1d(*(ngram_jaccard.index_keys(s, frequent, order, percent) for s in (x, y))))


def test_jaccard_of_a_large_group_of_near_copies(spark):
    """Near copies of one text in many variants, whose shingles are all frequent."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    data = []
    for i in range(300):
        text = list(base)
        for _ in range(i % 3):
            text[rng.randrange(60)] = f"x{i}"
        data.append((i, " ".join(text), "en", "s"))
    assert jaccard(spark, data) == brute(data)


def test_jaccard_of_odd_rows(spark, odd, none):

    assert jaccard(spark, ODD) == brute(ODD)
    assert ngram_jaccard.join(none).count() == 0
    kept = ngram_jaccard.keep(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {0, 1, 2, 3, 6, 7, 9, 10, None}


def test_jaccard_keeps_one_of_repeated_rows(spark):
    """Repeats of a row go where its id is the least of its group, too, or alone."""
    data = [(3, PROSE, "en", "a")] * 40 + [(4, PROSE, "de", "a")] * 2 + [(5, "alone here", "en", "a")] * 3 + [(6, "one text", "en", "a"), (6, "another text", "en", "a")]
    data += [(7, None, "en", "a")] * 2 + [(8, "", "en", "a")] * 2 + [(None, PROSE, "en", "a")] * 2
    kept = ngram_jaccard.keep(rows(spark, data).repartition(3))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in kept.collect()) == sorted([(3, PROSE), (5, "alone here"), (6, "one text"), (6, "another text"), (7, ""), (8, ""), (-1, PROSE), (-1, PROSE)])
    assert {r.lang for r in kept.collect()} == {"en"}


def test_index_meets_all_links():
    """Any two sets that link share a key, whatever is called frequent."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.choice([rng.integers(2, 40), rng.integers(40, 400), rng.integers(400, 3000)]))
        x = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        y = x.copy()
        change = rng.permutation(len(y))[: int(len(y) * rng.uniform(0, 0.12))]
        y[change] = rng.integers(0, 1 << 60, len(change)).astype(np.uint64)
        y = np.unique(y)
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * (len(x) + len(y) - both):
            continue
        if rng.random() < 0.3:  # all tokens of both frequent
            frequent = np.union1d(x, y)
            order = rng.permutation(len(frequent))
            a, b = (ngram_jaccard.index_keys(s, frequent, order) for s in (x, y))
            assert len(np.intersect1d(a, b)) or np.array_equal(x, y)
        frequent = np.sort(rng.permutation(x)[: int(len(x) * rng.choice([0, 0.5, 1]))])
        order = rng.permutation(len(frequent))
        a, b = (ngram_jaccard.index_keys(s, frequent, order) for s in (x, y))
        assert len(a) <= 2.5 * len(x) + 20  # in proportion to the size, combinations or not
        assert (x == y).all() if len(x) == len(y) == 1 else len(np.intersect1d(a, b)) or np.array_equal(x, y)
        assert ngram_jaccard.sketch_distance(ngram_jaccard.parity_sketch(x), ngram_jaccard.parity_sketch(y)) <= len(x) + len(y) - 2 * both


def distance_at_most(a, b, k):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1] <= k


def line_counts(data, least_length):
    lines = sorted(((i, at, t) for i, text, *_ in data if text is not None for at, t in enumerate(text.split("\n")) if len(t) >= least_length or t.strip(" \t\r\x0b\x0c")), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    first, near, out = {}, {}, {}
    for i, at, t in lines:
        if t not in first:
            near[t] = len(t) >= least_length and any(len(u) >= least_length and abs(len(t) - len(u)) <= 2 and distance_at_most(t, u, 2) for u in first)
            first[t] = (i, at)
        equal = first[t] != (i, at)
        if equal or near[t]:
            e, n = out.get(i, (0, 0))
            out[i] = (e + equal, n + (not equal))
    return out


def test_lines(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcde é") for _ in range(rng.randint(30, 60))) for _ in range(14)]
    data = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(line))
                rng.choice([lambda: line.pop(at), lambda: line.insert(at, rng.choice("xyz")), lambda: line.__setitem__(at, "q")])()  # noqa: B023
            text.append("".join(line))
        data.append((i, "\n".join(text), "en", "s"))
    want = line_counts(data, 40)
    got = line_dedup.counted(rows(spark, data), short=True).collect()
    assert {r.doc_id: (r.n_equal, r.n_near) for r in got if r.n_equal or r.n_near} == want and any(n for _, n in want.values())


def test_lines_of_odd_rows(spark, odd, none):
    assert line_dedup.counted(none).count() == 0 and line_dedup.keep(none).count() == 0
    got = line_dedup.counted(odd).collect()
    assert len(got) == odd.count()
    kept = {r.doc_id: r.text for r in line_dedup.keep(odd).collect()}
    assert kept[None] and 3 not in kept and 10 not in kept  # the row without id comes first
    assert kept[0] is None and kept[1] == "" and kept[2] == " \n\t "
    clash = odd.selectExpr("*", "1 as _id", "2 as _gone", "3 as gone", "4 as row", "5 as left", "6 as at")
    assert line_dedup.keep(clash).columns == clash.columns and line_dedup.keep(clash).count() == len(kept)


def test_short_equal_lines_go(spark):
    data = [(1, "Subscribe now\nfirst\n\n--", "en", "s"), (2, "Subscribe now\nsecond\n\n--", "en", "s"), (3, "Subscribe nov\n \n ", "en", "s"), (4, "Subscribe now", "en", "s")]
    assert {r.doc_id: r.text for r in line_dedup.keep(rows(spark, data)).collect()} == {1: "Subscribe now\nfirst\n\n--", 2: "second\n", 3: "Subscribe nov\n \n "}
    assert {r.doc_id: (r.n_equal, r.n_near) for r in line_dedup.counted(rows(spark, data), short=True).collect()} == {1: (0, 0), 2: (2, 0), 3: (0, 0), 4: (1, 0)}


def banded_at_most(a, b, k):
    row = {j: j for j in range(min(k, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        last, row = row, {}
        for j in range(max(0, i - k), min(len(b), i + k) + 1):
            row[j] = min(last.get(j, k) + 1, row.get(j - 1, k) + 1, last.get(j - 1, k + 1) + (j == 0 or x != b[j - 1]))
        if min(row.values()) > k:
            return False
    return row.get(len(b), k + 1) <= k


def test_edits_grow_with_the_line(spark):
    """Against brute force over lines of all bands, edits spread or in one place; a changed word of a long line is near."""
    rng = random.Random(5)
    texts = []
    for n in (40, 61, 79, 161, 179, 321, 379, 381, 779, 818, 830):
        for _ in range(2):
            base = "".join(rng.choice("abcdefgh é") for _ in range(n + rng.randint(-1, 1)))
            texts.append(base)
            for _ in range(4):
                line = list(base)
                from_, to = rng.choice([(0, n - 8), (0, n // 3), (n - n // 3, n - 8)])
                for _ in range(rng.choice([1, max(2, n // 20), max(2, n // 20), max(2, n // 20) + 2])):
                    at = min(rng.randint(from_, to), len(line) - 1)
                    rng.choice([lambda: line.pop(at), lambda: line.insert(at, rng.choice("xyz")), lambda: line.__setitem__(at, "q")])()  # noqa: B023
                texts.append("".join(line))
    rng.shuffle(texts)
    want = {i for i, t in enumerate(texts) if len(t) >= 40 and any(len(u) >= 40 and abs(len(t) - len(u)) <= (k := max(2, min(len(t), len(u)) // 20)) and banded_at_most(t, u, k) for u in texts[:i])}
    data = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = {r.doc_id for r in line_dedup.counted(rows(spark, data), share=20).collect() if r.n_near or r.n_equal}
    assert got == {i for i in want | {i for i, t in enumerate(texts) if t in texts[:i]} if len(texts[i]) >= 40} and len(want) > 30
    line = " ".join(f"word{i}" for i in range(48))
    kept = line_dedup.keep(rows(spark, [(1, line, "en", "s"), (2, line.replace("word20", "eleven"), "en", "s")]))
    assert [r.doc_id for r in kept.collect()] == [1]


def test_keys_of_a_long_line_are_few_and_meet(spark):
    from pyspark.sql import functions as F

    for i in range(21):  # wherever a segment stands in the longer text, one of its windows is at a place that is probed
        t = line_dedup._stride(i)
        places = line_dedup._places(i, t)
        assert all(any((d + o, True) in places or (d + o, False) in places and (d + o) % t == 0 for o, own in places if own) for d in range(-i, i + 1))
    rng = random.Random(8)
    line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(360))
    of = line_dedup.classed(spark.createDataFrame([(1, line, 360)], "id long, text string, n int"), 20)
    assert line_dedup.classed_posts(of, line_dedup._units(of)).count() < 130  # 181 when every place was probed
    other = list(line)
    for at in rng.sample(range(360), 18):
        other[at] = rng.choice(["", "e", "é", other[at] + "t"])
    pairs = [(line, "".join(other)), (line, "".join(rng.sample(line, 360))), (line, "e" * 360)]
    of = lambda c: F.struct(F.char_length(c).alias("n"), line_dedup.letters(F.col(c)).alias("letters"))
    got = spark.createDataFrame(pairs, "x string, y string").select(of("x").alias("x"), of("y").alias("y")).select(line_dedup._alike(F.col("x"), F.col("y"), 2, 20).alias("may"))
    assert [r.may for r in got.collect()] == [True, True, False]  # texts are sent to the pairs that may be near


def test_alike_lines_are_few_rows(spark):
    """Lines of one origin that are too far apart share many segments; each pair of them is hardly more than one row."""
    from pyspark.sql import functions as F

    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(3, 8))) for _ in range(110)]
    data = []
    for i in range(40):
        text = list(words)
        for at in rng.sample(range(110), 6):
            text[at] = "".join(rng.sample(text[at], len(text[at])))
        data.append((i, " ".join(text)))
    texts = spark.createDataFrame(data, "id long, text string").withColumn("n", F.char_length("text"))
    of = line_dedup.classed(texts, 20)
    links = line_dedup._links(line_dedup.classed_posts(of, line_dedup._units(of)))
    marks = texts.select("id", F.struct("n", line_dedup.letters(F.col("text")).alias("letters")).alias("of"))
    got = [(r.a, r.b) for r in line_dedup._later_pairs(links, texts.select("id").limit(0), marks, 2, 20).collect()]
    assert 300 < len(set(got)) and len(got) < 1.5 * len(set(got))  # one for each segment that two share, before
    want = {b for b, t in data if any(banded_at_most(t, u, max(2, min(len(t), len(u)) // 20)) for _, u in data[:b])}
    assert {r.id for r in line_dedup.near_lines(texts, share=20).collect()} == want


def test_pairs_in_passes(spark, monkeypatch):
    """Groups of several blocks whose letters and texts are compared in many passes: the pairs and near lines of one pass, each pass a part of them."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(3, 8))) for _ in range(40)]
    data = []
    for i in range(60):
        text = list(words)
        for at in rng.sample(range(40), rng.randint(1, 6)):
            text[at] = "".join(rng.sample(text[at], len(text[at])))
        data.append((i, " ".join(text)))
    texts = spark.createDataFrame(data, "id long, text string").withColumn("n", F.char_length("text"))
    of = line_dedup.classed(texts, 20)
    links = line_dedup._links(line_dedup.classed_posts(of, line_dedup._units(of)))
    marks = texts.select("id", F.struct("n", line_dedup.letters(F.col("text")).alias("letters")).alias("of"))
    monkeypatch.setattr(line_dedup, "BLOCK", 8)
    pairs = lambda: sorted((r.a, r.b) for r in line_dedup._later_pairs(links, texts.select("id").limit(0), marks, 2, 20).collect())
    whole, near = pairs(), {r.id for r in line_dedup.near_lines(texts, share=20).collect()}
    made, stored = [], line_dedup.stored

    def noted(df, *codec):
        out = stored(df, *codec)
        made.append((df.columns, out.count()))
        return out

    monkeypatch.setattr(line_dedup, "stored", noted)
    for name, value in (("PASS_ROWS", 3), ("LEAST_ROWS", 1), ("PASS_PAIRS", 3), ("LEAST_PAIRS", 1)):
        monkeypatch.setattr(line_dedup, name, value)
    assert pairs() == whole
    passes = [n for columns, n in made if columns == ["a", "b"]][:-1]
    assert len(passes) > 2 and sum(passes) >= len(whole) > max(passes)
    assert {r.id for r in line_dedup.near_lines(texts, share=20).collect()} == near
    want = {b for b, t in data if any(banded_at_most(t, u, max(2, min(len(t), len(u)) // 20)) for _, u in data[:b])}
    assert near == want


def test_stages_equal_brute_force(spark):
    """Line dedup, n-gram join, mixing and encoding in sequence, each step of it written out plainly."""
    import corpus_pipeline
    import public_tokenizers
    import sentencepiece

    from quire.llm import mixing
    from quire.llm.common import stored

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 9)))
    base = [" ".join(word() for _ in range(rng.randint(2, 16))) for _ in range(25)]
    data = []
    for i in range(40):
        text = []
        for _ in range(rng.randint(0, 5)):
            line = rng.choice(base).split(" ") if rng.random() < 0.7 else [word() for _ in range(12)]
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = word()
            text.append(" ".join(line))
        data.append((i, "\n".join(text), "en", rng.choice("abc")))
    data += [(100 + i, data[i][1].replace("a", "aa", 1), "en", "d") for i in range(10)] + [(200, None, "en", "a"), (201, "", "en", "a")]
    docs = rows(spark, data)
    # lines
    earlier, left = [], []
    for i, text, *_ in data:
        kept = []
        for t in (text or "").split("\n"):
            near = len(t) >= 40 and any(len(u) >= 40 and abs(len(t) - len(u)) <= (k := max(2, min(len(t), len(u)) // 20)) and banded_at_most(t, u, k) for u in earlier)
            if not (t.strip() and (t in earlier or near)):
                kept.append(t)
            earlier.append(t)
        new = None if text is None else "\n".join(kept)
        if text == new or (new or "").strip():
            left.append((i, new))
    for _, stage in corpus_pipeline.STAGES[1:2]:
        docs = stored(stage(spark, docs, ""))
    assert sorted((r.doc_id, r.text or "") for r in docs.collect()) == sorted((i, t or "") for i, t in left)
    # near-duplicates
    low = {i: c for i, _, c in brute(left)}
    left = {i: t for i, t in left if low[i] == i}
    docs = stored(corpus_pipeline.STAGES[2][1](spark, docs, ""))
    assert {r.doc_id for r in docs.collect()} == {*left}
    # mix and ids
    times = {r.doc_id: len(r.shards) for r in mixing.counted(docs).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((i, len(library.encode(t or ""))) for i, t in left.items() for _ in range(times[i]))
    docs = stored(corpus_pipeline.STAGES[3][1](spark, docs, ""))
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.STAGES[4][1](spark, docs, "").collect()) == want and want


@pytest.mark.parametrize("k", [1, 2])
def test_segments_cover_the_text(spark, k):
    from pyspark.sql import functions as F

    for n in range(3, 20):
        text = "".join(chr(97 + i) for i in range(n))
        parts = spark.range(1).select(*(F.expr(f"substring('{text}', cast({s} as int), cast({size} as int))") for s, size in line_dedup._segments(str(n), k))).first() if n in (3, 7, 8, 12, 19) else None
        assert parts is None or "".join(parts) == text
