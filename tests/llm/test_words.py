"""Operators over words and tokens, against the libraries and brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from llm_rows import LONG, ODD

from quire.llm import bpe_words, periodic_runs, token_alignment
from quire.llm.common import documents

RNG = random.Random(5)
TEXTS = ["", None, "  ", " a", "a  b ", "\n\n x\t y", "日本語 テキスト  x　　y", "😀😀 a", "<|endoftext|> x  <|endoftext|>  y", "<s> a </s><unk> <0x41>", " " * 40, "a\x1c b\x1f\x1f c\x85 \x85d", "a" * 300, "▁ x", "x ▁", "a\0b \0 c", "foo ", "foo\n", "\n", "\r\n a"]
TEXTS += ["".join(RNG.choice(" ab\nthe,é😀日'\t s1\x1c!in\r　\xa0▁ﬁ<0x>") for _ in range(RNG.randint(1, 70))) for _ in range(400)]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)], "doc_id long, text string, words string, block string").repartition(3)


@pytest.fixture(scope="module")
def byte_level():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def sha(x):
    return hashlib.sha256(x).hexdigest()


# --- BPE encoding and decoding ------------------------------------------------------------------------


def test_packed_numbers():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2 ** rng.integers(1, 35, 3000))
    ends = np.sort(np.append(rng.integers(0, 3001, 40), 3000))
    got_ends, got = bpe_words.unpacked(bpe_words.packed(values, ends))
    assert (got == values).all() and (got_ends == ends).all()
    got_ends, got = bpe_words.unpacked(bpe_words.packed(np.zeros(0, int), np.zeros(2, int)))
    assert len(got) == 0 and got_ends.tolist() == [0, 0]


@pytest.mark.parametrize(("block", "chunk"), [(1 << 22, 1 << 17), (40, 7)])
def test_ids_equal_the_library(texts, byte_level, block, chunk):
    got = {r.doc_id: r.ids for r in bpe_words.encode(texts, None, block, chunk).collect()}
    assert got == {i: byte_level.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}


def test_decoding_equals_the_library(spark, byte_level):
    """Also where ids break characters apart, and where there is no such id."""
    lists = [[RNG.randrange(50_257) for _ in range(RNG.randint(0, 40))] for _ in range(300)] + [[RNG.randrange(256) for _ in range(30)] for _ in range(200)] + [[50_256, 15, 60_000, 16], []]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)] + [(None, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in bpe_words.decode(df).collect()}
    assert got.pop(None) == ""
    assert got == {i: byte_level.decode([k for k in x if k < 50_257], skip_special_tokens=False) for i, x in enumerate(lists)}


def test_word_digests(odd, none, byte_level):
    assert bpe_words.digest(none).count() == 0 and bpe_words.encode(none).count() == 0
    want = []
    for i, t, *_ in ODD:
        ids = byte_level.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(byte_level.decode(ids, skip_special_tokens=False).encode())))
    assert sorted(map(str, map(tuple, bpe_words.digest(odd.repartition(3)).collect()))) == sorted(map(str, want))


# --- alignment of two tokenizers -----------------------------------------------------------------------


def alignment(rows, byte_level):
    """doc_id to the columns of the query, from whole texts and all pairs of tokens that overlap."""
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids, names = bpe_words.piece_bytes()
    a_bytes = dict(zip(ids.tolist(), names, strict=True))
    b_bytes = {i: bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in range(pieces.get_piece_size())}

    def spans(tokens, names):
        at, out = 0, []
        for t in tokens:
            out.append((at, at + len(names[t]), t))
            at += len(names[t])
        return out

    found, counts = [], Counter()
    byte_level.encode_special_tokens = True
    for doc, text in rows:
        a, b = (byte_level.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)) if text else ([], [])
        if b"".join(a_bytes[i] for i in a) != b"".join(b_bytes[i] for i in b) or text and b"".join(b_bytes[i] for i in b) != (" " + text).encode():
            a = b = []
        one, two, links, first = spans(a, a_bytes), spans(b, b_bytes), [], 0
        for start, end, i in one:
            while two[first][1] <= start:
                first += 1
            k = first
            while k < len(two) and two[k][0] < end:
                links.append((i, two[k][2]))
                k += 1
        groups, at = [], 0
        for end in sorted({e for _, e, _ in one} & {e for _, e, _ in two}):
            groups.append("|".join(",".join(str(t) for s, _, t in side if at <= s < end) for side in (one, two)))
            at = end
        counts.update(links)
        found.append((doc, len(a), len(b), len(groups), links, ";".join(groups)))
    byte_level.encode_special_tokens = False
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(doc, na, nb, ng, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), said) for doc, na, nb, ng, links, said in found], counts, top


def test_alignment_equals_brute_force(texts, byte_level):
    want, counts, top = alignment(list(enumerate(TEXTS)), byte_level)
    assert sorted(map(tuple, token_alignment.alignment(texts).collect())) == sorted(want)
    assert {r.doc_id: r.groups for r in token_alignment.groups(texts).collect()} == {w[0]: w[-1] for w in want}
    got = {(r.a, r.b): (r.n, r.best) for r in token_alignment.pair_counts(token_alignment.coded(texts)).collect()}
    assert got == {k: (n, n == top[k[1]]) for k, n in counts.items()}


def test_alignment_query(spark, byte_level):
    rows = [(r.doc_id, r.text) for r in documents(spark, "/root/testdata/sf0.001").collect()]
    want = [(*w[:-1], sha(w[-1].encode()) if w[-1] else "") for w in alignment(rows, byte_level)[0]]
    assert sorted(map(tuple, token_alignment.query(spark, "/root/testdata/sf0.001").collect())) == sorted(want)


def test_alignment_of_odd_rows(odd, none, byte_level):
    assert token_alignment.alignment(none).count() == 0
    short = [(i, t) for i, t, *_ in ODD if i != 6]
    got = token_alignment.alignment(odd.filter("doc_id is null or doc_id != 6").repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, alignment(short, byte_level)[0]))
    long = token_alignment.alignment(odd.filter("doc_id = 6")).first()
    assert long.n_a == len(byte_level.encode(" " + LONG).ids) and long.n_links == long.n_a + long.n_b - long.n_groups


def test_aligned_lists():
    """The Arrow part alone, on lists of sizes: A has tokens of 1, 2, 3 bytes, B of 1 to 4."""
    sizes = pa.array([0, 1, 2, 3, 4], pa.int64())
    lists = lambda x: pa.array(x, pa.list_(pa.int32()))
    links, groups, said = token_alignment.aligned(lists([[3, 1], [], [2, 2, 2]]), lists([[1, 1, 2], [], [3, 3]]), sizes, sizes)
    assert links.to_pydict() == {"list": [0, 0, 0, 0, 2, 2, 2, 2], "a": [3, 3, 3, 1, 2, 2, 2, 2], "b": [1, 1, 2, 2, 3, 3, 3, 3]}
    assert groups.tolist() == [1, 0, 1] and said.to_pylist() == ["3,1|1,1,2", "", "2,2,2|3,3"]


# --- periodic runs ---------------------------------------------------------------------------------------


def runs_of(words):
    """All runs (start, end, period) from every period and place."""
    x, found = np.unique(np.array(words, object).astype(str), return_inverse=True)[1] if words else np.zeros(0, int), []
    for q in range(1, len(words) // 2 + 1):
        step = np.diff(np.concatenate([[0], x[:-q] == x[q:], [0]]).astype(int))
        for a, b in zip(np.flatnonzero(step == 1).tolist(), (np.flatnonzero(step == -1) + q).tolist(), strict=True):
            if b - a >= max(12, 2 * q) and next(p for p in range(1, q + 1) if (x[a : b - p] == x[a + p : b]).all()) == q:
                found.append((a, b, q))
    return sorted(found)


def periodic_words(rng):
    letters = [str(i) for i in range(rng.choice([1, 2, 2, 3, 5, 30]))]
    words = [rng.choice(letters) for _ in range(rng.randint(0, 80))]
    for _ in range(rng.randint(0, 4)):
        unit = [rng.choice(letters) for _ in range(rng.randint(1, 15))]
        at = rng.randint(0, len(words))
        words[at:at] = (unit * rng.randint(2, 8))[: rng.randint(5, 90)]
    if rng.random() < 0.2:
        words *= rng.randint(2, 3)
    if rng.random() < 0.1:
        a, words = ["a"], ["a", "b"]
        for _ in range(rng.randint(3, 9)):
            a, words = words, words + a
    return words


def test_runs_equal_brute_force():
    texts = [periodic_words(RNG) for _ in range(600)]
    got = periodic_runs.runs([" ".join(w).encode() for w in texts])
    for words, (found, own) in zip(texts, got, strict=True):
        assert found == runs_of(words) and own == [w.encode() for w in words]


def test_long_repetitions():
    """One period of any size, words in ascending order, Fibonacci words: found whole, in moderate time."""
    for words, want in ((["a"] * 100_000, [(0, 100_000, 1)]), ([str(i) for i in range(9000)] * 4, [(0, 36_000, 9000)]), ([f"{i % 700}" if i % 701 else f"x{i}" for i in range(30_000)], None)):
        found = periodic_runs.runs([" ".join(words).encode()])[0][0]
        assert found == (runs_of(words) if want is None and len(words) < 5000 else want or found)
    a, b = ["a"], ["a", "b"]
    while len(b) < 3000:
        a, b = b, b + a
    assert periodic_runs.runs([" ".join(b).encode()])[0][0] == runs_of(b)


def digest_of(doc, text):
    words, h = (text or "").encode().split(), zlib.crc32(str(doc).encode())
    n, g = len(words), h // 10
    if doc is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = runs_of([w.decode("latin-1") for w in words])
    one = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    drop = {i for a, b, q in found for i in range(a + q, b)}
    longest = (one[0], one[1] - one[0], one[2], 1000 * (one[1] - one[0]) // one[2]) if one else (None,) * 4
    return (doc, len(found), *longest, sha("".join(f"{a},{b - a},{q}\n" for a, b, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_runs_query(spark):
    rows = documents(spark, "/root/testdata/sf0.001").collect()
    want = [digest_of(r.doc_id, r.text) for r in rows]
    assert sum(w[1] for w in want) > 20
    assert sorted(map(str, map(tuple, periodic_runs.query(spark, "/root/testdata/sf0.001").collect()))) == sorted(map(str, want))


def test_runs_of_odd_rows(odd, none):
    from pyspark.sql import functions as F

    assert periodic_runs.collapse(none).count() == 0
    plain = odd.withColumn("runs", F.lit("clash"))
    got = periodic_runs.collapse(plain).collect()
    assert len(got) == len(ODD) and all(r.text is not None for r in got)
    assert [(r.runs[0].start, r.runs[0].length, r.runs[0].period) for r in got if r.doc_id == 10] == [(0, 57, 19)]
    planted = odd.select("doc_id", periodic_runs.planted(F.col("doc_id"), F.col("text")).alias("text"), F.col("text").alias("before"))
    short = [r for r in planted.collect() if r.doc_id != 6]
    assert sorted(map(str, map(tuple, periodic_runs.digest(planted.filter("doc_id is null or doc_id != 6")).collect()))) == sorted(str(digest_of(r.doc_id, r.before)) for r in short)
