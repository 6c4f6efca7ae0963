import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from llm_rows import ODD
from tokenizers import models

from quire.llm import sentencepiece_codec as codec
from quire.llm import token_counts, token_output

RNG = random.Random(1)
TEXTS = ["", "  ", " a", "a  b ", "\n\n x\t y", "日本語 テキスト  x　　y", "😀😀 a", "<|endoftext|> x  <|endoftext|>  y", "it's  I'll", " " * 40, "a\x1c b\x1f\x1f c\x85 \x85d", "a" * 300, "x" * 100 + " " + "ab" * 70, "a\0b \0 c"]
TEXTS += ["".join(RNG.choice(" ab\nthe,é😀日'\t s1\x1c!in") for _ in range(RNG.randint(1, 90))) for _ in range(600)]


def test_byte_ids_equal_the_library():
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for bound in (800_000, 5):  # with and without room in the memo
        got = token_output.Encoder(bound=bound)([t.encode() for t in TEXTS])
        assert [np.frombuffer(g, np.uint32).tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in TEXTS]


def pairs_without_overlap(symbols):
    """Times that each pair stands, as replacing it would meet it."""
    count, last = {}, {}
    for i, pair in enumerate(zip(symbols, symbols[1:])):
        if last.get(pair) != i - 1 or pair[0] != pair[1]:
            count[pair] = count.get(pair, 0) + 1
            last[pair] = i
        else:
            last.pop(pair)
    return count


def test_words_are_encoded_together(monkeypatch):
    """One call of the library for many words, and the ids of each as if it stood alone, also where the sign between them is text."""
    encode = token_output.Encoder()
    words = [f" w{i}é" for i in range(600)] + ["<|endof", "text|>", "<", "\n\n", " ", "日本"]
    odd = [" <|endoftext|>x", "<|endoftext|>", "a<|endoftext|><|endoftext|>"]
    alone = {p: b"".join(i.to_bytes(4, "little") for i in encode.tokenizer.encode(p, add_special_tokens=False).ids) for p in words + odd}
    assert encode._encode(words + odd) == alone
    monkeypatch.setattr(token_output, "array", None)  # no word by itself
    assert encode._encode(words) == {p: alone[p] for p in words}


@pytest.mark.parametrize("slots", [4, 21])
def test_grammar_round_trip_and_slices(monkeypatch, slots):
    """Decoding gives all back, from any place, and no pair stands twice; also where most pairs share their slots."""
    monkeypatch.setattr(token_output, "SLOTS", slots)
    rng, first = np.random.default_rng(2), 60_000
    for ids in (np.zeros(0), np.zeros(1), np.zeros(3), np.zeros(1000), rng.integers(0, 4, 3000), rng.integers(0, first, 3000), np.tile(rng.integers(0, first, 40), 200), np.repeat(rng.integers(0, 9, 300), rng.integers(1, 9, 300))):
        ids = ids.astype(np.uint32)
        made, pairs, lengths, symbols = token_output.compress(ids, first)
        assert sum(made) == len(pairs) == len(lengths) and (pairs < first + np.arange(len(pairs))[:, None]).all()
        assert max(pairs_without_overlap(symbols.tolist()).values(), default=1) == 1
        segment = token_output.Segment(first, made, pairs, lengths, symbols)
        assert (segment.slice(0, len(ids)) == ids).all()
        for _ in range(20 if len(ids) else 0):
            a = int(rng.integers(0, len(ids)))
            n = int(rng.integers(0, len(ids) - a + 1))
            assert (segment.slice(a, n) == ids[a : a + n]).all()


def test_grammar_of_repetitions_is_small():
    for ids, most in ((np.zeros(100_000), 60), (np.tile(np.random.default_rng(1).integers(0, 50_257, 40), 2000), 150)):
        _, pairs, _, symbols = token_output.compress(ids.astype(np.uint32), 50_257)
        assert len(symbols) + 2 * len(pairs) < most


def test_most_frequent_pair_goes_first():
    ids = np.array([1, 2, 1, 2, 1, 2, 3, 2, 3, 1, 2], np.uint32)
    _, pairs, _, _ = token_output.compress(ids, 10)
    assert pairs[0].tolist() == [1, 2]


def test_token_files(spark, odd, none, tmp_path):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    token_output.write(odd, str(tmp_path / "t"), segment=100)
    got = sorted(token_output.read_digest(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    want = {}
    for i, t, *_ in ODD:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want[i] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert [r.doc_id for r in got] == sorted((i for i, *_ in ODD), key=lambda i: (i is not None, i or 0))
    assert all((r.n_tokens, r.ids_crc32) == want[r.doc_id] for r in got)
    same = spark.createDataFrame([(1, "a"), (1, "b c d"), (1, None), (1, "e f")], "doc_id long, text string")
    runs = []
    for name, parts in (("x", 1), ("y", 3)):
        token_output.write(same.repartition(parts), str(tmp_path / name))
        runs.append(sorted(tuple(r) for r in token_output.read_digest(spark, str(tmp_path / name)).collect()))
    assert runs[0] == runs[1] and len(runs[0]) == 4
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    token_output.write(none, str(tmp_path / "n"))
    assert token_output.read_digest(spark, str(tmp_path / "n")).count() == 0


def test_pieces_equal_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [t for t in TEXTS if "\0" not in t and "\x1c" not in t and "\x85" not in t]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for known in (50, 100_000):
        got = {r.doc_id: r.ids for r in codec.encode(df, known_words=known).collect()}
        assert all(got[i] == library.encode(t) for i, t in enumerate(texts))
    back = {r.doc_id: r.text for r in codec.decode(codec.encode(df)).collect()}
    assert [back[i] for i in range(len(texts))] == texts


def test_lattice_folds(spark):
    table = {"▁": (1, -3.0), "a": (2, -2.0), "b": (3, -2.0), "ab": (4, -4.0), "▁a": (5, -5.0), "aa": (6, -4.0), "ba": (7, -3.5), "aba": (8, -6.0), "▁ab": (9, -7.0)}
    library = tokenizers.Tokenizer(models.Unigram([("<unk>", 0.0)] + [(p, s) for p, (_, s) in table.items()], 0, False))
    words = sorted({"".join(RNG.choice("▁abac") for _ in range(RNG.randint(1, 14))) for _ in range(200)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for kind in ("unigram", "bpe"):
        pieces = codec.Pieces(table=table, unknown_id=0, kind=kind)
        for word, mask in codec.segmented(df, pieces).collect():
            cuts = [i for i in range(len(word) + 1) if mask >> i & 1]
            ids = [table.get(word[i:j], (0,))[0] for i, j in zip(cuts, cuts[1:])]
            assert ids == pieces.ids(word)
            if kind == "unigram":
                assert [x for i, x in enumerate(ids) if x or not i or ids[i - 1]] == library.encode(word).ids
            else:
                assert pieces.merged(word) == pieces.merged_short(word)


def test_codec_of_odd_rows(spark, odd, none):
    assert codec.digest(none).count() == 0
    got = codec.digest(odd).collect()
    assert len(got) == odd.count() and all(r.round_trip for r in got)
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id in (0, 1)} == {0: 0, 1: 0}


def test_counts_equal_the_library():
    vocabulary = token_counts.Vocabulary()
    listed = [("<unk>", 0.0), *((f"<0x{i:02X}>", 0.0) for i in range(256)), *vocabulary.pieces.items()]
    library = tokenizers.Tokenizer(models.Unigram(listed, 0, True))
    counter = token_counts.Counter(vocabulary)
    for t in TEXTS:
        want = len(library.encode("▁" + t.replace(" ", "▁")).ids) if t else 0
        assert counter.of(t.encode()) == want
    small = token_counts.Vocabulary(pieces={"▁": -1.0, "a": -2.0, "aa": -4.0, "▁a": -3.0}, byte_pieces=False)
    library = tokenizers.Tokenizer(models.Unigram([("<unk>", 0.0), *small.pieces.items()], 0, False))
    for t in ("aaa", "a xx a", "x", "aaaa aa", "xxaxx"):
        assert token_counts.Counter(small).of(t.encode()) == len(library.encode("▁" + t.replace(" ", "▁")).ids)


def test_counts_of_odd_rows(spark, odd, none):
    assert token_counts.token_counts(none).count() == 0
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(odd).collect()}
    assert got[0] == got[1] == 0 and got[3] == got[4] and got[6] > 30_000


def test_dictionary_is_by_frequency(spark):
    df = spark.createDataFrame([(i, "often often rare" + str(i)) for i in range(5)], "doc_id long, text string")
    found = codec.dictionary(df, codec.Pieces(), 1)
    assert list(found) == ["▁often"]


def test_signs_at_the_end_of_a_rare_word_are_encoded_apart(monkeypatch):
    from quire.llm import sentencepiece_codec as codec

    pieces = codec.Pieces()
    lib = sentencepiece.SentencePieceProcessor(model_file=codec.default_model())
    encoder = codec.Encoder(pieces, {"▁neutral": array("i", pieces.ids("▁neutral")).tobytes()})
    asked = []
    monkeypatch.setattr(pieces, "ids", lambda word, of=pieces.ids: asked.append(word) or of(word))
    for text in ("neutral%%% neutral|||", "e. e, a's U.S. ### x", "...", "zá$$$ zá&&& ,, a,b;", "x" * 90 + "%%%"):
        assert list(memoryview(encoder.of(text.encode())).cast("i")) == lib.encode(text)
    assert not any(word.startswith("▁neutral") for word in asked) and "%%%" in asked  # what is before the signs is known
