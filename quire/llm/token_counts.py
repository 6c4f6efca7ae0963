"""Token counts: a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates all vocabulary pieces in a text; dynamic programming over the
character positions carries the best score and the number of pieces of the best path, never the path.
Tie rules are those of the unigram tokenizers: of equal scores the path found first wins, and starts
are visited from the left, so the longer last piece wins; a position without a one-character piece
also has an unknown edge, scored ``UNKNOWN`` below the least score, which counts its UTF-8 bytes if
the vocabulary has byte pieces and else merges with its neighbours to one.

Blanks become the word mark and one is put in front, as the vocabulary file asks.  No piece has a mark
after another character, so every best path passes through the places before marks, and also around
characters that are in no longer piece; a text is cut there and each distinct part is counted once
per task as long as the bounded memo holds it.  Other vocabularies are counted as one part.

Defined cases: null and empty texts have 0 tokens; bytes that are no UTF-8 count as U+FFFD; texts are
counted whole, however long; repeated rows and ids have a row each, null ids too; columns but doc_id
and text are passed over, whatever their names.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Recall, by_rows, documents, kept, marked_parts, with_marks

MARK, UNKNOWN = "▁", 10.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Normal pieces with scores of a SentencePiece file, read as a unigram vocabulary."""

    def __init__(self, model_file: str | None = None, pieces: dict[str, float] | None = None, byte_pieces: bool = True):
        if pieces is None:
            sp = sentencepiece.SentencePieceProcessor(model_file=model_file or default_model())
            special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
            pieces = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not special(i)}
            byte_pieces = any(sp.is_byte(i) for i in range(sp.get_piece_size()))
        self.pieces, self.byte_pieces = pieces, byte_pieces
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN
        self.automaton = ahocorasick.Automaton()
        for p, score in pieces.items():
            self.automaton.add_word(p, (len(p), score))
        self.automaton.make_automaton()
        inner = {c for p in pieces if len(p) > 1 for c in p}
        self.cut = re.compile(self._parts(inner)).findall

    def _parts(self, inner: set[str]) -> str:
        if any(MARK in p.lstrip(MARK) for p in self.pieces) or not self.byte_pieces:
            self.alone = ""
            return r"(?s).+"
        alone = self.alone = "".join(c for c in "\n\t\r" if c not in inner)
        return rf"[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else rf"{MARK}*[^{MARK}]+|{MARK}+"

    def count(self, part: str) -> int:
        """Pieces of the best path through ``part``, which has marks for blanks."""
        n = len(part)
        best, pieces, ends, fused = [0.0] + [None] * n, [0] * (n + 1), [[] for _ in range(n + 1)], [False] * (n + 1)
        if n and part in self.pieces and n == 1:
            return 1
        if self.pieces:
            for end, (size, score) in self.automaton.iter(part):
                ends[end + 1].append((size, score))
        for j in range(1, n + 1):
            top, count, single, unk = None, 0, False, False
            for size, score in sorted(ends[j], reverse=True):  # longest, so leftmost start, first
                single = single or size == 1
                before = best[j - size]
                if before is not None and (top is None or before + score > top):
                    top, count = before + score, pieces[j - size] + 1
            if not single and (top is None or best[j - 1] + self.unknown > top):
                unk = True
                top = best[j - 1] + self.unknown
                count = pieces[j - 1] + (len(part[j - 1].encode()) if self.byte_pieces else 0 if fused[j - 1] else 1)
            best[j], pieces[j], fused[j] = top, count, unk
        return pieces[n]


class Counter:
    """text -> number of tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.counts = Recall(lambda part: vocabulary.count(with_marks(part, MARK)))

    def of(self, text: bytes | None) -> int:
        if not text:
            return 0
        return sum(map(self.counts.__getitem__, marked_parts(text, MARK, self.vocabulary.cut, self.vocabulary.alone)))


def token_counts(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every row, in one pass without a shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def make():
        counter = kept("token_counts", model_file, lambda: Counter(Vocabulary(model_file)))
        return lambda row: (row[0], counter.of(row[1]))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(by_rows(make, schema, keeps=True), "doc_id long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
