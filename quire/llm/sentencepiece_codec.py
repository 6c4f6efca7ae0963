"""SentencePiece encoding and decoding over a relational lattice.

Blanks of a text become the word mark and one is put in front; the text is cut into words before the
marks and around characters that are in no longer piece (no piece spans such a cut).  A word's lattice
is a relation: its substrings up to the length of the longest piece, equi-joined to the piece table,
and grouped by word.  Higher-order ``aggregate`` folds the group to piece ids:

* a unigram model by Viterbi (``fold_viterbi``): best score and back pointer per place; of equal
  scores the leftmost start wins, and an unknown edge stands where no one-character piece does;
* a BPE model by merge order (``fold_merges``): Viterbi over its scores, which are ranks, does not
  give the model's segmentation, so the fold takes the edge of the best rank that joins two present
  neighbours, the leftmost of equals, until none does.  Places still present are a bit mask.

``encode`` resolves the ``known_words`` most frequent words of the corpus this way (a dictionary that
is broadcast, some MB, and stays in every worker); rarer words run the same merge or Viterbi fold
inside the task that meets them.  Both paths are exact, so the split changes no id.  It is there
because a join of all words back to their texts would shuffle every text and word once more.  Words
longer than 60 characters, whose places do not fit the fold's mask, always take the second path.

Defined cases: null and empty texts have no ids; texts are encoded whole, however long; repeated rows
and ids have a row each, null ids too; columns but doc_id and text are passed over, whatever their names; bytes that are no UTF-8 count as U+FFFD; characters
without a piece become their UTF-8 byte pieces, or the unknown id where the model has none.  Decoding
restores every text except that a word mark of the text itself comes back as a blank.
"""

from __future__ import annotations

import heapq
import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Recall, by_rows, documents, kept, marked_parts, most_frequent, stored, with_marks

MARK = "▁"
KNOWN_WORDS = 1 << 18
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"  # of one byte each
LONGEST = 60  # characters of a word whose places fit a 64-bit mask


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The piece table of a model: text -> (id, score), byte pieces, and where texts may be cut."""

    def __init__(self, model_file: str | None = None, table: dict[str, tuple[int, float]] | None = None, unknown_id: int = 0, byte_ids: list[int] | None = None, kind: str = "bpe"):
        if table is None:
            sp = sentencepiece.SentencePieceProcessor(model_file=model_file or default_model())
            n = sp.get_piece_size()
            special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
            table = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(n) if not special(i)}
            byte_ids, unknown_id = [i for i in range(n) if sp.is_byte(i)] or None, sp.unk_id()
        self.table, self.unknown_id, self.byte_ids, self.kind = table, unknown_id, byte_ids, kind
        self.cost = {p: -score for p, (_, score) in table.items()}
        self.longest = max(map(len, table), default=1)
        self.least = min((s for _, s in table.values()), default=0.0)
        inner = {c for p in table if len(p) > 1 for c in p}
        self.alone = "".join(c for c in "\n\t\r" if c not in inner)
        #: characters that stand side by side in a piece; between others no merge reaches
        self.pairs = {p[i : i + 2] for p in table for i in range(len(p) - 1)}
        alone = "".join(f"\\x{ord(c):02x}" for c in self.alone)
        if any(MARK in p.lstrip(MARK) for p in table):
            self.pattern, self.alone = r"(?s).+", ""
        else:
            self.pattern = rf"[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else rf"{MARK}*[^{MARK}]+|{MARK}+"

    def of_character(self, c: str) -> list[int]:
        known = self.table.get(c)
        return [known[0]] if known else [self.byte_ids[b] for b in c.encode()] if self.byte_ids else [self.unknown_id]

    def merged(self, word: str) -> list[int]:
        """Ids by merge order: a heap of the joins of present neighbours."""
        n, table = len(word), self.table
        nxt, prev, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []
        end = nxt[:]  # of the symbol that starts here; 0 once it is part of another

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (known := table.get(word[i : end[j]])):
                heapq.heappush(heap, (-known[1], i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, e = heapq.heappop(heap)
            if end[i] != j or end[j] != e:
                continue
            end[i], end[j], nxt[i] = e, 0, e
            if e < n:
                prev[e] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        out, i = [], 0
        while i < n:
            piece = word[i : end[i]]
            known = table.get(piece)
            out += [known[0]] if known else self.of_character(piece)
            i = end[i]
        return out

    def viterbi(self, word: str) -> list[int]:
        n, table = len(word), self.table
        best, back = [0.0] + [None] * n, [0] * (n + 1)
        for i in range(n):
            single = False
            for j in range(i + 1, min(n, i + self.longest) + 1):
                known = table.get(word[i:j])
                if known:
                    single = single or j == i + 1
                    if best[j] is None or best[i] + known[1] > best[j]:
                        best[j], back[j] = best[i] + known[1], i
            if not single and (best[i + 1] is None or best[i] + self.least - 10 > best[i + 1]):
                best[i + 1], back[i + 1] = best[i] + self.least - 10, i
        cuts, j = [], n
        while j:
            cuts.append((back[j], j))
            j = back[j]
        out = []
        for i, j in reversed(cuts):
            known = table.get(word[i:j])
            out += [known[0]] if known else self.of_character(word[i:j])
        return out

    def merged_short(self, word: str) -> list[int]:
        """``merged`` for short words: the costs of all joins in a list, its least leftmost taken in turn."""
        parts, cost, never = list(word), self.cost.get, float("inf")
        joins = [cost(a + b, never) for a, b in zip(parts, parts[1:])]
        while joins:
            least = min(joins)
            if least == never:
                break
            i = joins.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joins[i]
            if i:
                joins[i - 1] = cost(parts[i - 1] + parts[i], never)
            if i < len(joins):
                joins[i] = cost(parts[i] + parts[i + 1], never)
        out = []
        for p in parts:
            known = self.table.get(p)
            out += (known[0],) if known else self.of_character(p)
        return out

    def ids(self, word: str) -> list[int]:
        if self.kind == "bpe" and len(word) <= LONGEST:
            return self.merged_short(word)
        return self.viterbi(word) if self.kind == "unigram" else self.merged(word)

    def decode(self, ids) -> bytes:
        if not hasattr(self, "_bytes"):
            self._bytes = {i: p.replace(MARK, " ").encode() for p, (i, _) in self.table.items()}
            self._bytes |= {i: bytes([b]) for b, i in enumerate(self.byte_ids or [])} | {self.unknown_id: " ⁇ ".encode()}
        text = b"".join(map(self._bytes.__getitem__, ids))
        return text[1:] if text[:1] == b" " else text


def words(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """Every word of every text, as column ``word``."""
    marked = F.concat(F.lit(MARK), F.replace(F.col("text"), F.lit(" "), F.lit(MARK)))
    parts = F.replace(marked, F.lit(MARK), F.lit("\0" + MARK))
    for c in pieces.alone:
        parts = F.replace(parts, F.lit(c), F.lit(f"\0{c}\0"))
    return docs.filter(F.octet_length("text") > 0).select(F.explode(F.split(parts, "\0")).alias("word")).filter("word != ''")


def lattice(known: DataFrame, pieces: Pieces) -> DataFrame:
    """``known`` (distinct ``word``) with its edges: an array of (rank order, start, end, id, score).

    The substrings of a word are rows; the piece table, whose size the model fixes, is joined to them.
    """
    spark = known.sparkSession
    table = spark.createDataFrame([(p, i, float(s)) for p, (i, s) in pieces.table.items()], "piece string, id int, score double")
    n = F.char_length("word")
    starts = known.select("word", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    spans = starts.select("word", "start", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("n"), F.col("start") + pieces.longest))).alias("end"))
    edges = spans.withColumn("piece", F.col("word").substr(F.col("start") + 1, F.col("end") - F.col("start"))).join(F.broadcast(table), "piece", "left").filter("id is not null or end = start + 1")
    return edges.groupBy("word").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("cost"), "start", "end", "id"))).alias("edges"))


def fold_merges(edges: Column, n: Column) -> Column:
    """The mask of places where pieces start (bit ``start``; bit ``n`` is the end) after all merges."""
    joins = F.transform(
        F.filter(edges, lambda e: e["id"].isNotNull() & (e["end"] > e["start"] + 1)),
        lambda e: F.struct(
            (F.call_function("shiftleft", F.lit(1).cast("long"), e["start"]).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), e["end"]))).alias("ends"),
            (F.call_function("shiftleft", F.lit(1).cast("long"), e["end"]) - F.call_function("shiftleft", F.lit(2).cast("long"), e["start"])).alias("inner"),
        ),
    )
    every = F.call_function("shiftleft", F.lit(2).cast("long"), n) - 1

    def step(mask: Column, _: Column) -> Column:
        fits = F.filter(joins, lambda j: (mask.bitwiseAND(j["ends"]) == j["ends"]) & (F.bit_count(mask.bitwiseAND(j["inner"])) == 1))
        return F.when(F.size(fits) == 0, mask).otherwise(mask.bitwiseAND(F.bitwise_not(F.get(fits, F.lit(0))["inner"])))

    return F.when(F.size(joins) == 0, every).otherwise(F.aggregate(F.sequence(F.lit(1), n), every, step))


def fold_viterbi(edges: Column, n: Column, unknown: float) -> Column:
    """The mask of places where pieces of the best path start (bit ``n`` is the end)."""
    one = F.lit(1).cast("long")

    def step(state: Column, end: Column) -> Column:
        def better(best: Column, e: Column) -> Column:
            before = F.get(state, e["start"])
            cost = before["cost"] + F.coalesce(e["cost"], F.lit(-unknown))
            new = F.struct(cost.alias("cost"), before["mask"].bitwiseOR(F.call_function("shiftleft", one, end)).alias("mask"))
            return F.when(best["cost"].isNull() | (cost < best["cost"]), new).otherwise(best)

        here = F.array_sort(F.transform(F.filter(edges, lambda e: e["end"] == end), lambda e: F.struct(e["start"].alias("start"), e["cost"].alias("cost"))))
        nothing = F.struct(F.lit(None).cast("double").alias("cost"), F.lit(0).cast("long").alias("mask"))
        return F.concat(state, F.array(F.aggregate(here, nothing, better)))

    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(1).cast("long").alias("mask")))
    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: F.get(s, n)["mask"])


def segmented(known: DataFrame, pieces: Pieces) -> DataFrame:
    """word and the mask of its pieces, for words of at most ``LONGEST`` characters."""
    found = lattice(known, pieces)
    n = F.char_length("word")
    mask = fold_viterbi(F.col("edges"), n, pieces.least - 10) if pieces.kind == "unigram" else fold_merges(F.col("edges"), n)
    return found.select("word", mask.alias("mask"))


def dictionary(docs: DataFrame, pieces: Pieces, known_words: int) -> dict[str, bytes]:
    """Ids (32-bit, little-endian) of the most frequent words by the relational lattice."""
    counts = words(docs, pieces).filter(F.char_length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n"))
    top = stored(most_frequent(stored(counts), known_words).select("word"))
    spread = top.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")  # a number, so that the folds are not put in one task
    got = segmented(spread, pieces).toArrow()
    found = {}
    for word, mask in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
        cuts = [i for i in range(len(word) + 1) if mask >> i & 1]
        ids = []
        for i, j in zip(cuts, cuts[1:]):
            known = pieces.table.get(word[i:j])
            ids += [known[0]] if known else pieces.of_character(word[i:j])
        found[word] = array("i", ids).tobytes()
    return found


class Encoder:
    """text -> ids (32-bit, little-endian): the dictionary's words, and others by the fold in this process."""

    def __init__(self, pieces: Pieces, known: dict[str, bytes], bound: int = 300_000):
        self.pieces = pieces
        self.words = Recall(self._rare, len(known) + bound // 2)
        self.words.known = {word.replace(MARK, " ").encode(): ids for word, ids in known.items()}
        self.words.update(self.words.known)
        self.cut = re.compile(pieces.pattern).findall

    def _rare(self, part: bytes) -> bytes:
        """Ids of a part that is not known; signs at its end that nothing merges with are encoded on their own, as what is before them is often known."""
        word = with_marks(part, MARK)
        n = len(word.rstrip(SIGNS))
        if 0 < n < len(word) and self.pieces.kind == "bpe" and word[n - 1 : n + 1] not in self.pieces.pairs:
            at = len(part) - (len(word) - n)
            return self.words[part[:at]] + self.words[part[at:]]
        return array("i", self.pieces.ids(word)).tobytes()

    def of(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.words.__getitem__, marked_parts(text, MARK, self.cut, self.pieces.alone)))


def _with_ids(docs: DataFrame, model_file: str | None, known_words: int, schema: pa.Schema, kinds: str, result) -> DataFrame:
    """``result(doc_id, text, ids, pieces)`` of every row."""
    pieces = Pieces(model_file)
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(docs, pieces, known_words))  # known_words entries

    run = uuid.uuid4().hex

    def make():
        encoder = kept("sentencepiece", (model_file, run), lambda: Encoder(Pieces(model_file), shared.value))
        own = encoder.pieces
        return lambda row: result(row[0], row[1], np.frombuffer(encoder.of(row[1]), np.int32), own)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(by_rows(make, schema, keeps=True), kinds)


def encode(docs: DataFrame, model_file: str | None = None, known_words: int = KNOWN_WORDS) -> DataFrame:
    """doc_id and ids (array<int>) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return _with_ids(docs, model_file, known_words, schema, "doc_id long, ids array<int>", lambda doc, text, ids, own: (doc, ids))


def decode(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def make():
        own = Pieces(model_file)
        return lambda row: (row[0], own.decode(row[1] or []).decode("utf-8", "replace"))

    return encoded.select("doc_id", "ids").mapInArrow(by_rows(make, schema), "doc_id long, text string")


def digest(docs: DataFrame, model_file: str | None = None, known_words: int = KNOWN_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian 32-bit ids), round_trip (decoding gives the text back)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])
    result = lambda doc, text, ids, own: (doc, len(ids), zlib.crc32(ids.tobytes()), own.decode(ids.tolist()) == (text or b""))
    return _with_ids(docs, model_file, known_words, schema, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean", result)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
