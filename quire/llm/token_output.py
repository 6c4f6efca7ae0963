"""Token-ID output: byte-level BPE ids in Re-Pair grammar segments.

Documents are range-partitioned and sorted by id; each task tokenises its part and closes a segment
once it holds ``SEGMENT`` ids (a document is never split).  A segment is compressed by Re-Pair: the
most frequent pairs of neighbouring symbols become new symbols again and again, until no pair occurs
twice.  Stored are the rules, the length of every rule's expansion and the remaining sequence of
32-bit symbols, so a slice is decoded by searching the running expansion lengths and expanding only
the symbols that cover it.  New symbols are numbered from the size of the tokenizer's vocabulary.

The files are Parquet, one row per segment, written through Spark's committer: a lost task leaves
nothing behind, and any store that Spark writes to will do.

Row: shard, segment int (ascending as the ids), first int (the number of the first rule), doc_ids,
sizes array<long> (in order; a size counts the end id), rounds array<int> (rules made in each round),
rules, lengths, symbols binary (little-endian: uint32 pairs, uint32, uint32).

The text is cut before every run of white space that follows other characters, where the
pre-tokeniser always ends a word; distinct parts are encoded once while a bounded memo holds them.

Defined cases: a null text is the empty text and yields the end id alone; null ids come first; rows
with equal ids keep one row each, in order of the texts' hashes, so reruns agree; texts are
encoded whole and never split, so a very long one makes a segment of its own length; columns but
doc_id and text are passed over, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import documents, shared_dir

SEGMENT = 1 << 21
#: occurrences that make a pair a rule, and bits of the slots that pairs are counted in
LEAST, SLOTS = 2, 21
NEVER = np.int32(2**31 - 1)
#: odd multipliers, one after the other, so that pairs that share a slot once rarely do again
_TURNS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Unicode White_Space, which the pre-tokeniser's \s means
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PARTS = re.compile(f"[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+")
#: white space other than blank and newline, or the sign used for cutting
_ODD = re.compile("[\\0" + _BLANK.replace("\t-\r ", "\t\x0b-\r") + "]").search
FORMAT = "shard int, segment int, first int, doc_ids array<long>, sizes array<long>, rounds array<int>, rules binary, lengths binary, symbols binary"
_ARROW = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("first", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("rounds", pa.list_(pa.int32())), ("rules", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary())])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """text -> ids as little-endian 32-bit bytes, equal to the library's ids of the whole text."""

    def __init__(self, tokenizer_file: str | None = None, bound: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(tokenizer_file or default_tokenizer())
        self.size = self.tokenizer.get_vocab_size()
        self.memo, self.bound, self.passed = {}, bound, 0
        # a lone added token, which the library cuts out of any text, may stand between parts
        added = list(self.tokenizer.get_added_tokens_decoder().items())
        plain = len(added) == 1 and self.tokenizer.normalizer is None and not (added[0][1].lstrip or added[0][1].rstrip or added[0][1].single_word)
        sign = added[0][1].content if plain else ""
        self.sign, self.sign_id = ("", 0) if any(sign.endswith(sign[:n]) for n in range(1, len(sign))) else (sign, added[0][0] if plain else 0)

    def _encode(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of each part; parts without the added token are one text with it between them, which saves the cost of a call for each."""
        if self.sign and len(parts) > 1 and not any(self.sign in p for p in parts):
            ids = np.array(self.tokenizer.encode(self.sign.join(parts), add_special_tokens=False).ids, np.uint32)
            ends = (4 * np.flatnonzero(ids == self.sign_id)).tolist()
            if len(ends) == len(parts) - 1:
                raw = ids.tobytes()
                return {p: raw[i:j] for p, i, j in zip(parts, [0, *(e + 4 for e in ends)], [*ends, len(raw)], strict=True)}
        return {p: array("I", e.ids).tobytes() for p, e in zip(parts, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False), strict=True)}

    def _learn(self, parts: set[str]) -> dict[str, bytes]:
        """Ids of parts that the memo lacks; it takes them in while there is room, and starts anew when most pass it by."""
        new, found = list(parts), {}
        for at in range(0, len(new), 512):
            found |= self._encode(new[at : at + 512])
        if len(self.memo) + len(found) <= self.bound:
            self.memo |= found
        else:
            self.passed += len(found)
            if self.passed > 8 * self.bound:
                self.memo, self.passed = {}, 0
        return found

    @staticmethod
    def parts(text: str) -> list[str]:
        # plain splitting is enough where single blanks and single newlines are the only white space
        if text and not _ODD(text) and text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in ("  ", "\n\n", " \n", "\n ")):
            return text.replace("\n", " \n").replace(" ", "\0 ").replace(" \n", "\n").split("\0")
        return _PARTS.findall(text)

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        rows = [self.parts(t.decode("utf-8", "replace")) if t else [] for t in texts]
        got = [list(map(self.memo.get, row)) for row in rows]
        missing = {p for row, ids in zip(rows, got, strict=True) if None in ids for p, i in zip(row, ids, strict=True) if i is None}
        if missing:
            found = self._learn(missing)
            got = [[found[p] if i is None else i for p, i in zip(row, ids, strict=True)] if None in ids else ids for row, ids in zip(rows, got, strict=True)]
        return list(map(b"".join, got))


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(tokenizer_file: str | None) -> Encoder:
    """The process's encoder: a Python worker keeps its memo from task to task."""
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = Encoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


def compress(ids: np.ndarray, first: int, least: int = LEAST) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of ``ids`` below ``first``: (rules of each round, rules as pairs, expansion lengths, symbols).

    A round takes the pairs that occur ``level`` times and replaces them, the more frequent first where
    they overlap and every other one in a run of equal symbols.  The level is first half of the most
    frequent pair's count and is halved when a round replaces little, down to ``least``; rounds go on
    until no pair occurs that often.  New pairs hold a new symbol, so a pair's count only falls: places
    are looked at when their pair is new or its last count reaches the level.  Pairs are counted in
    hashed slots; of pairs that share a slot one is counted and the others wait for the next round's hash.
    """
    n = len(ids)
    seq = np.append(ids.astype(np.uint32), np.uint32(0))
    nxt, prv = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    alive = np.ones(n + 1, bool)
    rank = np.full(n + 2, NEVER, np.int32)  # also read at -1, the place before the first
    # at most so often occurs the pair that begins here; 0 where none begins
    bound = np.zeros(n + 1, np.int32)
    bound[: max(n - 1, 0)] = NEVER
    rules, made, lengths, new, turn, level = [], [], [np.ones(0, np.uint32)], first, 0, NEVER
    size_of = lambda s: np.where(s < first, 1, np.concatenate(lengths)[np.maximum(s.astype(np.int64) - first, 0)] if new > first else 1)
    while True:
        at = np.flatnonzero(bound >= level)
        if not len(at):
            if level <= least:
                break
            level = max(least, min(int(bound.max()), level // 2))
            continue
        key = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[nxt[at]]
        bits = min(SLOTS, max(8, int(2 * len(at)).bit_length()))
        slot = ((key * _TURNS[turn % len(_TURNS)]) >> np.uint64(64 - bits)).astype(np.int32)
        turn += 1
        pair = np.zeros(1 << bits, np.uint64)
        pair[slot] = key
        own = pair[slot] == key
        count = np.bincount(slot[own], minlength=1 << bits)
        bound[at[own]] = count[slot[own]]
        if level == NEVER:
            level = max(least, int(count.max()) // 2)
        some = np.flatnonzero(count >= level)
        if not len(some):
            continue
        some = some[np.lexsort((pair[some], -count[some]))]
        rank_of = np.full(1 << bits, NEVER, np.int32)
        rank_of[some] = np.arange(len(some), dtype=np.int32)
        here = rank_of[slot]
        here[~own] = NEVER
        picked = here < NEVER
        at, here = at[picked], here[picked]
        # runs of equal pairs overlap themselves: every other one stays
        start = np.ones(len(at), bool)
        start[1:] = (nxt[at[:-1]] != at[1:]) | (here[1:] != here[:-1])
        place = np.arange(len(at), dtype=np.int32)
        even = ((place - np.maximum.accumulate(np.where(start, place, 0))) & 1) == 0
        at, here = at[even], here[even]
        rank[at] = here
        best = (here < rank[prv[at]]) & (here < rank[nxt[at]])
        rank[at] = NEVER
        at, here = at[best], here[best]
        if 16 * len(at) < len(key):
            level = max(least, level // 2)
        used = np.unique(here)
        chosen = pair[some[used]]
        left, right = (chosen >> np.uint64(32)).astype(np.uint32), chosen.astype(np.uint32)
        lengths.append((size_of(left) + size_of(right)).astype(np.uint32))
        gone = nxt[at]
        after = nxt[gone]
        seq[at] = (new + np.searchsorted(used, here)).astype(np.uint32)
        nxt[at], prv[after] = after, at
        alive[gone], bound[gone] = False, 0
        bound[at] = np.where(after < n, NEVER, 0)
        before = prv[at]
        bound[before[before >= 0]] = NEVER
        rules.append(np.stack([left, right], 1))
        made.append(len(used))
        new += len(used)
    alive[n] = False
    pairs = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return made, pairs, np.concatenate(lengths), seq[alive]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers ``start`` to ``start + size`` of each, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Segment:
    """A compressed segment, decoded from any place: expansion lengths find the symbols, rules give their ids."""

    def __init__(self, first: int, made: list[int], pairs: np.ndarray, lengths: np.ndarray, symbols: np.ndarray):
        self.first, self.symbols = first, symbols.astype(np.int64)
        sizes = lengths.astype(np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.flat, self.sizes = np.zeros(int(sizes.sum()), np.uint32), sizes
        at = 0
        for n in made:  # rules of a round are made of ids and of earlier rounds' rules
            rules = pairs[at : at + n].astype(np.int64)
            if n:
                self.flat[self.starts[at] : self.starts[at] + int(sizes[at : at + n].sum())] = self.ids(rules.ravel())
            at += n
        self.ends = np.cumsum(self.size_of(self.symbols))

    def size_of(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols >= self.first
        out = np.ones(len(symbols), np.int64)
        out[rule] = self.sizes[symbols[rule] - self.first]
        return out

    def ids(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols >= self.first
        sizes = self.size_of(symbols)
        out = np.repeat(symbols, sizes).astype(np.uint32)
        of = symbols[rule] - self.first
        out[np.repeat(rule, sizes)] = self.flat[_spread(self.starts[of], self.sizes[of])]
        return out

    def slice(self, start: int, size: int) -> np.ndarray:
        """Ids ``start`` to ``start + size``, from the symbols that cover them alone."""
        lo, hi = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, start + size, "left")
        skip = start - (int(self.ends[lo - 1]) if lo else 0)
        return self.ids(self.symbols[lo : hi + 1])[skip : skip + size]


def _encode(tokenizer_file: str | None, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, number = encoder(tokenizer_file), TaskContext.get().partitionId(), 0
        ids, docs, sizes, total = [], [], [], 0

        def close() -> pa.RecordBatch:
            made, pairs, lengths, symbols = compress(np.frombuffer(b"".join(ids), np.uint32), encode.size)
            row = [shard, number, encode.size, docs, sizes, made, pairs.tobytes(), lengths.tobytes(), symbols.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _ARROW.types, strict=True)], schema=_ARROW)

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                for doc, got in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    ids += (got, b"\0\0\0\0")
                    docs.append(doc)
                    sizes.append(len(got) // 4 + 1)
                    total += sizes[-1]
                    if total >= segment:
                        yield close()
                        ids, docs, sizes, total, number = [], [], [], 0, number + 1
        if docs:
            yield close()

    return run


def write(docs: DataFrame, path: str, tokenizer_file: str | None = None, segment: int = SEGMENT) -> None:
    """Write the ids of every text, each with the end id 0, to ``path`` in ascending order of doc_id."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), F.octet_length("text"))
    rows.mapInArrow(_encode(tokenizer_file, segment), FORMAT).write.parquet(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda b, kind: np.frombuffer(b, kind)
    for batch in batches:
        for at in range(batch.num_rows):  # a segment at a time
            r = {name: batch.column(name)[at] for name in batch.schema.names}
            raw = lambda name: number(r[name].as_buffer(), np.uint32)  # noqa: E731, B023
            segment = Segment(r["first"].as_py(), r["rounds"].as_py(), raw("rules").reshape(-1, 2), raw("lengths"), raw("symbols"))
            sizes = r["sizes"].values.to_numpy()
            starts = np.cumsum(sizes) - sizes
            crc = [zlib.crc32(segment.slice(a, n).astype("<u4")) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
            n = len(crc)
            yield pa.RecordBatch.from_arrays([pa.array([r["shard"].as_py()] * n, pa.int32()), pa.array([r["segment"].as_py()] * n, pa.int32()), r["doc_ids"].values, pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], names=["shard", "segment", "doc_id", "local_start", "n_tokens", "ids_crc32"])


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files."""
    files = spark.read.schema(FORMAT).parquet(path)
    sizes = files.select("shard", "segment", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("shard_start"))  # a row per shard
    inner = F.sum("n").over(W.partitionBy("shard").orderBy("segment")) - F.col("n")
    offsets = sizes.withColumn("inner", inner).join(shards, "shard").select("shard", "segment", (F.col("inner") + F.col("shard_start")).alias("offset"))
    rows = files.mapInArrow(_digest, "shard int, segment int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(offsets, ["shard", "segment"]).select("doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write(documents(spark, sf_dir), path)
    return read_digest(spark, path)
