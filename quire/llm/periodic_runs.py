"""Periodic runs of words, found on a grammar of the word ids.

A run is a maximal stretch of words with smallest period q (words q apart are equal) that is at least
``LEAST`` words and 2q long.  In a run at least ``LEAST / 2`` words in a row equal those q further on,
so all its words are in windows of that many words that the text repeats.  Tasks take some million
words of documents at a time, keep the stretches that such windows cover (no run leaves its stretch)
and compress them together by Re-Pair into one grammar.

Every square (two equal halves side by side) of a stretch crosses the boundary between the two
children of one node of its derivation, and lies in that node.  The periodic intervals that cross a
rule's boundary are found once, on one of its places: a period is the distance of the boundary's first
word to another of its places, so only these are tried, and each is extended both ways.  A rule's
intervals and, moved, those of its two sides go on to all rules that use it and to all places where it
stands; the symbols that Re-Pair leaves are the leaves of a balanced tree whose nodes are treated the
same way.  Intervals of one period that share at least a period are merged, which gives the maximal
ones; of those the long enough whose period is the smallest are the runs.

``collapse`` drops what a run repeats: words after its first q words.

Defined cases: null and empty texts, and those without words, have no runs and collapse to the empty
text; texts are searched whole, however long; runs of different periods may overlap, and each counts;
repeated rows, repeated and null ids have a row each; words are compared as bytes; columns but doc_id
and text are passed over, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import WORD, documents, scramble
from quire.llm.token_output import compress

#: words of the shortest run, and words that a task searches together
LEAST, TOGETHER = 12, 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
RUNS = "array<struct<start:long,length:long,period:long>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

Interval = tuple[int, int, int]  # start, end, period


def repeated_stretches(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, document) of the maximal stretches that are covered by windows which their document repeats."""
    k, n = LEAST // 2, len(codes)
    nothing = np.zeros(0, np.int64)
    if n < k:
        return nothing, nothing, nothing
    of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    at = np.flatnonzero(of[: n - k + 1] == of[k - 1 :])
    key = of[at].astype(np.uint64) * _ODD
    for j in range(k):
        key += scramble(codes[at + j].astype(np.uint64) * np.uint64(2 * k) + np.uint64(j))
    order = np.argsort(key)
    same = np.diff(key[order]) == 0
    twice = at[order[np.append(same, False) | np.append(False, same)]]
    step = np.bincount(twice, minlength=n + 1) - np.bincount(twice + k, minlength=n + 1)
    covered = np.cumsum(step)[:n] > 0
    first = np.flatnonzero(covered & ~(np.append(False, covered[:-1]) & (np.append(-1, of[:-1]) == of)))
    last = np.flatnonzero(covered & ~(np.append(covered[1:], False) & (np.append(of[1:], -1) == of)))
    return first, last + 1, of[first]


class Words:
    """A sequence of word numbers, and how far it agrees with itself."""

    def __init__(self, numbers: np.ndarray):
        self.array, self.list = numbers, numbers.tolist()

    def after(self, i: int, j: int, end: int) -> int:
        """Words from ``i`` on that equal those from ``j`` > ``i`` on, up to ``end``."""
        w, k = self.list, 0
        while j + k < end and w[i + k] == w[j + k]:
            k += 1
            if k == 16:
                return k + self._far(i + k, j + k, end - j - k, 1)
        return k

    def before(self, i: int, j: int, start: int) -> int:
        """Words that end before ``i`` and equal those that end before ``j`` > ``i``, down to ``start``."""
        w, k = self.list, 0
        while i - k > start and w[i - k - 1] == w[j - k - 1]:
            k += 1
            if k == 16:
                return k + self._far(i - k, j - k, i - k - start, -1)
        return k

    def _far(self, i: int, j: int, most: int, way: int) -> int:
        k, size, a = 0, 64, self.array
        while k < most:
            n = min(size, most - k)
            x, y = (a[p + k : p + k + n] if way > 0 else a[p - k - n : p - k] for p in (i, j))
            other = np.flatnonzero(x != y)
            if len(other):
                return k + (int(other[0]) if way > 0 else n - 1 - int(other[-1]))
            k, size = k + n, 4 * size
        return k

    def crossing(self, start: int, cut: int, end: int) -> list[Interval]:
        """Periodic intervals within ``start`` to ``end`` that hold a square and words on both sides of ``cut``.

        Of a square that crosses the cut, the word at the cut or the one a period before it equals the
        one a period on.  Periods that are multiples of a smaller one of the same place are left out.
        """
        w, half = self.list, (end - start) // 2
        word = w[cut]
        tried, i = [], cut
        for lo, hi in ((max(start, cut - half), cut), (cut + 1, min(end, cut + half + 1))):
            i = lo
            while i < hi:
                try:
                    i = w.index(word, i, hi)
                except ValueError:
                    break
                tried.append((abs(i - cut), min(i, cut), max(i, cut)))
                i += 1
        found: list[Interval] = []
        for q, i, j in sorted(tried):
            if any(q % p == 0 and a <= i and j < b for a, b, p in found):
                continue
            right = self.after(i, j, end)
            left = self.before(i, j, start)
            if left + right >= q and i - left < cut:
                found.append((i - left, j + right, q))
        return found


def merged(found: list[Interval]) -> list[Interval]:
    """Intervals of one period that share at least a period become one."""
    by_period: dict[int, list[list[int]]] = {}
    for a, b, q in sorted(found):
        known = by_period.setdefault(q, [])
        if known and a + q <= known[-1][1]:
            known[-1][1] = max(known[-1][1], b)
        else:
            known.append([a, b])
    return [(a, b, q) for q, known in by_period.items() for a, b in known]


def runs_of(found: list[Interval]) -> list[Interval]:
    """Of maximal intervals those that are runs, by start and period."""
    by_period: dict[int, list[tuple[int, int]]] = {}
    for a, b, q in merged(found):
        if b - a >= max(LEAST, 2 * q):
            by_period.setdefault(q, []).append((a, b))  # in order; both starts and ends grow
    out = []
    for q, own in by_period.items():
        smaller = [known for p, known in by_period.items() if p < q and q % p == 0]
        for a, b in own:
            within = (known[i - 1] for known in smaller if (i := bisect_right(known, (a, float("inf")))))
            if not any(d >= b for _, d in within):
                out.append((a, b, q))
    return sorted(out)


def runs_in_stretches(stretches: list[np.ndarray]) -> list[list[Interval]]:
    """The runs of each stretch of word numbers, by the grammar of all stretches."""
    if not stretches:
        return []
    sizes = np.array([len(s) for s in stretches])
    # numbers in no order of the text's, or words that come in ascending order would make rules of two symbols' growth
    _, numbers = np.unique(scramble(np.concatenate(stretches).astype(np.uint64)), return_inverse=True)
    known, z = int(numbers.max()) + 1, len(stretches)
    whole = np.insert(numbers.astype(np.int64), np.cumsum(sizes), known + np.arange(z))  # a number of its own ends each stretch
    first = known + z
    _, pairs, lengths, symbols = compress(whole.astype(np.uint32), first)
    words, lengths = Words(whole), lengths.astype(np.int64)
    size = np.where(symbols < first, 1, lengths[np.maximum(symbols.astype(np.int64) - first, 0)]) if len(lengths) else np.ones(len(symbols), np.int64)
    starts = np.cumsum(size) - size
    # one place of every rule
    place = np.zeros(len(pairs), np.int64)
    is_rule = symbols >= first
    place[symbols[is_rule].astype(np.int64) - first] = starts[is_rule]
    place, rules, long = place.tolist(), pairs.astype(np.int64).tolist(), lengths.tolist()
    size_of = lambda s: 1 if s < first else long[s - first]
    for x in range(len(rules) - 1, -1, -1):
        left, right = rules[x]
        if left >= first:
            place[left - first] = place[x]
        if right >= first:
            place[right - first] = place[x] + size_of(left)
    inside: dict[int, list[Interval]] = {}
    for x, (left, right) in enumerate(rules):
        at, n = place[x], size_of(left)
        own = [(a - at, b - at, q) for a, b, q in words.crossing(at, at + n, at + long[x])]
        own += list(inside.get(left, ())) + [(a + n, b + n, q) for a, b, q in inside.get(right, ())] if left in inside or right in inside else []
        if own:
            inside[first + x] = merged(own)
    out, place_of = [], np.append(starts, len(whole)).tolist()
    closed = np.flatnonzero((symbols >= known) & ~is_rule).tolist()
    symbols, base, at = symbols.tolist(), 0, 0
    for stop, n in zip(closed, sizes.tolist(), strict=True):
        found = [(place_of[i] + a, place_of[i] + b, q) for i in range(at, stop) if symbols[i] in inside for a, b, q in inside[symbols[i]]]
        todo = [(at, stop)]
        while todo:  # the balanced tree over what is left
            lo, hi = todo.pop()
            if hi - lo > 1:
                mid = (lo + hi) // 2
                found += words.crossing(place_of[lo], place_of[mid], place_of[hi])
                todo += [(lo, mid), (mid, hi)]
        out.append([(a - base, b - base, q) for a, b, q in runs_of(found)])
        base, at = base + n + 1, stop + 1
    return out


def runs(texts: list[bytes | None]) -> list[tuple[list[Interval], list[bytes]]]:
    """Runs (start, end, period) and words of each text."""
    words = [(t or b"").split() for t in texts]
    ends = np.cumsum([len(w) for w in words])
    codes = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode().indices.to_numpy()
    first, end, of = repeated_stretches(codes, ends)
    starts = np.concatenate([[0], ends])
    found: list[list[Interval]] = [[] for _ in words]
    for a, doc, own in zip(first.tolist(), of.tolist(), runs_in_stretches([codes[a:b] for a, b in zip(first, end)]), strict=True):
        shift = a - int(starts[doc])
        found[doc] += [(s + shift, e + shift, q) for s, e, q in own]
    return list(zip(found, words, strict=True))


def collapsed(words: list[bytes], found: list[Interval]) -> bytes:
    """The words that no run repeats, with a blank between."""
    if found:
        stays = np.ones(len(words), bool)
        for a, b, q in found:
            stays[a + q : b] = False
        words = [words[i] for i in np.flatnonzero(stays).tolist()]
    return b" ".join(words)


def _together(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list]]:
    """Ids and texts of a batch, as many rows at a time as hold some million words."""
    at, texts = 0, batch.column(1)
    while at < batch.num_rows:
        n, room = 0, 6 * TOGETHER  # bytes
        while at + n < batch.num_rows and (room > 0 or not n):
            room -= len(texts[at + n].as_buffer() or b"") if texts[at + n].is_valid else 0
            n += 1
        yield batch.column(0).slice(at, n), texts.slice(at, n).to_pylist()
        at += n


def collapse(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start and length in words, period; by start and period) and text without what they repeat, of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("runs", _RUNS), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _together(batch):
                got = runs(texts)
                listed = pa.array([[{"start": a, "length": b - a, "period": q} for a, b, q in found] for found, _ in got], _RUNS)
                yield pa.RecordBatch.from_arrays([ids, listed, pa.array([collapsed(words, found) for found, words in got], pa.binary())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, f"doc_id long, runs {RUNS}, text binary").withColumn("text", F.col("text").cast("string"))


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or, where ten divides the id's crc32, its words with everything from one place on periodic."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def periodic(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        times = F.ceil((n - a) / p).cast("int")
        unit = F.slice(w, (a + 1).cast("int"), p.cast("int"))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), (n - a).cast("int"))), " ")

    cut = F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))  # in an array, so that the words are cut out once
    return F.when(h % 10 == 0, F.coalesce(F.get(F.transform(cut, lambda w: F.when(F.size(w) > 0, periodic(w))), F.lit(0)), text)).otherwise(text)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256 of every row."""
    rows = collapse(docs)
    one = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("short"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), one.alias("one"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"))
    length = -F.col("one.short")
    longest = [F.col("one.start").alias("start"), length.alias("length"), F.col("one.period").alias("period"), F.floor(1000 * length / F.col("one.period")).alias("exponent_milli")]
    return rows.select("doc_id", "n_runs", *longest, "runs_sha256", "collapsed_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return digest(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
