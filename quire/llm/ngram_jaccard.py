"""N-gram Jaccard join: prefixes of word shingles, with token combinations for frequent classes.

A document is the set of its five-word shingles; two link when 100 * intersection >= 80 * union.
Equal sets are one representative (the least id) before anything else.

Tokens have one global order: those not known as frequent by hash, then the frequent ones, rarer
first.  Of ``n`` tokens ``o = ceil(0.8 n)`` at least are shared with any partner, so linked sets share
``l`` tokens within their first ``n - o + l``.

* A set is indexed under each rare token of its 1-prefix.  If its rare tokens fill that prefix, its
  partners share one of them, and nothing more is needed.
* Otherwise a partner shares a rare token or, in the prefix extended to ``l = m + 1``, at least
  ``m + 1`` frequent ones.  These are dealt to ``m`` classes by hash, so some class holds two of them:
  the set is indexed under the pairs of frequent tokens of one class.  With ``m`` in proportion to
  the size, a set has pairs in proportion to its size too, whatever that is.  ``m`` goes by powers of
  two of the smaller partner's size; a set has the pairs of each power that its smaller partners,
  itself included, may have.

Frequent are the (at most 2**18) tokens with the greatest counts that blocks of the corpus report: a
block (a task's next few million tokens, equal sets once) reports all it has seen twice or more.  The
list only moves tokens to the end of the order; any list gives the same links.

Candidates are checked in two rounds, each exact on whole sets.  A parity sketch of each set, about
one bit per token, comes first: sketches differ in at most as many bits as the sets in tokens, so a
pair whose sketches differ too much cannot link, and whole sets are only fetched for the rest.  First every indexed set meets the
least one of its bucket, which is linear in the index, and links join components.  Then the sets of
a bucket that lie in different components meet, block against block, and only pairs whose sketches
allow a link leave the blocks; within a component nothing is left to find, so a group of near copies
never becomes all its pairs.

Defined cases: null, empty and blank texts have no shingles and link with nothing; fewer than five
words are one shingle; rows with equal ids are one node with the links of each of their texts; a row
with a null id links with nothing and has a null component; sets are of whole texts, however long; of
equal sets the least id comes first; ``keep`` returns all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import WordHashes, documents, few, forget, most_frequent, scramble, shingle_set, stored
from quire.llm.components import components

NUMBER, PERCENT = 5, 80
BLOCK = 4_000_000
#: sets of a bucket that meet as one row, and sets of buckets with one least id that a task takes together
BLOCK_SETS, UNIT = 256, 1024
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def least_overlap(n: int, percent: int = PERCENT) -> int:
    return -(-n * percent // 100)


def text_set(text: bytes | None, hashes: WordHashes, number: int = NUMBER) -> np.ndarray:
    return shingle_set(hashes.of((text or b"").lower().split()), number)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens seen at least twice in a block, with their counts."""
    forget()
    hashes, held, size, seen = WordHashes(), [], 0, set()

    def flush() -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["token", "n"])

    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            for text in batch.slice(at, 128).column(1).to_pylist():
                tokens = text_set(text, hashes)
                key = xxhash.xxh3_128_digest(tokens.tobytes())
                if key in seen:
                    continue
                seen.add(key)
                held.append(tokens)
                size += len(tokens)
                if size >= BLOCK:
                    yield flush()
                    held, size, seen = [], 0, set()
    if held:
        yield flush()


def frequent_tokens(docs: DataFrame, least: int = 16, most: int = 1 << 18) -> np.ndarray:
    """At most ``most`` tokens, most frequent last."""
    found = _texts(docs).mapInArrow(_report, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    top = most_frequent(stored(found), most).toArrow()
    token, n = top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy()
    return token[np.lexsort((token, n))]


def levels(n: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(power of two, classes) for the sizes that the smaller of two linked sets may have, one of which has ``n`` tokens."""
    powers = range(max(least_overlap(n, percent), 1).bit_length() - 1, n.bit_length())
    return [(p, max(1, min((1 << p) * (100 - percent) // 100, (1 << p) * percent // 100 - 1))) for p in powers]


def index_keys(tokens: np.ndarray, frequent: np.ndarray, order: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Index keys of a sorted token set. ``frequent``: sorted tokens, ``order``: their ranks."""
    n = len(tokens)
    if n < 2:
        return np.zeros(0, np.uint64)  # links only with equal sets
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        often = frequent[at] == tokens
        rare, hot = tokens[~often], tokens[often][np.argsort(order[at[often]], kind="stable")]
    else:
        rare, hot = tokens, tokens[:0]
    one = n - least_overlap(n, percent) + 1
    found = [rare[:one]]
    for power, classes in levels(n, percent) if len(rare) < one else ():
        some = hot[: min(one + classes, n) - len(rare)]
        kind = scramble(some + np.uint64(power)) % np.uint64(classes)
        by_kind = np.lexsort((some, kind))
        some, kind = some[by_kind], kind[by_kind]
        for step in range(1, len(some)):  # pairs within a class: of neighbours, of those two apart, and so on
            same = kind[step:] == kind[:-step]
            if not same.any():
                break
            found.append(scramble((some[:-step][same] * _PAIR) ^ some[step:][same]) + np.uint64(power))
    return np.unique(np.concatenate(found))


def _signatures(frequent: np.ndarray, percent: int):
    rank = np.argsort(frequent)
    table = frequent[rank]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [text_set(t, hashes) for t in part.column(1).to_pylist()]
                keys = [index_keys(s, table, rank, percent) for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
                flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([parity_sketch(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                    names=["doc_id", "n", "same", "sketch", "keys"],
                )

    return run


def parity_sketch(tokens: np.ndarray) -> bytes:
    """Bit ``i`` tells whether an odd number of tokens hash to ``i``; a power of two of bits, about one per token."""
    bits = max(64, 1 << int(len(tokens)).bit_length())
    odd = np.bincount((scramble(tokens) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """At most the size of the symmetric difference of the sets; the longer sketch is folded to the shorter."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, n), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _plausible(percent: int):
    """Pairs (a, b) whose sizes and sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, x, y = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
            # of n1 + n2 tokens, linked sets have at most this share on one side only
            ok = [(100 + percent) * sketch_distance(s, t) <= (100 - percent) * (m + n) for m, n, s, t in zip(na, nb, x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _by_length(sketches: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Words of a sketch -> (places, matrix) of the sketches that long."""
    lengths = np.array([len(s) // 8 for s in sketches])
    return {int(n): (at := np.flatnonzero(lengths == n), np.frombuffer(b"".join(sketches[i] for i in at), np.uint64).reshape(-1, n)) for n in np.unique(lengths)}


def _meet(percent: int):
    """Pairs (a, b) of two blocks in different components whose sizes and sketches allow a link.

    Sets that share one key share many; a pair leaves a task once, as long as the task remembers it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()
        for batch in batches:
            for row in range(batch.num_rows):
                one, two = batch.column("mine")[row].values, batch.column("others")[row].values
                (i1, p1, n1), (i2, p2, n2) = ([v.field(c).to_numpy(zero_copy_only=False) for c in ("id", "part", "n")] for v in (one, two))
                found = []
                longer = _by_length(two.field("sketch").to_pylist())
                for size, (at, x) in _by_length(one.field("sketch").to_pylist()).items():
                    for size2, (at2, y) in longer.items():
                        if not size <= 2 * size2 <= 4 * size:  # sets of a like size have sketches of like length
                            continue
                        n = min(size, size2)
                        u, v = (np.bitwise_xor.reduce(m.reshape(len(m), -1, n), axis=1) for m in (x, y))
                        total = n1[at][:, None] + n2[at2][None, :]
                        ok = (p1[at][:, None] != p2[at2][None, :]) & (100 * n1[at][:, None] >= percent * n2[at2][None, :]) & (100 * n2[at2][None, :] >= percent * n1[at][:, None])
                        apart = np.zeros(ok.shape, np.int64)
                        for word in range(n):
                            apart += np.bitwise_count(u[:, None, word] ^ v[None, :, word])
                        j, k = np.nonzero(ok & ((100 + percent) * apart <= (100 - percent) * total))
                        found.append(np.stack([i1[at[j]], i2[at2[k]]], 1))
                pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
                new = {(min(p), max(p)) for p in pairs.tolist()} - told
                if len(told) > 1_000_000:
                    told.clear()
                told |= new
                pairs = np.array(sorted(new), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"])

    return run


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and token set (binary) of the documents named by ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([text_set(t, hashes).tobytes() for t in part.column(1).to_pylist()], pa.binary())], names=["id", "tokens"])

    rows = _texts(docs).filter(F.col("doc_id").isNotNull()).withColumnRenamed("doc_id", "id")
    return rows.join(few(ids), "id", "left_semi").select("id", "text").mapInArrow(run, "id long, tokens binary")


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for i, j, x, y in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both and 100 * both >= percent * (len(x) + len(y) - both):
                        a.append(i), b.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _linked(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ``pairs`` that link."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = stored(_sets(docs, ids))
    left, right = sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    return stored(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long").distinct())


def _likely(pairs: DataFrame, leads: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different ids whose set sizes and sketches allow a link."""
    low, high = (leads.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in ("a", "b"))
    both = pairs.distinct().join(low, "a").join(high, "b")
    both = both.filter((100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))).select("a", "b", "na", "nb", "sa", "sb")
    return stored(both.mapInArrow(_plausible(percent), "a long, b long").distinct())


def join(docs: DataFrame, percent: int = PERCENT, **how) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, **how))  # 2 MB at most
    rows = stored(_texts(docs).mapInArrow(lambda it: _signatures(shared.value, percent)(it), "doc_id long, n long, same binary, sketch binary, keys array<long>"))
    good = rows.filter(F.col("same").isNotNull() & F.col("doc_id").isNotNull())
    groups = stored(good.groupBy("same").agg(F.min("doc_id").alias("id")))
    leads = good.join(groups.select("same", F.col("id").alias("doc_id")), ["same", "doc_id"], "left_semi").withColumnRenamed("doc_id", "id")
    sketches = stored(leads.select("id", "n", "sketch").distinct())
    index = leads.select(F.explode("keys").alias("key"), "id")
    buckets = stored(index.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("low"), F.max("id").alias("high")).filter("low != high"))
    members = stored(index.join(few(buckets.filter("size > 2").select("key", "low")), "key"))
    star = buckets.filter("size = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).unionByName(members.filter("id != low").select(F.col("low").alias("a"), F.col("id").alias("b")))
    star = stored(star.distinct())
    links = _linked(docs, _likely(star, sketches, percent), percent)
    parts = stored(components(links))
    known = members.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("part", F.coalesce("component", "id"))
    mixed = known.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.first("low").alias("low"), F.count("*").alias("size")).filter("p != q")
    # buckets with one least id hold much the same sets: some of them are cut alike, and blocks of one number go to a task, which tells repeated pairs apart
    each = F.greatest(F.lit(1), F.floor(UNIT / F.least(F.lit(BLOCK_SETS), F.max("size"))))
    shape = mixed.groupBy("low").agg(F.ceil(F.max("size") / BLOCK_SETS).alias("blocks"), F.ceil(F.count("*") / each).alias("salts"))
    cut = stored(mixed.join(shape, "low").select("low", "key", "blocks", F.pmod(F.xxhash64("key"), F.col("salts")).alias("salt")))
    rest = known.drop("low").join(cut, "key").join(sketches, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    unit = ["low", "salt", "block"]
    blocks = stored(rest.repartition(*unit).groupBy(*unit, "key", "blocks").agg(F.collect_list(F.struct("id", "part", "n", "sketch")).alias("sets")))  # about BLOCK_SETS sets
    within = blocks.select(F.col("sets").alias("mine"), F.col("sets").alias("others"))
    one, two = (blocks.filter("blocks > 1").select("low", "salt", "key", F.col("block").alias(b), F.col("sets").alias(name)) for b, name in (("b1", "mine"), ("b2", "others")))
    across = one.join(two, ["low", "salt", "key"]).filter("b1 < b2").repartition("low", "salt", "b1", "b2").select("mine", "others")
    more = within.mapInArrow(_meet(percent), "a long, b long").unionByName(across.mapInArrow(_meet(percent), "a long, b long")).distinct()
    more = stored(more.join(star, ["a", "b"], "left_anti"))
    links = links.unionByName(_linked(docs, more, percent))
    # an id with several texts joins their sets' representatives; a row has the component of its set
    several = good.groupBy("doc_id").agg(F.min("same").alias("p"), F.max("same").alias("q")).filter("p != q").select("doc_id")
    joined = good.join(several, "doc_id").select("doc_id", "same").join(groups, "same").filter("doc_id != id").select(F.col("id").alias("a"), F.col("doc_id").alias("b")).distinct()
    whole = stored(components(links.unionByName(joined)))
    of_set = groups.join(whole.withColumnRenamed("node", "id"), "id", "left").select(F.col("same").alias("_same"), F.coalesce("component", "id").alias("of_set"))
    of_id = whole.join(several, whole["node"] == several["doc_id"], "left_semi").select(F.col("node").alias("doc_id"), F.col("component").alias("of_id"))
    found = rows.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("same")).alias("_same")).join(of_set, "_same", "left").join(few(of_id), "doc_id", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("of_set", "of_id", "doc_id").alias("component_id"))


def _one_of_equal(rows: DataFrame) -> DataFrame:
    """``rows`` with one of those that have equal ids and texts; rows with a null id all stay.

    Only rows that are repeated meet, one per task and group, so a group of any size is never gathered.
    """
    named = rows.withColumn("_same", F.coalesce(F.unhex(F.md5("text")), F.lit(b"")))
    again = stored(named.filter(F.col("doc_id").isNotNull()).groupBy("doc_id", "_same").agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    once, more = (named.join(few(again), ["doc_id", "_same"], how) for how in ("left_anti", "left_semi"))
    return once.unionByName(more.dropDuplicates(["doc_id", "_same"])).select(*rows.columns)


def keep(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that have the least id of their component, unchanged; of rows with equal ids and texts one."""
    gone = join(docs, **how).filter("doc_id != component_id").select("doc_id").distinct()
    return _one_of_equal(docs.join(gone, "doc_id", "left_anti").select(*docs.columns))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, p.v FROM r JOIN p ON p.u = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM s JOIN c ON c.node = doc_id"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))
