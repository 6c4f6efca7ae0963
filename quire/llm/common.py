"""What several operators share: shared storage, word streams, hashing, held-out folds."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: words are runs of anything but the ASCII blanks; ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: odd multipliers of a word's place in a window
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="quire-")


#: folders that this process has named, for ``swept``
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, a local one in local mode and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _own_dir()
    _MADE.append(f"{root.rstrip('/')}/quire-{uuid.uuid4().hex}")
    return _MADE[-1]


#: Spark's own setting: an execution's shuffle files go when it has ended
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` to shared storage and read it back: cuts lineage and survives lost executors.

    The shuffle files of the write go when it has ended; nothing reads them afterwards.
    """
    spark = df.sparkSession
    path, before = shared_dir(spark), spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A broadcast of ``df`` (narrow rows) where a count finds at most ``most`` of them; beyond, a plain join shuffles."""
    return F.broadcast(df) if df.count() <= most else df


def swept(make: Callable[[], DataFrame]) -> DataFrame:
    """``stored(make())``, after which the tables that were stored on the way are deleted."""
    at = len(_MADE)
    df = stored(make())
    spark, (*gone, _) = df.sparkSession, _MADE[at:]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in gone:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    del _MADE[at:-1]
    return df


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def least_hashed(df: DataFrame, key: str | list[str], most: int) -> DataFrame:
    """At most ``most`` rows, those with the least hash of ``key``; hardly more than them are sorted, however many there are.

    Rows that repeat one key pass or miss the threshold together; if too few pass, all rows are sorted.
    """
    keys = [key] if isinstance(key, str) else key
    total, h = df.count(), F.xxhash64(*keys)
    if total > 4 * most:
        some = df.filter(h < int((1 << 64) * 2 * most / total) - (1 << 63))
        if some.count() >= most:
            df = some
    return df.orderBy(h, *keys).limit(most)


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of ``counts`` (with a column ``n``) with the greatest ``n``: whole levels, an eighth of a doubling wide, as far as they make ``most`` rows."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 8)
    taken, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect(), reverse=True):  # some hundred levels at most
        taken += r["rows"]
        if taken > most:
            break
        least = r["level"]
    return counts.filter(level >= least) if least is not None else counts.limit(0)


def by_rows(make: Callable[[], Callable[[tuple], tuple]], schema: pa.Schema, step: int = 256, keeps: bool = False):
    """A ``mapInArrow`` function from ``make()``, which builds per task a function row -> row; ``keeps``: it uses ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
        one = make()
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                columns = [c.to_pylist() for c in batch.slice(at, step).columns]
                rows = [one(row) for row in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


class WordHashes(dict):
    """word -> 64-bit hash; forgets all beyond ``bound`` entries, which costs time and no result."""

    def __init__(self, bound: int = 200_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Recall(dict):
    """key -> ``of(key)``; takes results in while there is room, and starts anew once far more have passed it by.

    ``known``: results that are given, and stay.
    """

    def __init__(self, of: Callable, bound: int = 400_000):
        super().__init__()
        self.of, self.bound, self.passed, self.known = of, bound, 0, {}

    def __missing__(self, key):
        got = self.known.get(key)
        if got is None:
            got = self.of(key)
        if len(self) < self.bound:
            if len(key) <= 64:
                self[key] = got
        else:
            self.passed += 1
            if self.passed > 8 * self.bound:
                self.clear()
                self.passed = 0
        return got


_KEPT: dict[str, tuple] = {}


def kept(kind: str, key, make: Callable):
    """``make()``, once per Python worker process while the key stays: workers live on from task to task."""
    if kind not in _KEPT or _KEPT[kind][0] != key:
        _KEPT.pop(kind, None)
        _KEPT[kind] = key, make()
    return _KEPT[kind][1]


def forget() -> None:
    """Drop what ``kept`` holds: for tasks of other operators in the same process."""
    _KEPT.clear()


def marked_parts(text: bytes, mark: str, cut: Callable[[str], list[str]], alone: str) -> list[bytes]:
    """``cut`` of the text with a mark in front and for each blank, as bytes with blanks for marks.

    Plain splitting does where no two marks meet; ``alone``: the characters that stand by themselves.
    """
    text = b" " + text
    if alone != "\n\t\r" or any(x in text for x in (b"  ", b"\0", b"\t", b"\r")):
        return [p.replace(mark, " ").encode() for p in cut(text.decode("utf-8", "replace").replace(" ", mark))]
    return text.replace(b" ", b"\0 ").replace(b"\n", b"\0\n\0").split(b"\0")


def with_marks(part: bytes, mark: str) -> str:
    return part.decode("utf-8", "replace").replace(" ", mark)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all ``n``-word windows in order."""
    last = len(hashes) - n + 1
    total = np.zeros(max(last, 0), np.uint64)
    for k in range(n if last > 0 else 0):
        total += scramble(hashes[k : k + last]) * _PLACE[k]
    return scramble(total)


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct window hashes; a shorter text is one shingle, an empty one none."""
    if 0 < len(hashes) < n:
        return windows(np.concatenate([hashes, np.full(n - len(hashes), len(hashes), np.uint64)]), n)
    return np.unique(windows(hashes, n))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
