"""BPE encoding and decoding over a table of distinct words.

Spark cuts every text before each run of white space that follows other characters, where a byte-level
pre-tokeniser always ends a token, so a word's ids do not depend on its neighbours.  Tasks number the
distinct words of a *block* of documents (some million words), the frequent ones first, and keep each
document as its words' numbers.  The blocks' words with their places (block, number) are one table,
shuffled and sorted by word; each distinct word of it is encoded once.  Ids come back by position: a
word's ids go to all its places, and each block's documents meet their words' ids by block, where a
document's ids are those of its numbers in order.

A word is in as many rows as there are blocks that hold it, however often it stands in them, so the
most frequent words are no heavy keys; a block is bounded by its words, or is one document.  Numbers
and ids are stored and shuffled as packed bytes, most of them one or two bytes each.

``decode`` joins ids to the table of pieces (its size is the vocabulary's), in order, and puts the
pieces' bytes of each row together.

Defined cases: null and empty texts have no ids and decode to the empty text; texts are encoded whole,
however long, and a text without white space is one word; repeated rows, repeated and null ids have a
row each; bytes that are no UTF-8 count as U+FFFD, in texts and in what ids decode to; ids without a
piece decode to nothing, as in the library; columns but doc_id and text are passed over, whatever
their names.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import documents, kept, shared_dir, stored

#: words of a block, and rows of words that a task encodes together
BLOCK, CHUNK = 1 << 22, 1 << 17
#: turns in which digests shuffle words and blocks, to need less disk at one time
PASSES = 2
#: (?U): \s is Unicode White_Space, as in the pre-tokeniser
WORDS = r"(?U)\s*+\S++|\s++"
CODED = "kind int, block long, doc_id long, codes binary, first int, words array<string>"
_CODED = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("doc_id", pa.int64()), ("codes", pa.binary()), ("first", pa.int32()), ("words", pa.list_(pa.string()))])
TEXTS, WORDS_OF_BLOCK = 0, 1
FOUND = "block long, codes binary, sizes binary, ids binary"
_FOUND = pa.schema([("block", pa.int64()), ("codes", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary())])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def words(text: Column) -> Column:
    """The words of a text, in order; together they are the text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0))


def in_blocks(batches: Iterator[pa.RecordBatch], lists: int, most: int) -> Iterator[tuple[int, pa.Table]]:
    """Whole rows until column number ``lists`` holds ``most`` values, with a number that no other block of the job has."""
    number, rows, held = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            ends = np.cumsum(pc.list_value_length(batch.column(lists).slice(at)).to_numpy(zero_copy_only=False))
            n = min(int(np.searchsorted(ends, most - held)) + 1, len(ends))
            rows.append(batch.slice(at, n))
            held += int(ends[n - 1])
            at += n
            if held >= most:
                yield number, pa.Table.from_batches(rows)
                number, rows, held = number + 1, [], 0
    if rows:
        yield number, pa.Table.from_batches(rows)


def _folder(spark: SparkSession, path: str) -> tuple:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    files, folder = _folder(spark, path)
    return files.exists(folder)


def delete(spark: SparkSession, path: str) -> None:
    files, folder = _folder(spark, path)
    files.delete(folder, True)


def by_slices(rows: pa.RecordBatch, step: int = 4096) -> Iterator[pa.RecordBatch]:
    for at in range(0, rows.num_rows, step):
        yield rows.slice(at, step)


def flat(lists: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each list ends, and all values in order."""
    whole = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
    return np.cumsum(pc.list_value_length(whole).to_numpy(zero_copy_only=False), dtype=np.int64), whole.flatten()


def lists_of(ends: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)


def packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Lists of numbers below 2**35 as bytes: seven bits in each, the low ones first, the top bit where more follow."""
    v = values.astype(np.uint64)
    size = 1 + sum(((v >> np.uint64(7 * k)) > 0).astype(np.int64) for k in range(1, 5))
    starts = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        more = size > k
        out[starts[more] + k] = ((v[more] >> np.uint64(7 * k)) & np.uint64(127)) | ((size[more] > k + 1).astype(np.uint64) << np.uint64(7))
    cuts = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends])].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(cuts), pa.py_buffer(out)])


def unpacked(lists: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the ``packed`` lists ends, and all numbers in order."""
    parts = lists.to_pylist()
    raw = np.frombuffer(b"".join(parts), np.uint8)
    done = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], done[:-1] + 1]) if len(done) else done
    size, v = done - starts + 1, np.zeros(len(done), np.int64)
    for k in range(int(size.max(initial=0))):
        more = size > k
        v[more] |= (raw[starts[more] + k] & 127).astype(np.int64) << (7 * k)
    return np.searchsorted(done, np.cumsum([len(x) for x in parts], dtype=np.int64), "left"), v


def parts_of(sizes: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of lists that hold some ``most`` values together."""
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + most, "right")))
        yield at, to
        at = to


def numbered(most: int = BLOCK, step: int = 4096) -> Callable:
    """Rows of doc_id and words to rows of ``CODED``: one for each document, and one for each ``step`` distinct words of its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in in_blocks(batches, 1, most):
            ends, all_words = flat(rows.column(1))
            ids, sizes = rows.column(0).combine_chunks(), np.diff(ends, prepend=0)
            found = all_words.dictionary_encode()
            del rows, all_words
            codes, m = found.indices.to_numpy(), len(found.dictionary)
            order = pc.sort_indices(pa.table({"n": np.bincount(codes, minlength=m), "word": found.dictionary}), [("n", "descending"), ("word", "ascending")])
            rank = np.empty(m, np.int32)
            rank[order.to_numpy()] = np.arange(m, dtype=np.int32)
            for a, b in parts_of(sizes):
                start, n = int(ends[a] - sizes[a]), b - a
                own = packed(rank[codes[start : int(ends[b - 1])]], ends[a:b] - start)
                columns = [pa.array(np.full(n, TEXTS, np.int32)), pa.array(np.full(n, block)), ids.slice(a, n), own, pa.nulls(n, pa.int32()), pa.nulls(n, _CODED.types[-1])]
                yield from by_slices(pa.RecordBatch.from_arrays(columns, schema=_CODED))
            first = np.arange(0, m, step)
            words, n = lists_of(np.append(first[1:], m) if m else first, found.dictionary.take(order)), len(first)
            columns = [pa.array(np.full(n, WORDS_OF_BLOCK, np.int32)), pa.array(np.full(n, block)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(first.astype(np.int32)), words]
            yield from by_slices(pa.RecordBatch.from_arrays(columns, schema=_CODED), 16)
            del found, codes, rank, order, words, columns, own
            pa.default_memory_pool().release_unused()  # the process lives on

    return run


def library(tokenizer_file: str | None, plain: bool = False):
    """The tokenizer, once per worker process; ``plain``: the strings of its special tokens are text."""

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        got = tokenizers.Tokenizer.from_file(tokenizer_file or default_tokenizer())
        got.no_truncation()
        got.no_padding()
        got.encode_special_tokens = plain
        return got

    return kept("tokenizer", (tokenizer_file, plain), make)


def list_array(ids: list[list[int]]) -> pa.Array:
    return pa.array(ids, pa.list_(pa.int32()))


def word_ids(entries: DataFrame, tokenizer_file: str | None = None, most: int = CHUNK) -> DataFrame:
    """Rows of ``FOUND`` from word, block, code: a block's words that a task holds, as packed numbers, counts of ids, ids.

    Rows of equal words are together and sorted; each distinct word is encoded once.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        rows, held = [], 0
        for batch in batches:
            rows.append(batch)
            held += batch.num_rows
            if held >= most:
                yield pa.Table.from_batches(rows)
                rows, held = [], 0
        if rows:
            yield pa.Table.from_batches(rows)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = library(tokenizer_file)
        last, last_ids = None, None  # the word that two chunks may share
        for rows in chunks(batches):
            column = rows.column("word").combine_chunks()
            found = (pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
            words, ids = found.dictionary.to_pylist(), []
            for at in range(0, len(words), 4096):
                some = words[at : at + 4096]
                known = at == 0 and some[0] == last
                ids += [last_ids] * known + [e.ids for e in tokenizer.encode_batch_fast(some[known:], add_special_tokens=False)]
            last, last_ids = words[-1], ids[-1]
            block, code = (rows.column(c).to_numpy() for c in ("block", "code"))
            order = np.lexsort((code, block))
            block, code = block[order], code[order].astype(np.int64)
            lists = list_array(ids).take(pa.array(found.indices.to_numpy()[order]))
            ends, every = flat(lists)
            new = np.flatnonzero(np.append(block[1:] != block[:-1], True)) + 1  # where a block's rows end
            step = np.diff(code, prepend=0)
            step[new[:-1]] = code[new[:-1]]
            yield from by_slices(pa.RecordBatch.from_arrays([pa.array(block[new - 1]), packed(step, new), packed(np.diff(ends, prepend=0), new), packed(every.to_numpy(), ends[new - 1])], schema=_FOUND))

    together = entries.repartition("word").sortWithinPartitions("word")
    return together.mapInArrow(encode, FOUND)


def _positions(docs: pa.Table, found: pa.Table) -> pa.Table:
    """Documents of a block (block, doc_id, codes) with the ids of their words (``FOUND``)."""
    part_ends, steps = unpacked(found.column("codes"))
    first = np.concatenate([[0], part_ends])[:-1]
    running = np.cumsum(steps)
    own = running - np.repeat(running[first] - steps[first], np.diff(part_ends, prepend=0))  # numbers are kept as steps
    size, ids = unpacked(found.column("sizes"))[1], unpacked(found.column("ids"))[1].astype(np.int32)
    start_of, size_of = np.empty(len(own), np.int32), np.empty(len(own), np.int32)
    start_of[own], size_of[own] = np.cumsum(size) - size, size  # numbers are 0, 1, 2 and so on
    out = []
    for a, b in parts_of(pc.binary_length(docs.column("codes")).to_numpy()):
        ends, codes = unpacked(docs.column("codes").slice(a, b - a))
        n = size_of[codes].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(start_of[codes] - total[:-1], n) + np.arange(int(total[-1]))
        out.append(pa.table({"doc_id": docs.column("doc_id").slice(a, b - a), "ids": lists_of(total[ends], pa.array(ids[at]))}))
    pa.default_memory_pool().release_unused()  # the process lives on
    return pa.concat_tables(out)


def _matched(docs: DataFrame, tokenizer_file: str | None, block: int, chunk: int, then: Callable[[pa.Table], pa.Table], kinds: str, passes: int = 1) -> DataFrame:
    """``then`` of the rows of doc_id and ids of each block.

    With several ``passes`` the words, by hash, and then the blocks are shuffled in as many turns, whose
    shuffle files go as each is stored, and the result is stored.
    """
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession)
    cut = docs.select(F.col("doc_id").cast("long"), words(F.col("text").cast("string")).alias("words"))
    cut.mapInArrow(numbered(block), CODED).write.partitionBy("kind").options(**{"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}).parquet(path)
    read = lambda kind, columns: spark.read.schema(columns).parquet(f"{path}/kind={kind}") if exists(spark, f"{path}/kind={kind}") else spark.createDataFrame([], columns)
    union = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    entries = read(WORDS_OF_BLOCK, "block long, first int, words array<string>").select("block", "first", F.posexplode("words").alias("at", "word"))
    entries = entries.select("word", "block", (F.col("first") + F.col("at")).alias("code"))
    turn = F.pmod(F.xxhash64("word"), F.lit(passes))
    found = union([stored(word_ids(entries.filter(turn == k), tokenizer_file, chunk), "zstd") for k in range(passes)])
    delete(spark, f"{path}/kind={WORDS_OF_BLOCK}")  # found has all of it
    texts = read(TEXTS, "block long, doc_id long, codes binary")
    if passes == 1:
        return texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(lambda one, two: then(_positions(one, two)), kinds)
    turn = F.shiftrightunsigned("block", 32) % passes  # by the task that made it
    own = lambda rows, k: rows.filter(turn == k).groupBy("block")
    return union([stored(own(texts, k).cogroup(own(found, k)).applyInArrow(lambda one, two: then(_positions(one, two)), kinds)) for k in range(passes)])


def encode(docs: DataFrame, tokenizer_file: str | None = None, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """doc_id and ids (array<int>) of every row; ``block`` and ``chunk`` bound what tasks hold at once, and change no id."""
    return _matched(docs, tokenizer_file, block, chunk, lambda rows: rows, "doc_id long, ids array<int>")


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write the printable bytes of Latin-1 as they are and the others, in order, from U+0100."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(others)}


def piece_bytes(tokenizer_file: str | None = None) -> tuple[np.ndarray, list[bytes]]:
    """Ids in ascending order, and what each stands for."""
    with open(tokenizer_file or default_tokenizer(), encoding="utf-8") as f:
        file = json.load(f)
    named = {i: piece for piece, i in file["model"]["vocab"].items()} | {t["id"]: t["content"] for t in file.get("added_tokens", [])}
    byte_of, ids = byte_of_character(), sorted(named)
    return np.array(ids, np.int32), [bytes(byte_of[c] for c in named[i]) if all(c in byte_of for c in named[i]) else named[i].encode() for i in ids]


def joined_pieces(ids: pa.Array, known: pa.Array, pieces: pa.Array) -> pa.Array:
    """The bytes of each list of ids: a left join of all ids to the pieces, in order, put together by list."""
    ends, every = flat(ids)
    found = pc.fill_null(pieces.take(pc.index_in(every, value_set=known)), b"")
    return pc.binary_join(lists_of(ends, found), b"")


def _decoded(tokenizer_file: str | None, rows: pa.Table | pa.RecordBatch, schema: pa.Schema, columns: Callable) -> Iterator[pa.RecordBatch]:
    """``columns(doc_ids, ids, bytes of each)`` of rows of doc_id and ids."""
    known, pieces = kept("pieces", tokenizer_file, lambda: tuple(map(pa.array, piece_bytes(tokenizer_file))))
    for batch in rows.to_batches() if isinstance(rows, pa.Table) else [rows]:
        for part in by_slices(batch, 512):
            yield pa.RecordBatch.from_arrays(columns(part.column(0), part.column(1), joined_pieces(part.column(1), known, pieces)), schema=schema)


def lossy(data: bytes) -> bytes:
    """UTF-8 with U+FFFD for what is none."""
    return data.decode("utf-8", "replace").encode()


def decode(encoded: DataFrame, tokenizer_file: str | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids are no ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    rows = encoded.select(F.col("doc_id").cast("long"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    texts = lambda docs, ids, data: [docs, pa.array([lossy(x).decode() for x in data.to_pylist()], pa.string())]
    return rows.mapInArrow(lambda batches: (out for batch in batches for out in _decoded(tokenizer_file, batch, schema, texts)), "doc_id long, text string")


def digest(docs: DataFrame, tokenizer_file: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian 32-bit ids) and decoded_sha256 of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def columns(docs: pa.Array, ids: pa.Array, data: pa.Array) -> list:
        ends, every = flat(ids)
        raw, cuts = every.to_numpy(zero_copy_only=False).astype("<u4"), [0, *ends.tolist()]
        return [docs, pc.list_value_length(ids).cast(pa.int64()), pa.array([sha(raw[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])], pa.string()), pa.array([sha(lossy(x)) for x in data.to_pylist()], pa.string())]

    table = lambda rows: pa.Table.from_batches(list(_decoded(tokenizer_file, rows, schema, columns)), schema=schema)
    return _matched(docs, tokenizer_file, BLOCK, CHUNK, table, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", PASSES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
