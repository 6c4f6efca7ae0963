"""Alignment of two tokenizers' tokens of one text, and how often their ids are linked in the corpus.

Byte-level BPE ids (A) of a blank and the text meet SentencePiece ids (B) of the text.  The work on
tokens is Arrow tables from end to end.  Id lists are flattened beside their parent indices; a running
sum of the tokens' bytes, taken off at each list's start, gives every token's end; a full outer hash
join on (list, end) has a row for each end of either side.  In order of ends, a row's A token and B
token are the next ones that end there or later: that is a link, and every pair of tokens whose bytes
overlap is met once, at the place where the first of the two ends.  Rows that both sides have close a
group.  ``Table.group_by`` counts a block's links by id pair, and Spark adds the blocks' counts up.

The lists are not the whole texts: Spark cuts these before a blank (or another character that no
longer piece holds) that follows something else than white space, where both tokenizers end a token
whatever follows.  A block of documents aligns each distinct stretch once, and all that is asked of a
document is a sum over its stretches.  Links' corpus-wide counts come back to the block by (block,
pair), so what is shuffled are blocks' distinct pairs and documents as numbers of stretches.

Defined cases: null and empty texts, and those whose tokens do not spell a blank and the text (a word
mark in the text itself), have no tokens: zeros and empty groups, and add to no count; texts are
aligned whole, however long; a text without a cut is one stretch; repeated rows, repeated and null ids
have a row each, and each counts; bytes that are no UTF-8 count as U+FFFD; special tokens' strings are
plain text; columns but doc_id and text are passed over, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bpe_words import by_slices, flat, in_blocks, joined_pieces, library, list_array, lists_of, piece_bytes
from quire.llm.common import documents, kept, stored

MARK = "▁"
#: stretches of a block
BLOCK = 1 << 20
DOCUMENT, STRETCH, PAIR = range(3)
CODED = "block long, kind int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, items array<int>, code int, a int, b int, n long"
_CODED = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()), ("items", pa.list_(pa.int32())), ("code", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The SentencePiece side: what each id stands for, where texts may be cut, ids of stretches."""

    def __init__(self, model_file: str | None = None):
        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=model_file or default_model())
        n = sp.get_piece_size()
        self.bytes = [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        longer = [p for i in range(n) if not sp.is_byte(i) and len(p := sp.id_to_piece(i)) > 1]
        inner = set("".join(longer))
        # characters before which a token ends; none, if a piece holds a mark after another character
        self.cuts = "" if "\n" in inner or any(MARK in p.lstrip(MARK) for p in longer) else " " + "".join(c for c in "\n\t\r" if c not in inner)
        self.lead = len(sp.encode("\n"))

    def ids(self, stretches: list[str]) -> list[list[int]]:
        """Ids of stretches; the blank that the model puts in front is cut off again together with a line end."""
        if not self.cuts:
            return self.library.encode([s[1:] for s in stretches], num_threads=1)
        return [ids[self.lead :] for ids in self.library.encode(["\n" + s for s in stretches], num_threads=1)]


def stretches(text: Column, cuts: str) -> Column:
    """A blank and the text, cut where both tokenizers end a token; nothing for null and empty texts."""
    marked = F.concat(F.lit(" "), text)
    parts = F.split(marked, rf"(?U)(?=[{cuts}])(?<=\S)") if cuts else F.array(marked)
    return F.when(F.octet_length(text) > 0, parts).otherwise(F.array().cast("array<string>"))


def _tokens(ids: pa.Array, sizes: pa.Array, name: str) -> pa.Table:
    """A row for each token: its list, the byte at which it ends in it, its id as ``name``."""
    ends, every = flat(ids)
    parent = pc.list_parent_indices(ids)
    running = pc.cumulative_sum(sizes.take(every))
    last = np.concatenate([[0], running.to_numpy()])[ends]
    before = pa.array(np.concatenate([[0], last[:-1]]) if len(last) else last)
    return pa.table({"list": parent, "end": pc.subtract(running, before.take(parent)), name: every})


def _by_list(lists: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(lists, minlength=n)


def aligned(a: pa.Array, b: pa.Array, sizes_a: pa.Array, sizes_b: pa.Array) -> tuple[pa.Table, np.ndarray, pa.Array]:
    """(links: list, a, b in order; groups of each list; these as text) of lists of A and B ids that spell the same bytes."""
    n = len(a)
    both = _tokens(a, sizes_a, "a").join(_tokens(b, sizes_b, "b"), ["list", "end"], join_type="full outer", use_threads=False).sort_by([("list", "ascending"), ("end", "ascending")]).combine_chunks()
    at = both.column("list").to_numpy().astype(np.int64)
    in_a, in_b = (both.column(c).is_valid().to_numpy() for c in "ab")
    common = in_a & in_b
    before = np.cumsum(common) - common  # groups closed before this row
    total = int(common.sum())

    def side(c: str, own: np.ndarray) -> pa.Array:
        return pc.binary_join(lists_of(np.cumsum(np.bincount(before[own], minlength=total)), pc.cast(both.column(c).drop_null().combine_chunks(), pa.string())), ",")

    groups = _by_list(at[common], n)
    one = pc.binary_join_element_wise(side("a", in_a), side("b", in_b), "|")
    said = pc.binary_join(lists_of(np.cumsum(groups), one), ";")
    links = pa.table({"list": pa.array(at), "a": pc.fill_null_backward(both.column("a")), "b": pc.fill_null_backward(both.column("b"))})
    return links, groups, said


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the values up to each end, from the end before."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[np.concatenate([[0], ends])])


def _rows(block: int, kind: int, columns: dict) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    columns = {"block": np.full(n, block), "kind": np.full(n, kind, np.int32)} | columns
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c := columns.get(f.name), np.ndarray) else pa.nulls(n, f.type) if c is None else c.cast(f.type) for f in _CODED], schema=_CODED)


def _align(tokenizer_file: str | None, model_file: str | None, said: Callable[[str], str]):
    """Rows of doc_id and stretches to rows of ``CODED``: documents, distinct stretches (their links as pair numbers), distinct pairs."""

    def sides() -> tuple:
        ids, pieces = piece_bytes(tokenizer_file)
        by_id = [b""] * (int(ids[-1]) + 1)
        for i, piece in zip(ids.tolist(), pieces, strict=True):
            by_id[i] = piece
        other = Pieces(model_file)
        return pa.array(by_id), pa.array(other.bytes), other

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = library(tokenizer_file, plain=True)
        bytes_a, bytes_b, other = kept("alignment", (tokenizer_file, model_file), sides)
        ids_a, ids_b = (pa.array(np.arange(len(x), dtype=np.int32)) for x in (bytes_a, bytes_b))
        sizes_a, sizes_b = (pc.binary_length(x).cast(pa.int64()) for x in (bytes_a, bytes_b))
        for block, rows in in_blocks(batches, 1, BLOCK):
            ends, every = flat(rows.column(1))
            found = every.dictionary_encode()
            codes, distinct, n = found.indices.to_numpy().astype(np.int64), found.dictionary, len(found.dictionary)
            a, b = [], []
            for at in range(0, n, 4096):
                some = distinct.slice(at, 4096).to_pylist()
                a.append(list_array([e.ids for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]))
                b.append(list_array(other.ids(some)))
            a, b = (pa.concat_arrays(x) if x else list_array([]) for x in (a, b))
            spelled = pc.and_(pc.equal(joined_pieces(a, ids_a, bytes_a), distinct.cast(pa.binary())), pc.equal(joined_pieces(b, ids_b, bytes_b), distinct.cast(pa.binary())))
            good = spelled.to_numpy(zero_copy_only=False)
            fits = (_sums(~good[codes], ends) == 0) & (_sums(np.ones(len(codes), int), ends) > 0)
            empty = pa.scalar([], a.type)
            a, b = (pc.if_else(spelled, x, empty) for x in (a, b))
            links, groups, text = aligned(a, b, sizes_a, sizes_b)
            of = {"n_a": pc.list_value_length(a).to_numpy(), "n_b": pc.list_value_length(b).to_numpy(), "n_groups": groups, "n_links": _by_list(links.column("list").to_numpy(), n)}
            own = np.repeat(fits, np.diff(np.concatenate([[0], ends])))  # stretches of documents that have tokens
            codes, ends = codes[own], np.cumsum(np.where(fits, np.diff(np.concatenate([[0], ends])), 0))
            times = np.bincount(codes, minlength=n)
            pair = pc.add(pc.multiply(links.column("a").cast(pa.int64()), 1 << 32), links.column("b").cast(pa.int64())).combine_chunks()
            pair = (pa.concat_arrays(pair.chunks) if isinstance(pair, pa.ChunkedArray) else pair).dictionary_encode()
            counts = pa.table({"code": pair.indices, "n": times[links.column("list").to_numpy()]}).group_by("code", use_threads=False).aggregate([("n", "sum")])
            counts = counts.filter(pc.greater(counts.column("n_sum"), 0))
            key = pair.dictionary.to_numpy()[counts.column("code").to_numpy()]
            items = lists_of(ends, pa.array(codes.astype(np.int32)))
            told = pc.if_else(pa.array(fits), pc.binary_join(lists_of(ends, text.take(pa.array(codes))), ";"), "") if len(text) else pa.array([""] * len(fits))
            told = pa.array([said(x) for x in told.to_pylist()], pa.string())
            yield from by_slices(_rows(block, DOCUMENT, {"doc_id": rows.column(0).combine_chunks(), "groups": told, "items": items} | {c: _sums(v[codes], ends) for c, v in of.items()}))
            yield from by_slices(_rows(block, STRETCH, {"code": np.arange(n, dtype=np.int32), "items": lists_of(np.cumsum(of["n_links"]), pair.indices)}), 1 << 16)
            yield from by_slices(_rows(block, PAIR, {"code": counts.column("code").combine_chunks(), "a": (key >> 32).astype(np.int32), "b": (key & 0xFFFFFFFF).astype(np.int32), "n": counts.column("n_sum").combine_chunks()}), 1 << 16)

    return run


def coded(docs: DataFrame, tokenizer_file: str | None = None, model_file: str | None = None, said: Callable[[str], str] = str) -> DataFrame:
    """The stored table of ``CODED``; ``said`` makes the column ``groups`` of a document from its groups as text."""
    cuts = Pieces(model_file).cuts
    cut = docs.select(F.col("doc_id").cast("long"), stretches(F.col("text").cast("string"), cuts).alias("stretches"))
    return stored(cut.mapInArrow(_align(tokenizer_file, model_file, said), CODED), "zstd")


def pair_counts(found: DataFrame) -> DataFrame:
    """a, b, n (links of the corpus) and best (n is the highest of this b) from a table of ``coded``."""
    counts = stored(found.filter(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("n").alias("n")), "zstd")
    top = counts.groupBy("b").agg(F.max("n").alias("top"))  # as many rows as the vocabulary of B, at most
    return counts.join(F.broadcast(top), "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def groups(docs: DataFrame, tokenizer_file: str | None = None, model_file: str | None = None) -> DataFrame:
    """doc_id and groups (text: A ids, a bar, B ids; groups with semicolons between) of every row."""
    return coded(docs, tokenizer_file, model_file).filter(F.col("kind") == DOCUMENT).select("doc_id", "groups")


def _link_sums(rows: pa.Table, counts: pa.Table) -> pa.Table:
    """Documents and stretches of a block with the counts of its pairs: sums over each document's links."""
    of_kind = lambda kind: rows.filter(pc.equal(rows.column("kind"), kind))
    docs, units = of_kind(DOCUMENT), of_kind(STRETCH)
    units = units.take(pc.sort_indices(units.column("code")))  # codes are 0, 1, 2 and so on
    ends, links = flat(units.column("items"))
    links, at = links.to_numpy(), counts.column("code").to_numpy()
    values = {}
    for name, column in (("n_best", "best"), ("count_sum", "n")):
        by_pair = np.zeros(max(links.max(initial=-1), at.max(initial=-1)) + 1, np.int64)
        by_pair[at] = counts.column(column).cast(pa.int64()).to_numpy()
        values[name] = _sums(by_pair[links], ends)
    ends, codes = flat(docs.column("items"))
    codes = codes.to_numpy()
    return pa.table({c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {c: _sums(v[codes], ends) for c, v in values.items()} | {"groups": docs.column("groups")})


def alignment(docs: DataFrame, tokenizer_file: str | None = None, model_file: str | None = None, said: Callable[[str], str] = str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of every row."""
    found = coded(docs, tokenizer_file, model_file, said)
    pairs = found.filter(F.col("kind") == PAIR).select("block", "code", "a", "b")
    counts = stored(pairs.join(pair_counts(found), ["a", "b"]).select("block", "code", "n", "best"), "zstd")
    rows = found.filter(F.col("kind") != PAIR).select("block", "kind", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "items", "code")
    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return rows.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_link_sums, kinds)


def digested(said: str) -> str:
    return hashlib.sha256(said.encode()).hexdigest() if said else ""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(documents(spark, sf_dir), said=digested).withColumnRenamed("groups", "groups_sha256")
