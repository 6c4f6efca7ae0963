"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sizes are counts of words.  Sources, by code point and null last, have the weights 5, 2, 1, repeating;
they share all words by weight, but a target stops at ``most`` times its source and what is over is
shared again among the others.

A source's documents fall into blocks by a hash of the id.  Its target is ``e`` whole passes over the
source, ``q`` whole blocks of one more pass and a rest, taken from the next block document by document
in hash order.  So the draws of a source are an exact number of blocks: its quota.  The tree splits
the vector of quotas among the output shards: each node deals half of its shards a multivariate
hypergeometric part of its quotas, so every shard holds exactly its share and all are used up.  Each
source's draws, permuted by hash, fill the shards' parts in that order, which makes the parts
disjoint, and a shard is shuffled by a hash of (id, copy).  Every copy of a document carries the shard
that the tree gave it; documents are taken because their blocks are dealt to a shard.

All steps are joins, windows and aggregates; nothing of the size of the documents, blocks or sources
comes to the driver.  The upper half of the tree is one group with a row per source, the lower half a
group per node.  A block is at most 1/65536 of its source or about 2,048 documents.

Defined cases: null texts have size 0; a null source is a source of its own; rows with equal ids are
separate documents ordered by size, and of those that tie in the cut block either may be the one
taken; a source of size 0 and an empty table have no draws; a text counts whole, however long, and is
taken whole; ``mixed`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import WORD, documents, few, stored

WEIGHTS = (5, 2, 1)
BLOCK_DOCUMENTS, MOST_BLOCKS, MOST_SHARDS, SEED = 2048, 65536, 4096, 11
#: levels of the tree that one group splits
LEVELS = 6


def numbered(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """``sizes`` (source, n, size) with source_no, ascending by code point and null last, and the weight."""
    spark = sizes.sparkSession
    parts = stored(sizes.repartitionByRange(F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id()))
    before, offsets = 0, []
    for r in sorted(parts.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a row per shuffle partition
        offsets.append((r["part"], before))
        before += r["n"]
    at = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1
    rows = parts.join(F.broadcast(spark.createDataFrame(offsets, "part int, before long")), "part").withColumn("source_no", F.col("before") + at)
    return rows.select("source", "n", "size", "source_no", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_no") % len(weights) + 1).cast("int")).alias("weight"))


def with_targets(sources: DataFrame, most: float = 3.0) -> DataFrame:
    """``sources`` with ``target``: shares of the sum of ``size`` by ``weight``, none above ``most`` times its size.

    All targets that are not stopped are ``level`` times their weight; stopping some raises the level
    and stops more, until none follows.
    """
    stops = lambda level: most * F.col("size") < level * F.col("weight")
    level = 0.0
    while True:
        r = sources.agg(F.sum("size").alias("all"), F.sum(F.when(stops(level), most * F.col("size"))).alias("stopped"), F.sum(F.when(~stops(level), F.col("weight"))).alias("weight")).first()
        if not r["all"] or not r["weight"]:
            break
        above = (r["all"] - (r["stopped"] or 0.0)) / r["weight"]
        if above <= level:
            break
        level = above
    return sources.withColumn("target", F.when(stops(level), most * F.col("size")).otherwise(level * F.col("weight")))


def splitting_tree(sources: np.ndarray, quotas: np.ndarray, lo: int, hi: int, depth: int, seed: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, sources, quotas) of the nodes ``depth`` levels below the node of shards ``lo`` to ``hi``; those without quota are left out."""
    if hi - lo == 1 or not depth:
        yield lo, hi, sources, quotas
        return
    mid = (lo + hi) // 2
    rest = int(quotas.sum())
    want = rest * (mid - lo) // (hi - lo)
    rng = np.random.default_rng([seed, lo, hi])
    part = np.zeros_like(quotas)
    for i, n in enumerate(quotas.tolist()):  # the marginals of a multivariate hypergeometric draw, one source at a time
        rest -= n
        part[i] = want if not rest else rng.hypergeometric(n, rest, want) if n and want else 0
        want -= int(part[i])
    for a, b, q in ((lo, mid, part), (mid, hi, quotas - part)):
        some = q > 0
        yield from splitting_tree(sources[some], q[some], a, b, depth - 1, seed)


def dealt(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``quotas`` (source_no, n) dealt to the shards by the tree: source_no, shard, n."""

    def split(depth: int):
        def run(node: pd.DataFrame) -> pd.DataFrame:
            node = node.sort_values("source_no")
            found = [pd.DataFrame({"lo": lo, "hi": hi, "source_no": s, "n": q}) for lo, hi, s, q in splitting_tree(node["source_no"].to_numpy(), node["n"].to_numpy(), int(node["lo"].iloc[0]), int(node["hi"].iloc[0]), depth, seed)]
            return pd.concat(found) if found else node.iloc[:0][["lo", "hi", "source_no", "n"]]

        return run

    nodes = quotas.filter("n > 0").select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "source_no", "n")
    for _ in range(-(-max(shards - 1, 1).bit_length() // LEVELS)):
        nodes = nodes.groupBy("lo", "hi").applyInPandas(split(LEVELS), "lo long, hi long, source_no long, n long")  # a row per source of the node
    return nodes.select("source_no", F.col("lo").alias("shard"), "n")


def sized(docs: DataFrame, *columns: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *columns)


def draws(rows: DataFrame, weights=WEIGHTS, most: float = 3.0, shards: int | None = None, seed: int = SEED, block_documents: int = BLOCK_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """Sources and the draws of blocks for ``rows`` of ``sized``.

    A source has source_no, source_size, target and its number of blocks.  A draw is source_no, block,
    copy, shard and, for a source's cut block, the words that there is room for.
    """
    sizes = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    sources = stored(with_targets(stored(numbered(sizes, weights)), most))
    blocks = F.least(F.lit(MOST_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("n") / block_documents))).cast("int")
    sources = sources.select("source_no", "source", F.col("size").alias("source_size"), "target", blocks.alias("blocks"))
    # whole blocks of the last, partial pass, in order of a hash of the block
    sums = in_blocks(rows, sources, seed).groupBy("source_no", "block", "source_size", "target").agg(F.sum("size").alias("block_size"))
    order = W.partitionBy("source_no").orderBy(F.xxhash64("source_no", "block", F.lit(seed + 1)), "block")
    placed = sums.withColumn("before", F.coalesce(F.sum("block_size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # MOST_BLOCKS rows of a source at most
    passes = F.floor(F.try_divide(F.col("target"), F.col("source_size")))
    room = F.col("target") - passes * F.col("source_size") - F.col("before")
    whole = (F.col("block_size") <= room) & (F.col("block_size") > 0)
    each = placed.filter("source_size > 0").select("source_no", "block", (passes + F.when(whole, 1).otherwise(0)).cast("int").alias("whole"), F.when(~whole & (room > 0), room).alias("room"))
    number = F.col("whole") + F.when(F.col("room").isNotNull(), 1).otherwise(0)
    drawn = each.filter(number > 0).select("source_no", "block", F.explode(F.sequence(F.lit(1), number)).alias("copy"), "whole", "room")
    permuted = W.partitionBy("source_no").orderBy(F.xxhash64("source_no", "block", "copy", F.lit(seed + 2)), "block", "copy")
    drawn = stored(drawn.select("source_no", "block", "copy", F.when(F.col("copy") > F.col("whole"), F.col("room")).alias("room"), F.row_number().over(permuted).cast("long").alias("at")))
    # the tree: how many draws of each source go to each shard, and so which
    quotas = stored(drawn.groupBy("source_no").agg(F.count("*").alias("n")))
    shards = shards or int(max(1, min(MOST_SHARDS, (quotas.agg(F.sum("n")).first()[0] or 0) // 4)))
    upto = F.sum("n").over(W.partitionBy("source_no").orderBy("shard"))
    parts = stored(dealt(quotas, shards, seed)).withColumn("upto", upto)
    places = parts.select("source_no", "shard", F.explode(F.sequence(F.col("upto") - F.col("n") + 1, F.col("upto"))).alias("at"))
    return sources, stored(drawn.join(places, ["source_no", "at"]).select("source_no", "block", "copy", F.col("shard").cast("int").alias("shard"), "room"))


def in_blocks(rows: DataFrame, sources: DataFrame, seed: int = SEED) -> DataFrame:
    """``rows`` with what is known of their sources, and their block."""
    known = rows.join(few(sources.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return known.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")).cast("int"))


def taken(rows: DataFrame, sources: DataFrame, drawn: DataFrame, seed: int = SEED) -> DataFrame:
    """``rows`` with ``copies``: an array of (copy, shard) for the times that the row is taken."""
    per_block = drawn.groupBy("source_no", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard", "room"))).alias("dealt"), F.max("room").alias("room"))  # some copies of one block
    known = in_blocks(rows, sources, seed).join(few(stored(per_block)), ["source_no", "block"], "left")
    order = W.partitionBy("source_no", "block").orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    cut = known.filter(F.col("room").isNotNull()).withColumn("fits", F.sum("size").over(order) <= F.col("room"))  # one block per source
    rest = known.filter(F.col("room").isNull()).withColumn("fits", F.lit(False))
    own = F.filter("dealt", lambda d: d["room"].isNull() | F.col("fits"))
    copies = F.when(F.col("size") > 0, F.transform(own, lambda d: F.struct(d["copy"].alias("copy"), d["shard"].alias("shard"))))
    return rest.unionByName(cut).withColumn("copies", F.coalesce(copies, F.array().cast("array<struct<copy:int,shard:int>>")))


def mix(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """The mix itself: a row doc_id, size, source, copy, shard, place for every time a document is taken."""
    rows = stored(sized(docs))
    plan = taken(rows, *draws(rows, seed=seed, **how), seed).select("doc_id", "size", "source", F.explode("copies").alias("own"))
    plan = plan.select("doc_id", "size", "source", "own.copy", "own.shard")
    place = F.row_number().over(W.partitionBy("shard").orderBy(F.xxhash64("doc_id", "copy", F.lit(31)), "doc_id", "copy", "size"))
    return plan.withColumn("place", place)  # a shard is about four blocks


def mixed(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """Every row of ``docs``, unchanged, as often as the mix takes it: shard by shard, each in its shuffled order."""
    own = stored(sized(docs))
    sources, drawn = draws(own, seed=seed, **how)
    rows = sized(docs, F.struct(*docs.columns).alias("row"))
    copies = taken(rows, sources, drawn, seed).select("row", "doc_id", F.explode("copies").alias("own"))
    order = F.xxhash64("doc_id", "own.copy", F.lit(31))
    placed = copies.select("row", F.col("own.shard").alias("shard"), order.alias("place"), "doc_id").repartitionByRange("shard")
    return placed.sortWithinPartitions("shard", "place", "doc_id").select("row.*")


def counted(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken and the shards of the copies of every row of ``docs``."""
    rows = stored(sized(docs))
    known = taken(rows, *draws(rows, seed=seed, **how), seed)
    return known.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).cast("long").alias("taken"), F.transform("copies", lambda c: c["shard"]).alias("shards"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(documents(spark, sf_dir))
