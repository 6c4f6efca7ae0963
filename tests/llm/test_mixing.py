from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import mixing


def plain_targets(sizes, weights, most=3.0):
    """Shares by weight; what is over a stop is shared again, one source at a time."""
    share, free = {}, set(range(len(sizes)))
    while free:
        left = sum(sizes) - sum(share.values())
        total = sum(weights[i] for i in free)
        over = sorted(i for i in free if left * weights[i] / total > most * sizes[i])
        if not over:
            return [share.get(i, left * weights[i] / total) for i in range(len(sizes))]
        share[over[0]] = most * sizes[over[0]]
        free.remove(over[0])
    return [share[i] for i in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[], [0, 0, 5], [1, 5, 1, 900, 30, 2, 7], list(range(40)), [10**12, 3, 0, 10**9]])
def test_targets(spark, sizes):
    names = [f"s{i:03d}" for i in range(len(sizes))]
    df = spark.createDataFrame([(n, 1, s) for n, s in zip(names, sizes, strict=True)], "source string, n long, size long").repartition(5)
    got = {r.source: r for r in mixing.with_targets(mixing.numbered(df)).collect()}
    want = plain_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    assert [got[n].source_no for n in names] == list(range(len(sizes)))
    assert np.allclose([got[n].target for n in names], want)


def test_sources_by_code_point_with_null_last(spark):
    names = ["a", "B", "é", "😀", "ﬀ", "", None]
    df = spark.createDataFrame([(n, 1, 10) for n in names], "source string, n long, size long")
    got = sorted((r.source_no, r.source) for r in mixing.numbered(df).collect())
    assert [s for _, s in got] == sorted(n for n in names if n is not None) + [None]


@given(st.lists(st.integers(0, 60), min_size=1, max_size=6), st.integers(1, 20))
def test_tree_uses_all_quotas(quotas, shards):
    def deal(seed):
        out = np.zeros((shards, len(quotas)), np.int64)
        for lo, hi, s, q in mixing.splitting_tree(np.arange(len(quotas)), np.array(quotas), 0, shards, 20, seed):
            assert hi == lo + 1
            out[lo, s] = q
        return out

    got = deal(3)
    assert (got >= 0).all() and got.sum(axis=0).tolist() == quotas and (got == deal(3)).all()
    assert got.sum(axis=1).max() - got.sum(axis=1).min() <= 5  # halves are cut to whole draws on each level


def test_tree_in_two_halves_equals_one(spark):
    quotas = [50, 0, 7, 300, 1]
    df = spark.createDataFrame(list(enumerate(quotas)), "source_no long, n long")
    got = {(r.shard, r.source_no): r.n for r in mixing.dealt(df, 100, 9).collect()}
    want = {(lo, int(i)): int(n) for lo, _, s, q in mixing.splitting_tree(np.arange(5), np.array(quotas), 0, 100, 99, 9) for i, n in zip(s, q, strict=True)}
    assert got == want


def test_mix(spark, documents):
    rows = mixing.counted(documents).collect()
    again = mixing.counted(documents.repartition(7)).collect()
    assert sorted(rows) == sorted(again) and len(rows) == documents.count()
    assert all(r.taken == r["size"] * len(r.shards) and r.taken <= 3 * r["size"] for r in rows)
    source = {r.doc_id: r.source for r in documents.select("doc_id", "source").collect()}
    taken, target, largest, size = defaultdict(int), {}, defaultdict(int), defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        taken[s] += r.taken
        size[s] += r["size"]
        target[s] = r.target
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    names = sorted(size)
    assert np.allclose([target[s] for s in names], plain_targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]))


def test_mix_equals_a_sequential_one(spark, documents):
    """The draws, replayed one document at a time: whole passes, whole blocks in order, then documents in order while there is room."""
    got = {r.doc_id: r for r in mixing.counted(documents, block_documents=8).collect()}
    rows = mixing.sized(documents).withColumn("order", F.xxhash64("doc_id", F.lit(23)))
    n = {r.source: r.n for r in documents.groupBy("source").agg(F.count("*").alias("n")).collect()}
    number = {s: i for i, s in enumerate(sorted(n))}
    block = spark.createDataFrame([(s, number[s], max(1, -(-k // 8))) for s, k in n.items()], "source string, source_no long, blocks int")
    rows = rows.join(block, "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(mixing.SEED)), F.col("blocks")).cast("int")).withColumn("block_order", F.xxhash64("source_no", "block", F.lit(mixing.SEED + 1)))
    times = {}
    by_source = defaultdict(list)
    for r in rows.collect():
        by_source[r.source].append(r)
    for docs in by_source.values():
        target, size = got[docs[0].doc_id].target, sum(d["size"] for d in docs)
        passes, left, full = int(target // size), target % size, False
        for d in docs:
            times[d.doc_id] = passes
        blocks = defaultdict(list)
        for d in docs:
            blocks[d.block_order, d.block].append(d)
        for _, some in sorted(blocks.items()):
            whole = sum(d["size"] for d in some) <= left
            for d in sorted(some, key=lambda d: (d.order, d.doc_id, d["size"])):
                if full or d["size"] > left:
                    full = True
                    break
                times[d.doc_id] += 1
                left -= d["size"]
            full = full or not whole
    assert all(len(got[i].shards) == (times[i] if got[i]["size"] else 0) for i in got)


def test_shards_come_from_the_tree(spark, documents):
    """Another seed of the tree alone gives other shards and the same words taken."""
    rows = mixing.stored(mixing.sized(documents))
    sources, drawn = mixing.draws(rows, shards=5, block_documents=8)
    plain = mixing.splitting_tree

    def other(s, q, lo, hi, depth, seed):
        return plain(s, q, lo, hi, depth, seed + 1)

    a = {r.doc_id: r for r in mixing.counted(documents, shards=5, block_documents=8).collect()}
    quotas = drawn.groupBy("source_no").agg(F.count("*").alias("n"))
    for seed in (mixing.SEED, 99):
        dealt = {(r.source_no, r.shard): r.n for r in mixing.dealt(quotas, 5, seed).collect()}
        own = {(r.source_no, r.shard): r.n for r in drawn.groupBy("source_no", "shard").agg(F.count("*").alias("n")).collect()}
        assert (dealt == own) == (seed == mixing.SEED)
    per_shard = [r.n for r in drawn.groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert len(per_shard) == 5 and max(per_shard) - min(per_shard) <= 2
    assert len({s for r in a.values() for s in r.shards}) == 5


def test_mix_of_shards_and_copies(spark, documents):
    plan = mixing.mix(documents, shards=5, block_documents=8).collect()
    counted = {r.doc_id: r for r in mixing.counted(documents, shards=5, block_documents=8).collect()}
    by_doc = defaultdict(list)
    for r in sorted(plan, key=lambda r: r.copy):
        by_doc[r.doc_id].append(r.shard)
    assert all(by_doc.get(d, []) == r.shards for d, r in counted.items())
    assert len({(r.doc_id, r.copy) for r in plan}) == len(plan)
    places = defaultdict(list)
    for r in plan:
        places[r.shard].append(r.place)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())
    mixed = mixing.mixed(documents, shards=5, block_documents=8)
    assert mixed.columns == documents.columns
    want = [r.doc_id for r in sorted(plan, key=lambda r: (r.shard, r.place))]
    assert [r.doc_id for r in mixed.select("doc_id").collect()] == want


def test_odd_rows(spark, odd, none):
    assert mixing.counted(none).count() == 0 and mixing.mixed(none).count() == 0
    got = mixing.counted(odd).collect()
    assert len(got) == odd.count()
    assert all(r.taken <= 3 * r["size"] for r in got) and all(r.taken == 0 for r in got if r["size"] == 0)
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(odd).count() == sum(len(r.shards) for r in got)
    clash = odd.selectExpr("*", "1 as source_no", "2 as block", "3 as copies", "4 as row")
    assert mixing.mixed(clash).columns == clash.columns


def test_one_id_repeated(spark):
    df = spark.createDataFrame([(7, f"w{i} x", "a") for i in range(3000)] + [(8, "y", "b"), (9, None, None)], "doc_id long, text string, source string")
    got = mixing.counted(df).collect()
    seven = [r for r in got if r.doc_id == 7]
    assert len(got) == 3002 and abs(sum(r.taken for r in seven) - seven[0].target) <= 2
