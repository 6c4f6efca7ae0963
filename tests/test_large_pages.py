import random

from pyspark.sql import functions as F

from quire.functions import boxes
from quire.operators import large_pages
from quire.operators.components import components

ROWS = "doc_id long, place long, x1 double, y1 double, x2 double, y2 double, desc string"


def page(rng, doc, n, size, width):
    out = []
    for i in range(n):
        x, y = rng.uniform(0, size), rng.uniform(0, size)
        out.append((doc, i, x, y, x + rng.choice([0, rng.uniform(0, width)]), y + rng.uniform(0, width), rng.choice(["", None, f"d{i}"])))
    return out


def test_clusters_equal_those_of_arrays(spark):
    rng = random.Random(6)
    rows = [r for doc in range(40) for r in page(rng, doc, rng.randint(0, 30), rng.choice([100, 400, 1000]), rng.choice([10, 60, 500]))]
    rows += [(90, i, 40.0 * i, 0.0, 40.0 * i, 0.0, "p") for i in range(4)] + [(91, 0, 0.0, 0.0, 0.0, 0.0, "same"), (91, 1, 0.0, 0.0, 0.0, 0.0, "same"), (91, 2, -90.0, -5.0, -50.0, 5.0, "left")]
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    got = sorted(map(tuple, large_pages.clustered(df, ["doc_id"]).drop("place").collect()))
    arrays = df.withColumn("desc", F.coalesce("desc", F.lit(""))).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", *boxes.SIDES, "desc"))), lambda s: F.struct(*(s[c].alias(c) for c in (*boxes.SIDES, "desc")))).alias("figures"))
    want = arrays.select("doc_id", F.inline(boxes.clustered(F.col("figures"))))
    assert got == sorted(map(tuple, want.collect())) and 0 < len(got) < len(rows)


def test_a_page_of_fifty_thousand_boxes(spark):
    """Small boxes in a lattice of groups, far from each other: as many clusters as groups, and no pair is compared across."""
    groups, each = 2500, 20
    i = F.col("id")
    g, k = F.floor(i / each), i % each
    x, y = (g % 50) * 200 + (k % 5) * 20, F.floor(g / 50) * 200 + F.floor(k / 5) * 20
    rows = spark.range(groups * each).select(F.lit(1).cast("long").alias("doc_id"), i.alias("place"), x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + 10).cast("double").alias("x2"), (y + 10).cast("double").alias("y2"), F.lit("b").alias("desc"))
    pairs = large_pages.near_pairs(rows, ["doc_id"])
    assert pairs.count() == pairs.distinct().count() < groups * each * each
    got = large_pages.clustered(rows, ["doc_id"])
    assert got.count() == groups and got.filter((F.col("x2") - F.col("x1") == 90) & (F.col("desc") == "b; b; b")).count() == groups


def test_components(spark):
    n = 500
    edges = [(1, i, i + 1) for i in range(n - 1)] + [(1, 3, 3), (2, 7, 5), (2, 7, 5), (2, 9, 7)]
    random.Random(1).shuffle(edges)
    nodes = [(1, i) for i in range(n)] + [(2, i) for i in (5, 6, 7, 9)]
    got = {(r.k, r.node): r.component for r in components(spark.createDataFrame(nodes, "k int, node int"), spark.createDataFrame(edges, "k int, a int, b int"), ["k"]).collect()}
    assert got == {(1, i): 0 for i in range(n)} | {(2, 5): 5, (2, 6): 6, (2, 7): 5, (2, 9): 5}
    assert components(spark.createDataFrame([], "k int, node int"), spark.createDataFrame([], "k int, a int, b int"), ["k"]).count() == 0


def test_boxes_stand_in_few_cells(spark):
    """Boxes of up to 50 by 95 on a page: some five rows a box for both sides of the join, not over twenty."""
    rows = spark.range(2000).selectExpr("1 as doc_id", "id as place", "double(id * 7919 % 6000) as x1", "double(id * 104729 % 6000) as y1").selectExpr("*", "x1 + 1 + place % 50 as x2", "y1 + 5 + place % 90 as y2")
    assert sum(large_pages._cells(rows, 40.0, around).count() for around in (0.0, 40.0)) < 6 * 2000
