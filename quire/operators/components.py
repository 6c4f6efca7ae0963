"""Connected components of graphs given as rows, by an iterated join: one helper for every recursive grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.storage import stored


def components(nodes: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """``key``, node, component: the least node that can be reached.

    ``nodes``: key and node; ``edges``: key, a and b (either way round, repeats allowed; both ends are
    nodes of the key).  In each round a node takes the least component of itself and its neighbours and
    then its component's own, so distances halve and a chain of n nodes takes about log n rounds.  Every
    round is stored; a node without edges is its own component; null ends join nothing.
    """
    both = stored(edges.select(*key, "a", "b").unionByName(edges.select(*key, F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct())
    now = stored(nodes.select(*key, "node").distinct().withColumn("component", F.col("node")))
    while True:
        told = both.withColumnRenamed("b", "node").join(now, [*key, "node"]).select(*key, F.col("a").alias("node"), "component")
        least = now.unionByName(told).groupBy(*key, "node").agg(F.min("component").alias("component"))
        further = now.select(*key, F.col("node").alias("component"), F.col("component").alias("further"))
        new = stored(least.join(further, [*key, "component"]).select(*key, "node", F.col("further").alias("component")))
        old = now.withColumnRenamed("component", "before")
        if new.join(old, [*key, "node"]).filter("component != before").isEmpty():
            return new
        now = new
