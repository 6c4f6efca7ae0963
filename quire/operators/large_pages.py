"""Clusters of figure boxes as rows, for pages with far more boxes than an array expression can compare.

A page's plane is cut into square cells some gaps wide, so that a box stands in few.  A box stands in the cells that it covers,
and is looked for in the cells that it covers with the gap around it, so two boxes that are near meet
by an equi-join on the cell; the cell that holds the corner of what they share there is the one that
reports them, so a pair is compared and told once.  Pairs that are near are edges of a graph whose
components are the clusters.  The result is that of ``boxes.clustered`` on the page's array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import boxes
from quire.operators.components import components

#: descriptions of members that a cluster keeps
TOLD = 3
#: gaps that a cell is wide: rows that are shuffled fall with it, boxes compared in a cell rise
CELL = 4


def _cells(rows: DataFrame, gap: float, around: float) -> DataFrame:
    """``rows`` for each cell (cx, cy) that their boxes cover with ``around`` on all sides."""
    of = lambda c: F.floor(c / (CELL * gap))
    span = lambda low, high: F.sequence(of(F.col(low) - around), of(F.col(high) + around))
    return rows.withColumn("cx", F.explode(span("x1", "x2"))).withColumn("cy", F.explode(span("y1", "y2")))


def near_pairs(rows: DataFrame, key: list[str], gap: float = 40.0) -> DataFrame:
    """``key``, a, b: places of boxes (key, place, x1, y1, x2, y2) that are near each other, the smaller place first."""
    plain = rows.select(*key, "place", *boxes.SIDES)
    one = _cells(plain, gap, 0.0).select(*key, "cx", "cy", F.col("place").alias("a"), F.struct(*boxes.SIDES).alias("one"))
    two = _cells(plain, gap, gap).select(*key, "cx", "cy", F.col("place").alias("b"), F.struct(*boxes.SIDES).alias("two"))
    corner = lambda side: F.floor(F.greatest(F.col(f"one.{side}"), F.col(f"two.{side}") - gap) / (CELL * gap))
    met = one.join(two, [*key, "cx", "cy"]).filter((F.col("a") < F.col("b")) & (F.col("cx") == corner("x1")) & (F.col("cy") == corner("y1")))
    return met.filter(boxes.is_near(F.col("one"), F.col("two"), gap)).select(*key, "a", "b")


def clustered(rows: DataFrame, key: list[str], gap: float = 40.0) -> DataFrame:
    """``key``, place (of the first member), x1, y1, x2, y2, desc: an enclosing box for each cluster of ``rows``.

    ``rows``: key, place, x1, y1, x2, y2, desc; places are distinct within a key.  Boxes that lie alone
    stay as they are.  Null descriptions count as empty, and rows with a null side lie alone.
    """
    whole = rows.select(*key, "place", *boxes.SIDES, F.coalesce("desc", F.lit("")).alias("desc"))
    labels = components(whole.select(*key, F.col("place").alias("node")), near_pairs(whole.dropna(subset=list(boxes.SIDES)), key, gap), key)
    members = whole.join(labels.withColumnRenamed("node", "place"), [*key, "place"])
    cluster = [*key, "component"]
    some = members.filter("desc != ''").withColumn("rank", F.row_number().over(W.partitionBy(*cluster).orderBy("place"))).filter(F.col("rank") <= TOLD)
    told = some.groupBy(*cluster).agg(F.array_sort(F.collect_list(F.struct("place", "desc"))).alias("told"))  # three a cluster
    side = lambda s, of: of(s).alias(s)
    whole = members.groupBy(*cluster).agg(side("x1", F.min), side("y1", F.min), side("x2", F.max), side("y2", F.max))
    desc: Column = F.coalesce(F.array_join(F.transform("told", lambda t: t["desc"]), "; "), F.lit(""))
    return whole.join(told, cluster, "left").select(*key, F.col("component").alias("place"), *boxes.SIDES, desc.alias("desc"))
