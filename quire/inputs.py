"""Inputs that give the document operators something to do, from the tables at hand, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: the same inputs as common table expressions
LINES_SQL = """
raw_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
lines_fx AS (
  SELECT doc_id, i, CASE (doc_id + i) % 11
    WHEN 0 THEN '## ' || line WHEN 4 THEN '- ' || line WHEN 7 THEN '| ' || doc_id || ' | ' || i || ' |'
    WHEN 9 THEN '![](images/page' || i || '_fig1.png)'
    ELSE left(line, greatest(length(line) - 5 * ((doc_id + i) % 3), 0)) END AS m FROM raw_lines)"""
PAGES_SQL = (
    LINES_SQL
    + """,
page_lines AS (
  SELECT doc_id, i // 4 AS page_num, i, m FROM lines_fx UNION ALL
  SELECT doc_id, i // 4 - 1, i, m FROM lines_fx WHERE i > 0 AND i % 4 = 0),
pages_fx AS (SELECT doc_id, page_num, string_agg(m, chr(10) ORDER BY i) AS md FROM page_lines GROUP BY doc_id, page_num)"""
)
FIGURES_SQL = """
figure_rows AS (
  SELECT l_orderkey AS doc_id, l_linenumber, (l_partkey * 7) % 300 AS a, (l_suppkey * 13) % 300 AS b, CAST(l_quantity AS BIGINT) * 3 AS w, (l_partkey % 37) * 4 AS h FROM lineitem),
figures_fx AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY l_linenumber, a, b, a + 20 + w, b + 20 + h) AS fig_idx,
    CAST(a AS DOUBLE) AS x1, CAST(b AS DOUBLE) AS y1, CAST(a + 20 + w AS DOUBLE) AS x2, CAST(b + 20 + h AS DOUBLE) AS y2 FROM figure_rows)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    k = (F.col("doc_id") + F.col("i")) % 11
    cut = F.left("line", F.greatest(F.char_length("line") - 5 * ((F.col("doc_id") + F.col("i")) % 3), F.lit(0)).cast("int"))
    number = F.col("i").cast("string")
    m = (
        F.when(k == 0, F.concat(F.lit("## "), "line"))
        .when(k == 4, F.concat(F.lit("- "), "line"))
        .when(k == 7, F.concat(F.lit("| "), F.col("doc_id").cast("string"), F.lit(" | "), number, F.lit(" |")))
        .when(k == 9, F.concat(F.lit("![](images/page"), number, F.lit("_fig1.png)")))
        .otherwise(cut)
    )
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), m.alias("m"))


def pages_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_num, md: four lines a page and the first of the next."""
    rows = lines_fx(spark, sf_dir)
    page = F.floor(F.col("i") / 4)
    both = rows.select("doc_id", page.alias("page_num"), "i", "m").unionByName(rows.filter("i > 0 and i % 4 = 0").select("doc_id", (page - 1).alias("page_num"), "i", "m"))
    return both.groupBy("doc_id", "page_num").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]), "\n").alias("md"))


def figure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fig_idx (from 1), x1..y2."""
    from pyspark.sql import Window as W

    a, b = (F.col("l_partkey") * 7) % 300, (F.col("l_suppkey") * 13) % 300
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", a.cast("double").alias("x1"), b.cast("double").alias("y1"), (a + 20 + F.col("l_quantity").cast("long") * 3).cast("double").alias("x2"), (b + 20 + (F.col("l_partkey") % 37) * 4).cast("double").alias("y2"))
    order = W.partitionBy("doc_id").orderBy("l_linenumber", "x1", "y1", "x2", "y2")
    return rows.select("doc_id", F.row_number().over(order).cast("long").alias("fig_idx"), "x1", "y1", "x2", "y2")


def figures_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, figures: the boxes of an order as one page's figures."""
    rows = figure_rows(spark, sf_dir).withColumn("f", F.struct("fig_idx", "x1", "y1", "x2", "y2", F.concat(F.lit("f"), F.col("fig_idx").cast("string")).alias("desc")))
    figure = lambda f: F.struct(*(f[c].alias(c) for c in ("x1", "y1", "x2", "y2", "desc")))
    return rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("f")), figure).alias("figures"))
