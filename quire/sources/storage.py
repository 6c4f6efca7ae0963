"""Listings of image and Markdown files, stored intermediate tables."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="quire-")


def shared_folder(spark: SparkSession) -> str:
    """The name of a new folder that the driver and all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _own_dir()
    return f"{root.rstrip('/')}/quire-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so that nothing upstream runs twice."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, column: str) -> Callable[[object], DataFrame]:
    """``df`` stored with a folder for each value of ``column``: a function from a value that it has to its rows, which reads nothing else."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.hint("rebalance", column).write.partitionBy(column).parquet(path)  # few files for a value, and large values over many tasks
    kinds = df.drop(column).schema
    return lambda value: spark.read.schema(kinds).parquet(f"{path}/{column}={value}")


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (file stem) and md of the Markdown files under ``path``."""
    files = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)\.[^./]*$", 1).alias("doc_id"), F.col("value").alias("md"))


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and filename of ``<doc>/images/<file>.png`` under ``path``, in order; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)/images/[^/]*$", 1).alias("doc_id"), F.regexp_extract("path", r"([^/]*)$", 1).alias("filename")).filter("doc_id != ''").orderBy("doc_id", "filename")
