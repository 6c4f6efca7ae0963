"""Line dedup as the pipeline has it: edits by length, and equal lines of every length that hold a word.

Held against brute force in the tests; SQL that compares all pairs of lines does not end on whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import documents
from quire.llm.line_dedup import SHARE, counted


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(documents(spark, sf_dir), short=True, share=SHARE)
