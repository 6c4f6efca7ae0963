import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_rows import ODD, rows  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    return rows(spark, ODD)


@pytest.fixture(scope="session")
def none(spark):
    return rows(spark, [])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
