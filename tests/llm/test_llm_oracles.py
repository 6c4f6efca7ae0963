import pytest
from compare import SF, duck_rows, spark_rows

from quire import llm


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_spark_equals_sql(spark, duck, name):
    assert spark_rows(llm.queries()[name](spark, SF)) == duck_rows(duck, llm.oracle_sql()[name])
