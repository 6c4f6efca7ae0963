import pytest
from compare import SF, duck_rows, spark_rows

from quire import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_spark_equals_sql(spark, duck, name):
    assert spark_rows(catalog.queries()[name](spark, SF)) == duck_rows(duck, catalog.oracle_sql()[name])
