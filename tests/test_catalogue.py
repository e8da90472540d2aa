import os

import pytest

from tarn.plans import catalogue
from tests.oracle import rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_rows_equal_those_of_the_sql(spark, name):
    assert rows_of_spark(catalogue.QUERIES[name](spark, SF)) == rows_of_sql(catalogue.SQL[name], SF)
