import pytest

from helpers import spark_rows, sql_rows
from postlake.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == sql_rows(SQL[name], SF)
