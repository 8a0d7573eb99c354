import pytest
from oracle import compare

from jurispark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF)
