import pytest
from oracle import compare

from jurispark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
