import pytest

from gridloom.plans.queries import QUERIES, SQL
from oracle import same

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    same(QUERIES[name](spark, SF), SQL[name], SF)
