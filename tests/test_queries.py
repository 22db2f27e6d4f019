import pytest

from leafledger.plans.queries import QUERIES, SQL

from .oracle import compare, tables

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        n = compare(spark, con, SF, name, QUERIES[name], SQL[name])
        assert n > 0 or name in ("match_deep",)
    else:
        assert QUERIES[name](spark, SF).count() > 0
