import pytest

from leafledger.llm.queries import oracle_sql, queries

from ..oracle import compare, tables

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    assert compare(spark, tables(SF), SF, name, queries()[name], oracle_sql()[name]) > 0
