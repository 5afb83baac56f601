import pytest

from forumetry.llm import queries

from ..oracle import same


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name], spark, sf)
