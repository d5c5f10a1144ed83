import oracle
import pytest

from tessera.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf_dir, name):
    assert oracle.differences(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir) == ""
