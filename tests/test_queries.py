import oracle
import pytest

from tessera.file_queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE_SQL:
        assert oracle.differences(df, ORACLE_SQL[name], sf_dir) == ""
    else:
        assert df.count() > 0
