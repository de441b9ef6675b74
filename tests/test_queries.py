import pytest

from docsieve.plans import queries, sql
from tests.duck import assert_same


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    if name in sql.ORACLE:
        assert_same(df, sql.ORACLE[name], sf)
    else:
        assert df.count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())
