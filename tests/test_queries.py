import pytest

from tessera import registry
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, name):
    compare(spark, "/root/testdata/sf0.01", registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = registry.queries()[name](spark, "/root/testdata/sf0.01")
    rows = df.collect()
    assert len({tuple(r) for r in rows}) == len(rows) and all(len(r) == len(df.columns) for r in rows)


def test_flagship_has_every_repository(spark):
    assert registry.flagship(spark, "/root/testdata/sf0.001").count() == 20
