import pytest

from tessera.llm import registry
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    assert compare(spark, sf, registry.queries()[name], registry.oracle_sql()[name]) > 0
