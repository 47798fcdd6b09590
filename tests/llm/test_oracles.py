import pytest

from weftline.llm import registry

from ..oracle import assert_same, connect


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert_same(registry.queries()[name](spark, sf_dir), connect(sf_dir), registry.oracle_sql()[name])


def test_one_query_for_each_operator():
    names = set(registry.queries())
    assert {n.split("_")[0] for n in names - {"pipeline"}} == {f"op{n}" for n in range(1, 14)}
