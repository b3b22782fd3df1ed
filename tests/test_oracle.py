import pytest

from lakeleaf.plans import cases, registry  # noqa: F401
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, name):
    assert_same(spark, name, registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    rows = df.collect()
    assert len(df.columns) == len(set(df.columns))
    assert rows or name in ("topic_lookup", "heading_pin")


@pytest.mark.parametrize("name", sorted(registry.CASES))
def test_cases_equal_sql(spark, name):
    assert_same(spark, name, registry.CASES[name], registry.CASES_SQL[name])
