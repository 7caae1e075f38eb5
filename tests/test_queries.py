"""Every query against its SQL on DuckDB."""

import pytest

from quernstone.plans import registry
from tests.differential import differences, oracle


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert differences(spark, con, registry.QUERIES[name], registry.SQL[name], sf_dir) == []


def test_sample_is_stable_and_of_its_size(spark, sf_dir):
    q = registry.QUERIES["o07_sample"]
    a, b = (sorted(r.o_orderkey for r in q(spark, sf_dir).collect()) for _ in range(2))
    assert a == b
    assert 80 <= len(a) <= 240  # a tenth of 1,500


def test_driver_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
