"""The queries that SQL can express against DuckDB."""

import pytest

from quernstone.llm import common, queries
from tests.differential import differences, oracle


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert differences(spark, oracle(sf_dir), queries.QUERIES[name], queries.SQL[name], sf_dir) == []


def test_forget(spark):
    df = common.materialise(spark.range(3), "t")
    assert df.count() == 3
    common.forget(spark)
    with pytest.raises(Exception, match="(?i)not exist|not found|cannot"):
        spark.read.parquet(df.inputFiles()[0]).count()
