"""Where queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.engine import Engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir), with the same result as SQL for the oracle if it has one."""

    def keep(f: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def text(name: str, sql: str, oracle: str | None = None) -> None:
    """Registers a query that is SQL itself. oracle: its text for the oracle, if the dialects differ."""
    query(name, oracle or sql)(lambda spark, sf_dir: Engine(spark, sf_dir).sql(sql))
