"""Readers and writers. Every reader keeps filters and column choices pushable: nothing is cached or cast here."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parquet(spark: SparkSession, *paths: str, base_path: str | None = None) -> DataFrame:
    """Parquet files, folders or globs, of any store Spark reads (file, hdfs, s3a, ...); s3:// is read through s3a. base_path: where hive partitions begin."""
    reader = spark.read.option("basePath", _store(base_path)) if base_path else spark.read
    return reader.parquet(*map(_store, paths))


def csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True, **options: str) -> DataFrame:
    """Delimited text with a given schema; it is read once, as nothing is inferred."""
    return spark.read.options(header=header, **options).schema(schema).csv(_store(path))


def json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(_store(path))


def orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(_store(path))


def jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A table of another database; column and bounds split the read."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def values(spark: SparkSession, rows: Sequence[tuple[Any, ...]], schema: str) -> DataFrame:
    """Constant rows."""
    return spark.createDataFrame(list(rows), schema)


def one_row(spark: SparkSession) -> DataFrame:
    """One row without columns, for expressions that read no table."""
    return spark.range(1).select()


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def write(df: DataFrame, path: str, form: str = "parquet", by: Sequence[str] = (), mode: str = "errorifexists", **options: str) -> None:
    """COPY TO: one folder of files; by: hive partitions."""
    writer = df.write.mode(mode).options(**options)
    (writer.partitionBy(*by) if by else writer).format(form).save(_store(path))


def copy_ordered(df: DataFrame, path: str, keys: Sequence[str], parts: int) -> None:
    """Files that cover ranges of keys, so that scans with a filter on them skip files and row groups."""
    df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).write.parquet(_store(path))


def co_located(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table in buckets of key: joins and groupings on key don't shuffle it again."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def bytes_of(df: DataFrame) -> int:
    """The optimizer's size of a result: what broadcast decisions are checked against."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """df with a broadcast hint if its checked size allows it, else df as it is: the join is then shuffled."""
    return F.broadcast(df) if bytes_of(df) <= most else df


def arrow(df: DataFrame):
    """The result as an Arrow table."""
    return df.toArrow()


def _store(path: str) -> str:
    return f"s3a://{path[5:]}" if path.startswith("s3://") else path
