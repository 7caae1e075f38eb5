"""Sorts, limits, samples and choices of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keys(*names: str) -> list[Column]:
    """Sort keys, "-name" descending; nulls come last either way."""
    return [F.desc_nulls_last(n[1:]) if n.startswith("-") else F.asc_nulls_last(n) for n in names]


def top_n(df: DataFrame, n: int, *names: str, offset: int = 0) -> DataFrame:
    """The first n rows after offset: each task keeps n + offset rows, and these are merged."""
    out = df.orderBy(*keys(*names))
    return (out.offset(offset) if offset else out).limit(n)


def limit_percent(df: DataFrame, percent: float, *names: str) -> DataFrame:
    """LIMIT n%: of the counted rows, rounded down. Rows are numbered range by range, so that no task gathers the share; they come out in order."""
    order = keys(*names)
    parted = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    local = parted.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    counts = local.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    return local.join(F.broadcast(before.select("__p", "__b")), "__p").where(F.col("__i") + F.col("__b") <= int(df.count() * percent / 100)).orderBy(*order).select(*df.columns)


def distinct_on(df: DataFrame, by: Sequence[str], *order: str) -> DataFrame:
    """DISTINCT ON: the first row of each group in an order. Groups are reduced before they are shuffled."""
    rest = [c for c in df.columns if c not in by]
    ranked = [F.struct(F.col(n.lstrip("-")).isNull().cast("int").alias("z"), F.col(n.lstrip("-")).alias("v")) for n in order]
    if any(n.startswith("-") for n in order):
        return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*keys(*order)))).where("__r = 1").drop("__r")
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*ranked)).alias("__x")).select(*by, "__x.*").select(*df.columns)


def top_per_group(df: DataFrame, by: Sequence[str], n: int, *order: str) -> DataFrame:
    """The first n rows of each group; the optimizer cuts groups to n rows before it shuffles them."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*keys(*order)))).where(F.col("rank") <= n)


def sample(df: DataFrame, share: float, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """TABLESAMPLE of a share of the rows. by: columns whose hash decides, so that the same rows are chosen wherever they lie."""
    if not by:
        return df.sample(share, seed)
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by]))
    return df.where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") < int(share * (1 << 32)))
