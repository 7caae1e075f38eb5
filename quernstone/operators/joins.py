"""Joins that need more than DataFrame.join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mark(probe: DataFrame, build: DataFrame, key: str, build_key: str, name: str = "mark") -> DataFrame:
    """All rows of probe and a three-valued `key IN (build)`: true if found; null if the key is null or, when not found, build holds a
    null; else false. An empty build gives false. A build key is distinct before the join, and the two facts about build are one row."""
    keys = build.select(F.col(build_key).alias("__k")).where(F.col("__k").isNotNull()).distinct().withColumn("__hit", F.lit(True))
    facts = build.agg(F.count("*").alias("__n"), F.count_if(F.col(build_key).isNull()).alias("__nulls"))  # one row
    joined = probe.join(keys, F.col(key) == F.col("__k"), "left").join(F.broadcast(facts), F.lit(True))
    value = F.when(F.col("__n") == 0, False).when(F.col("__hit"), True).when(F.col(key).isNull() | (F.col("__nulls") > 0), None).otherwise(False)
    return joined.withColumn(name, value).select(*probe.columns, name)


def not_in(probe: DataFrame, build: DataFrame, key: str, build_key: str) -> DataFrame:
    """Rows of probe for which `key NOT IN (build)` is true. Spark's own NOT IN sends all of build to the driver and to each task, however large; this shuffles it."""
    return mark(probe, build, key, build_key, "__in").where(~F.col("__in")).drop("__in")


def null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Equi-join on IS NOT DISTINCT FROM: it stays a hash or merge join."""
    on = None
    for a, b in pairs:
        one = left[a].eqNullSafe(right[b])
        on = one if on is None else on & one
    return left.join(right, on, how)


def right_semi(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    return right.join(left, on, "left_semi")


def right_anti(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    return right.join(left, on, "left_anti")


def as_of(left: DataFrame, right: DataFrame, key: str | Sequence[str], time: str, values: Sequence[str], hot: bool = False) -> DataFrame:
    """For each row of left the values of right's latest row with equal keys and no later time; null if there is none. One sort of both sides together: no
    pair of rows is formed. Of right's rows with equal keys and time the largest values count. A null key or time matches nothing.

    hot: keys of very many rows are spread: rows are dealt out by key and ranges of time, and each range is handed its keys' last values before it, a row
    a range and key. Else all rows of a key are one task's."""
    keys = [key] if isinstance(key, str) else list(key)
    kind = ",".join(f"`{v}`:{right.schema[v].dataType.simpleString()}" for v in values)
    sound = [F.col(c).isNotNull() for c in (*keys, time)]
    known = sound[0]
    for one in sound[1:]:
        known = known & one
    a = left.select("*", F.lit(1).alias("__side"), F.lit(None).cast(f"struct<{kind}>").alias("__v"))
    b = right.where(known).select(*keys, time, F.lit(0).alias("__side"), F.struct(*values).alias("__v"))
    both = a.unionByName(b, allowMissingColumns=True)
    order = [F.col(time).asc_nulls_last(), "__side", "__v"]
    if not hot:
        over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seen = both.withColumn("__v", F.last("__v", ignorenulls=True).over(over))
    else:
        ranges = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = F.when(known, F.col("__p")).otherwise(-1 - F.pmod(F.xxhash64(*keys, time), F.lit(ranges)).cast("int"))
        parted = _ranged(both, both.where(known), keys, time, ranges).withColumn("__p", dealt)
        over = Window.partitionBy("__p", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = parted.withColumn("__v", F.last("__v", ignorenulls=True).over(over))
        last = F.max(F.when(F.col("__side") == 0, F.struct(F.col(time).alias("t"), F.col("__v").alias("v"))))["v"]
        ends = parted.where(known).groupBy("__p", *keys).agg(last.alias("__last"))
        before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.withColumn("__before", F.last("__last", ignorenulls=True).over(before)).select("__p", *keys, "__before")
        seen = local.join(carried, ["__p", *keys], "left").withColumn("__v", F.coalesce("__v", "__before"))
    seen = seen.where("__side = 1").withColumn("__v", F.when(known, F.col("__v")))
    return seen.select(*[F.col(f"`{c}`") for c in left.columns], *(F.col("__v")[v].alias(f"asof_{v}" if v in left.columns else v) for v in values))


def _ranged(rows: DataFrame, known: DataFrame, keys: Sequence[str], time: str, ranges: int) -> DataFrame:
    """rows of as_of() and __p, the number of the range of times in which a row lies, of about so many of equal size. The ends of ranges are those of the known rows of least
    hash: each branch of a plan that works them out finds the same ones, while partition ids, and bounds sampled by a shuffle, differ from branch to branch."""
    sample = known.orderBy(F.xxhash64(*keys, time, "__side", "__v"), time).limit(8 * ranges).agg(F.sort_array(F.collect_list(time)).alias("x"))
    ends = sample.select(F.filter("x", lambda _, i: i % 8 == 7).alias("x"))
    spans = ends.select(F.inline(F.transform(F.sequence(F.lit(0), F.size("x")), lambda i: F.struct(i.alias("__p"), F.get("x", i - 1).alias("__from"), F.get("x", i).alias("__to")))))
    inside = (F.col("__from").isNull() | (F.col("__from") <= F.col(time))) & (F.col("__to").isNull() | (F.col(time) < F.col("__to")))
    return rows.join(F.broadcast(spans), inside, "left").drop("__from", "__to")  # a row for each range


def in_range(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points within [start, end) of numeric ranges: both sides are cut into bins of width and joined on the bin, so that it is an equi-join. A
    range is repeated once for each bin that it touches."""
    left = points.withColumn("__bin", F.floor(F.col(at) / width))
    right = ranges.where(F.col(start) < F.col(end)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1e-9) / width))))
    return left.join(right, "__bin").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__bin")


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Row numbers from 1 in an order, without gathering all rows in one task: range-partitioned, numbered within partitions, and shifted by the counts before."""
    parted = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    local = parted.withColumn(name, F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    counts = local.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    return local.join(F.broadcast(before.select("__p", "__b")), "__p").withColumn(name, (F.col(name) + F.col("__b")).cast("bigint")).drop("__p", "__b")


def positional(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """The n-th row of either side, in their orders; the shorter side is filled up with nulls."""
    a, b = numbered(left, left_order, "__i"), numbered(right, right_order, "__i")
    return a.join(b, "__i", "full").drop("__i")


def counted(left: DataFrame, right: DataFrame, key: str, right_key: str, value: str | None = None, name: str = "n", group: str | None = None) -> DataFrame:
    """count(*) or count(value) by the key of left over a left join. Both sides are counted by key before they meet: P * max(M, 1) rows, or P * V values."""
    group = group or key
    p = left.groupBy(F.col(group)).agg(F.count("*").alias("__p")) if group == key else left.groupBy(group, key).agg(F.count("*").alias("__p"))
    what = F.count("*") if value is None else F.count(value)
    m = right.where(F.col(right_key).isNotNull()).groupBy(F.col(right_key).alias("__k")).agg(what.alias("__m"))
    joined = p.join(m, p[key] == m["__k"], "left")
    many = F.greatest(F.coalesce("__m", F.lit(0)), F.lit(1)) if value is None else F.coalesce("__m", F.lit(0))
    return joined.groupBy(group).agg(F.sum(F.col("__p") * many).cast("bigint").alias(name)) if group != key else joined.select(group, (F.col("__p") * many).cast("bigint").alias(name))


def salted(left: DataFrame, right: DataFrame, key: str, salts: int, how: str = "inner", share: float = 0.01) -> DataFrame:
    """An equi-join, inner or left, whose hot keys are spread: rows of left with a key that share of left's rows or more have get one of salts numbers, and
    right's rows with such a key all of them. There are 1 / share hot keys at most; other rows are neither numbered nor repeated."""
    counts = left.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n"))
    hot = counts.where(F.col("__n") >= F.lit(max(1.0, share * left.count()))).select("__k")
    hot = F.broadcast(hot.withColumn("__hot", F.lit(True)))  # at most 1 / share rows
    zero = F.lit(0).cast("bigint")
    a = left.join(hot, F.col(key) == F.col("__k"), "left").withColumn("__s", F.when(F.col("__hot"), F.pmod(F.xxhash64(*left.columns), F.lit(salts))).otherwise(zero)).drop("__k", "__hot")
    last = F.when(F.col("__hot"), F.lit(salts - 1).cast("bigint")).otherwise(zero)
    b = right.join(hot, F.col(key) == F.col("__k"), "left").withColumn("__s", F.explode(F.sequence(zero, last))).drop("__k", "__hot")
    return a.join(b, [key, "__s"], how).drop("__s")


def anti_where(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Rows of left for which no row of right makes any condition true, inequalities too."""
    return left.join(right, on, "left_anti")


def mark_where(left: DataFrame, right: DataFrame, a: str, op: str, b: str, name: str = "mark") -> DataFrame:
    """All rows of left and a three-valued `a op ANY (SELECT b FROM right)` for an inequality op: only the least or the greatest b matters, so right is one row."""
    if op not in ("<", "<=", ">", ">="):
        raise ValueError("op must be an inequality")
    best = F.max(b) if op.startswith("<") else F.min(b)
    facts = right.agg(best.alias("__b"), F.count("*").alias("__n"), F.count_if(F.col(b).isNull()).alias("__nulls"))  # one row
    joined = left.join(F.broadcast(facts), F.lit(True))
    hit = F.coalesce(F.expr(f"`{a}` {op} __b"), F.lit(False))
    value = F.when(F.col("__n") == 0, False).when(hit, True).when(F.col(a).isNull() | (F.col("__nulls") > 0), None).otherwise(False)
    return joined.withColumn(name, value).select(*left.columns, name)
