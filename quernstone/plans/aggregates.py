"""Aggregates, grouping sets and DISTINCT."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.engine import Engine
from quernstone.functions import parity as P
from quernstone.operators import joins, ordering
from quernstone.session import table

from .base import query, text

G = "(VALUES (1, 5, 1.5), (1, CAST(NULL AS INT), 2.5), (CAST(NULL AS INT), 7, 3.5), (CAST(NULL AS INT), 7, CAST(NULL AS DECIMAL(2,1))), (2, CAST(NULL AS INT), CAST(NULL AS DECIMAL(2,1)))) AS t(g, v, d)"

text("a01_ungrouped", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS q, min(l_shipdate) AS lo, max(l_shipdate) AS hi, round(avg(l_tax), 6) AS a FROM lineitem")
text("a02_grouped", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus")
text("a03_null_keys", f"SELECT g, count(*) AS n, count(v) AS c, CAST(sum(v) AS BIGINT) AS s, min(v) AS lo, max(v) AS hi FROM {G} GROUP BY g")


@query("a04_sum_types", "SELECT CAST(sum(p_size) AS BIGINT) AS i, CAST(sum(CAST(p_retailprice AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS d, CAST(sum(p_partkey) AS BIGINT) AS b FROM part")
def _sums(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.agg(P.total(p.p_size).alias("i"), F.sum(p.p_retailprice.cast("decimal(15,2)")).cast("decimal(38,2)").alias("d"), P.total(p.p_partkey).alias("b"))


text("a05_counts", f"SELECT count(*) AS n, count(v) AS c, count(g) AS k FROM {G}")
text("a06_min_max", "SELECT o_orderpriority, min(o_orderdate) AS lo, max(o_orderstatus) AS hi, min(o_totalprice) AS cheap FROM orders GROUP BY o_orderpriority")


@query("a07_avg", "SELECT p_brand, round(avg(CAST(p_retailprice AS DECIMAL(15,2))), 6) AS d, round(avg(p_size), 6) AS i FROM part GROUP BY p_brand")
def _averages(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.groupBy("p_brand").agg(F.round(P.mean(p.p_retailprice.cast("decimal(15,2)")), 6).alias("d"), F.round(P.mean(p.p_size), 6).alias("i"))


text("a08_first", "SELECT min_by(c_name, c_custkey) AS first_name, max_by(c_name, c_custkey) AS last_name FROM customer")
text("a09_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p FROM lineitem GROUP BY l_returnflag")


@query("a10_count_tuples", f"SELECT count(DISTINCT (g, v)) AS n FROM {G}")
def _tuples(spark, sf_dir):
    return spark.sql(f"SELECT * FROM {G}").agg(P.count_tuples(F.col("g"), F.col("v")).alias("n"))


text("a11_count_distinct_all", "SELECT count(DISTINCT l_partkey) AS p, count(DISTINCT l_shipdate) AS d FROM lineitem")
text("a12_sum_distinct", "SELECT p_type, CAST(sum(DISTINCT p_size) AS BIGINT) AS s, round(avg(DISTINCT p_size), 6) AS a FROM part GROUP BY p_type")
text("a13_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (WHERE o_orderstatus <> 'F'), 2) AS s FROM orders GROUP BY o_orderpriority")
text("a14_ordered_aggregates", "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names, max_by(n_name, n_nationkey) AS last_one FROM nation GROUP BY n_regionkey",
     "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, arg_max(n_name, n_nationkey) AS last_one FROM nation GROUP BY n_regionkey")
text("a15_rollup", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_linestatus) AS BIGINT) AS g, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
text("a15_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
text("a15_grouping_sets", "SELECT p_brand, p_type, count(*) AS n, CAST(max(p_size) AS INT) AS m FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())")
text("a17_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
text("a18_distinct", "SELECT DISTINCT p_brand, p_type FROM part")


@query("a18_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice, o_orderkey")
def _distinct_on(spark, sf_dir):
    return ordering.distinct_on(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey")


@query("a18_distinct_on_descending", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def _distinct_on_descending(spark, sf_dir):
    return ordering.distinct_on(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "-o_totalprice", "o_orderkey").drop("o_totalprice")


text("a20_statistics", """SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, median(l_quantity) AS md, round(corr(l_quantity, l_extendedprice), 6) AS c,
 round(covar_pop(l_quantity, l_extendedprice), 2) AS cv FROM lineitem GROUP BY l_returnflag""")
text("a20_quantiles", "SELECT event_type, round(percentile(value, 0.25), 6) AS q1, round(percentile(value, 0.9), 6) AS q9 FROM events GROUP BY event_type",
     "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.9), 6) AS q9 FROM events GROUP BY event_type")
text("a20_booleans", "SELECT p_type, bool_and(p_size > 0) AS a, bool_or(p_size > 49) AS o, CAST(count_if(p_size > 25) AS BIGINT) AS n, bit_and(p_size) AS b FROM part GROUP BY p_type")
text("a08_first_value", "SELECT first(x) AS f, any_value(y) AS a FROM (SELECT 7 AS x, 'z' AS y FROM nation) t")


@query("a20_approximate_distinct", "SELECT abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.1 * count(DISTINCT l_partkey) AS near FROM lineitem")
def _approximate_distinct(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").select("l_partkey")
    about = keys.agg(P.approximate_count(F.col("l_partkey")).alias("a"))  # apart from the exact count, which would hold a sketch for each key
    exact = keys.agg(F.count_distinct("l_partkey").alias("n"))
    return about.crossJoin(exact).select((F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).alias("near"))


text("a20_lists", "SELECT n_regionkey, array_join(sort_array(collect_list(n_nationkey)), ',') AS l, array_join(sort_array(collect_set(n_nationkey % 3)), ',') AS s FROM nation GROUP BY n_regionkey",
     "SELECT n_regionkey, array_to_string(list_sort(list(n_nationkey)), ',') AS l, array_to_string(list_sort(list(DISTINCT n_nationkey % 3)), ',') AS s FROM nation GROUP BY n_regionkey")
text("a20_mode", "SELECT mode(k) AS m FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'often' ELSE p_name END AS k FROM part) t")
text("a20_discrete_quantile", "SELECT p_type, percentile_disc(0.5) WITHIN GROUP (ORDER BY p_size) AS q FROM part GROUP BY p_type", "SELECT p_type, CAST(quantile_disc(p_size, 0.5) AS DOUBLE) AS q FROM part GROUP BY p_type")
text("a20_shapes", "SELECT l_returnflag, round(skewness(l_extendedprice), 6) AS s FROM lineitem GROUP BY l_returnflag",
     "SELECT l_returnflag, round(skewness(l_extendedprice) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)), 6) AS s FROM lineitem GROUP BY l_returnflag")
text("a20_histogram", "SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY event_type, bin", "SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY ALL")

# tables with nulls in keys and measures, and types that reach beyond 64 bits
NULLED = """(SELECT l_orderkey, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_partkey END AS pk, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_suppkey END AS sk,
 CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS q, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(15,2)) END AS d FROM lineitem) AS t"""
text("n01_null_groups", f"SELECT sk, count(*) AS n, count(q) AS c, round(sum(q), 2) AS s, round(avg(q), 6) AS a, min(q) AS lo, count(DISTINCT pk) AS p FROM {NULLED} GROUP BY sk")
text("n02_null_keys_join", f"SELECT s_suppkey, count(pk) AS n FROM supplier LEFT JOIN {NULLED} ON sk = s_suppkey AND q > 10 GROUP BY s_suppkey")
text("n03_null_filters", f"SELECT count(*) AS n FROM {NULLED} WHERE (q > 20 OR d IS NULL) AND NOT (sk < 50 AND q <= 30) AND coalesce(pk, 7) <> 7")


for _name, _where in (("n04_null_not_in", " WHERE q > 49 AND pk IS NOT NULL"), ("n05_null_not_in_null", "")):

    @query(_name, f"SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT pk FROM {NULLED}{_where})")
    def _null_not_in(spark, sf_dir, where=_where):
        keys = Engine(spark, sf_dir).sql(f"SELECT pk FROM {NULLED}{where}")
        return joins.not_in(table(spark, sf_dir, "part").select("p_partkey"), keys, "p_partkey", "pk")


text("n06_null_safe_self", f"SELECT count(*) AS n FROM (SELECT sk, count(*) AS n FROM {NULLED} GROUP BY sk) a JOIN (SELECT s_suppkey AS k FROM supplier UNION ALL SELECT NULL) b ON a.sk IS NOT DISTINCT FROM b.k")
text("n07_wide_decimals", f"SELECT pk % 10 AS k, CAST(sum(d * d) AS DECIMAL(38,4)) AS s, max(d) AS m FROM {NULLED} GROUP BY pk % 10")
text("n08_large_integers", """SELECT k, CAST(sum(u) AS STRING) AS s, CAST(max(u) AS STRING) AS m FROM (SELECT o_orderkey % 3 AS k, CAST(18446744073709551615 AS DECIMAL(20,0)) - o_orderkey AS u FROM orders) t GROUP BY k""",
     """SELECT k, CAST(sum(u) AS VARCHAR) AS s, CAST(max(u) AS VARCHAR) AS m FROM (SELECT o_orderkey % 3 AS k, CAST(18446744073709551615 AS DECIMAL(20,0)) - o_orderkey AS u FROM orders) t GROUP BY k""")
text("n09_struct_keys", "SELECT k.a AS a, k.b AS b, count(*) AS n FROM (SELECT named_struct('a', n_regionkey, 'b', CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE 'odd' END) AS k FROM nation) t GROUP BY k",
     "SELECT k.a AS a, k.b AS b, count(*) AS n FROM (SELECT {'a': n_regionkey, 'b': CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE 'odd' END} AS k FROM nation) t GROUP BY k")
text("n10_windows_over_nulls", f"SELECT l_orderkey, count(q) OVER (PARTITION BY sk) AS c, rank() OVER (PARTITION BY l_orderkey ORDER BY q DESC NULLS LAST, d NULLS FIRST) * CAST(1 AS BIGINT) AS r FROM {NULLED}")
