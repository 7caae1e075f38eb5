"""Joins of every kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import joins
from quernstone.session import table

from .base import query, text

L = "(VALUES (1, 10), (2, 20), (3, CAST(NULL AS INT)), (4, 30), (5, 10)) AS l(id, k)"
R = "(VALUES (1, 10), (2, 20), (3, 20), (4, CAST(NULL AS INT)), (5, 40)) AS r(rid, rk)"
NONE = "(SELECT * FROM (VALUES (1, 10)) AS e(rid, rk) WHERE rid < 0) AS r"

for _kind in ("INNER", "LEFT", "RIGHT", "FULL"):
    text(f"j01_{_kind.lower()}", f"SELECT id, k, rid, rk FROM {L} {_kind} JOIN {R} ON k = rk")
    text(f"j01_{_kind.lower()}_empty", f"SELECT id, k, rid, rk FROM {L} {_kind} JOIN {NONE} ON k = rk")
    text(f"j04_{_kind.lower()}_null_safe", f"SELECT id, k, rid, rk FROM {L} {_kind} JOIN {R} ON k IS NOT DISTINCT FROM rk")
    text(f"j05_{_kind.lower()}_mixed", f"SELECT id, k, rid, rk FROM {L} {_kind} JOIN {R} ON k = rk AND id < rid")
text("j01_orders_customers", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
text("j02_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000", "SELECT c_custkey FROM customer SEMI JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey")
text("j02_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
text("j02_semi_nulls", f"SELECT id FROM {L} WHERE EXISTS (SELECT 1 FROM {R} WHERE rk = k)")
text("j02_anti_nulls", f"SELECT id FROM {L} WHERE NOT EXISTS (SELECT 1 FROM {R} WHERE rk = k)")


@query("j02_right_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _right_semi(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), table(spark, sf_dir, "customer")
    return joins.right_semi(o, c, o.o_custkey == c.c_custkey).select("c_custkey", "c_name")


@query("j02_right_anti", "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)")
def _right_anti(spark, sf_dir):
    li, s = table(spark, sf_dir, "lineitem").where("l_quantity > 49"), table(spark, sf_dir, "supplier")
    return joins.right_anti(li, s, li.l_suppkey == s.s_suppkey).select("s_suppkey")


@query("j03_mark", f"SELECT id, k, k IN (SELECT rk FROM {R}) AS mark FROM {L}")
def _mark(spark, sf_dir):
    return joins.mark(spark.sql(f"SELECT * FROM {L}"), spark.sql(f"SELECT * FROM {R}"), "k", "rk")


@query("j03_mark_no_nulls", f"SELECT id, k, k IN (SELECT rk FROM {R} WHERE rk IS NOT NULL) AS mark FROM {L}")
def _mark_no_nulls(spark, sf_dir):
    return joins.mark(spark.sql(f"SELECT * FROM {L}"), spark.sql(f"SELECT * FROM {R} WHERE rk IS NOT NULL"), "k", "rk")


@query("j03_mark_empty", f"SELECT id, k, k IN (SELECT rk FROM {NONE}) AS mark FROM {L}")
def _mark_empty(spark, sf_dir):
    return joins.mark(spark.sql(f"SELECT * FROM {L}"), spark.sql(f"SELECT * FROM {NONE}"), "k", "rk")


@query("j03_mark_customers", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS mark FROM customer")
def _mark_customers(spark, sf_dir):
    return joins.mark(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").where("o_totalprice > 400000"), "c_custkey", "o_custkey")


@query("j04_null_safe_pairs", f"SELECT id, rid FROM {L} JOIN {R} ON k IS NOT DISTINCT FROM rk AND id = rid")
def _null_safe(spark, sf_dir):
    return joins.null_safe(spark.sql(f"SELECT * FROM {L}"), spark.sql(f"SELECT * FROM {R}"), [("k", "rk"), ("id", "rid")]).select("id", "rid")


text("j06_expression_keys", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_custkey % 50 = s_suppkey + 1 AND upper(c_mktsegment) = 'BUILDING'")
text("j07_inequality", "SELECT n1.n_nationkey AS a, n2.n_nationkey AS b FROM nation n1 JOIN nation n2 ON n1.n_nationkey < n2.n_nationkey AND n1.n_regionkey > n2.n_regionkey")
for _kind in ("LEFT", "RIGHT", "FULL"):
    text(f"j07_inequality_{_kind.lower()}", f"SELECT id, k, rid, rk FROM {L} {_kind} JOIN {R} ON k > rk")
text("j07_inequality_semi", f"SELECT id FROM {L} WHERE EXISTS (SELECT 1 FROM {R} WHERE rk > k)")


@query("j07_inequality_anti", f"SELECT id FROM {L} WHERE NOT EXISTS (SELECT 1 FROM {R} WHERE rk > k)")
def _inequality_anti(spark, sf_dir):
    return joins.anti_where(spark.sql(f"SELECT * FROM {L}"), spark.sql(f"SELECT * FROM {R}"), F.col("rk") > F.col("k")).select("id")


for _name, _op in (("below", "<"), ("above", ">=")):

    @query(f"j07_inequality_mark_{_name}", f"SELECT id, k, k {_op} ANY (SELECT rk FROM {R}) AS mark FROM {L}")
    def _inequality_mark(spark, sf_dir, op=_op):
        return joins.mark_where(spark.sql(f"SELECT * FROM {L}"), spark.sql(f"SELECT * FROM {R}"), "k", op, "rk")

    @query(f"j07_inequality_mark_{_name}_no_nulls", f"SELECT id, k, k {_op} ANY (SELECT rk FROM {R} WHERE rk IS NOT NULL) AS mark FROM {L}")
    def _inequality_mark_no_nulls(spark, sf_dir, op=_op):
        return joins.mark_where(spark.sql(f"SELECT * FROM {L}"), spark.sql(f"SELECT * FROM {R} WHERE rk IS NOT NULL"), "k", op, "rk")


text("j08_single", "SELECT o_orderkey, (SELECT c_name FROM customer WHERE c_custkey = o_custkey) AS name FROM orders")
text("j09_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")


@query("j10_asof", """SELECT e.event_id, o.o_orderkey FROM events e ASOF LEFT JOIN
 (SELECT o_custkey, o_orderdate + INTERVAL 8 YEAR AS at, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON e.user_id = o.o_custkey AND e.ts >= o.at""")
def _asof(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.expr("o_orderdate + INTERVAL 8 YEAR").alias("ts"), "o_orderkey")
    return joins.as_of(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), o, "user_id", "ts", ["o_orderkey"]).select("event_id", "o_orderkey")


LT = "(VALUES (1, 1, 5), (2, 1, CAST(NULL AS INT)), (3, CAST(NULL AS INT), 5), (4, 2, 1), (5, 1, 9), (6, 3, 3)) AS l(id, k, t)"
RT = "(VALUES (1, 5, 7), (1, 6, 8), (CAST(NULL AS INT), 1, 9), (1, CAST(NULL AS INT), 6), (2, 2, 1), (3, 3, CAST(NULL AS INT))) AS r(rk, rt, v)"
for _name, _hot in (("", False), ("_hot", True)):

    @query(f"j10_asof_nulls{_name}", f"SELECT id, v FROM {LT} ASOF LEFT JOIN (SELECT * FROM {RT}) r2 ON l.k = r2.rk AND l.t >= r2.rt")
    def _asof_nulls(spark, sf_dir, hot=_hot):
        r = spark.sql(f"SELECT rk AS k, rt AS t, v FROM {RT}")
        return joins.as_of(spark.sql(f"SELECT * FROM {LT}"), r, "k", "t", ["v"], hot).select("id", "v")


@query("j10_asof_two_keys", """SELECT e.event_id, o.other FROM events e ASOF LEFT JOIN (SELECT user_id, event_type, ts, max(event_id) AS other FROM events WHERE value > 50 GROUP BY ALL) o
 ON e.user_id = o.user_id AND e.event_type = o.event_type AND e.ts >= o.ts""")
def _asof_two_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")
    o = e.where("value > 50").select("user_id", "event_type", "ts", F.col("event_id").alias("other"))
    return joins.as_of(e, o, ["user_id", "event_type"], "ts", ["other"], hot=True).select("event_id", "other")


@query("j10_positional", "SELECT a.r_name AS a, b.n_name AS b FROM (SELECT r_name FROM region ORDER BY r_name) a POSITIONAL JOIN (SELECT n_name FROM nation ORDER BY n_nationkey) b")
def _positional(spark, sf_dir):
    a, b = table(spark, sf_dir, "region").select(F.col("r_name").alias("a")), table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("b"))
    return joins.positional(a, b, ["a"], ["n_nationkey"]).select("a", "b")


@query("j11_range", """SELECT p_partkey, lo FROM part JOIN (SELECT DISTINCT CAST(s_suppkey % 20 AS DOUBLE) * 10 + 900 AS lo FROM supplier) r ON p_retailprice >= lo AND p_retailprice < lo + 5""")
def _range(spark, sf_dir):
    ranges = table(spark, sf_dir, "supplier").select(((F.col("s_suppkey") % 20).cast("double") * 10 + 900).alias("lo")).distinct().withColumn("hi", F.col("lo") + 5)
    return joins.in_range(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), ranges, "p_retailprice", "lo", "hi", 10).select("p_partkey", "lo")


text("j12_correlated", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity > (SELECT 1.5 * avg(l_quantity) FROM lineitem WHERE l_partkey = l.l_partkey)")


@query("j14_counted", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def _counted(spark, sf_dir):
    return joins.counted(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "o_orderkey")


@query("j14_counted_star", "SELECT c_nationkey, count(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey")
def _counted_star(spark, sf_dir):
    return joins.counted(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", group="c_nationkey")


@query("j16_salted", "SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45")
def _salted(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    return joins.salted(a, b, "k", 4).select(F.col("k").alias("l_orderkey"), "l_linenumber", "o_orderstatus")
