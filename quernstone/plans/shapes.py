"""Windows, sorts, limits, set operations, common table expressions, subqueries and nesting."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import ordering
from quernstone.session import table

from .base import query, text

NULLED = "(SELECT CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS k, p_partkey AS id FROM part)"

text("w01_ranking", """SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER v AS BIGINT) AS rk, CAST(dense_rank() OVER v AS BIGINT) AS dr,
 CAST(ntile(3) OVER w AS BIGINT) AS nt, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
text("w02_neighbours", """SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2) OVER w AS after2, lag(o_orderkey, 1, CAST(-1 AS BIGINT)) OVER w AS d,
 first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l,
 nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
text("w03_rows_frame", """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 2) AS s,
 round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS a, count(*) OVER (PARTITION BY user_id) AS n FROM events""")
text("w04_range_frame", """SELECT p_partkey, count(*) OVER (PARTITION BY p_type ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n, max(p_retailprice) OVER (PARTITION BY p_type ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM part""")


@query("w05_top_per_group", "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 2")
def _top_per_group(spark, sf_dir):
    return ordering.top_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], 2, "-o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "rank")


text("o01_order_by", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
text("o03_nulls_first", f"SELECT id, k FROM {NULLED} t ORDER BY k ASC NULLS FIRST, id")


# n rows by their order, so that the place of the nulls shows in the rows and not only in their order
text("o03_places_of_nulls", f"SELECT id, CAST(row_number() OVER (ORDER BY k DESC NULLS FIRST, id) AS BIGINT) AS a, CAST(row_number() OVER (ORDER BY k ASC NULLS LAST, id) AS BIGINT) AS b FROM {NULLED} t")
text("o03_thirty_thousand", """SELECT k, count(*) AS n, min(place) AS first_place, max(place) AS last_place FROM (SELECT k, CAST(row_number() OVER (ORDER BY k DESC NULLS LAST, id) AS BIGINT) AS place FROM
 (SELECT CAST(i AS INT) AS id, CASE WHEN i % 7 = 0 THEN NULL ELSE CAST(i % 100 AS INT) END AS k FROM range(30000) AS r(i)) a) b GROUP BY k""")


@query("o03_nulls_last", f"SELECT id, k FROM {NULLED} t ORDER BY k, id")
def _nulls_last(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("k"))
    return p.orderBy(*ordering.keys("k", "id"))


@query("o04_top_n", f"SELECT id, k FROM {NULLED} t ORDER BY k DESC NULLS LAST, id LIMIT 25 OFFSET 10")
def _top_n(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("k"))
    return ordering.top_n(p, 25, "-k", "id", offset=10)


text("o05_limit", "SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders LIMIT 100) t")
text("o05_offset", "SELECT count(*) AS n FROM (SELECT n_name FROM nation LIMIT 20 OFFSET 10) t")


@query("o06_limit_percent", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10%")
def _limit_percent(spark, sf_dir):
    return ordering.limit_percent(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 10, "-o_totalprice", "o_orderkey")


@query("o07_sample", "SELECT * FROM orders WHERE CAST('0x' || substr(md5('42|' || CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) < CAST(floor(0.1 * 4294967296) AS BIGINT)")
def _sample(spark, sf_dir):
    return ordering.sample(table(spark, sf_dir, "orders"), 0.1, 42, ["o_orderkey"])


text("x01_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
text("x01_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
text("x01_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
text("x01_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
text("x01_intersect", "SELECT p_size AS k FROM part INTERSECT SELECT CAST(l_quantity AS INT) FROM lineitem")
text("x01_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
text("x02_cte", """WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), top AS (SELECT max(t) AS m FROM big)
SELECT o_custkey, round(t, 2) AS t FROM big, top WHERE t > m * 0.7""")
text("x03_recursive", "WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT n, f FROM r")
text("x04_in_exists", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.08)")
text("x04_not_in", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
text("x05_unnest", "SELECT vec_id, pos, round(CAST(x AS DOUBLE), 5) AS x FROM (SELECT vec_id, posexplode(embedding) AS (pos, x) FROM embeddings) t",
     "SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(CAST(embedding[pos + 1] AS DOUBLE), 5) AS x FROM embeddings, range(64) r(pos)")
text("x05_words", "SELECT w, count(*) AS n FROM (SELECT explode(split(text, ' ')) AS w FROM benchmark) t GROUP BY w", "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) t GROUP BY w")


@query("x06_pivot", """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P
FROM orders GROUP BY o_orderpriority""")
def _pivot(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


text("x06_unpivot", "SELECT * FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders) UNPIVOT (v FOR name IN (o_orderstatus, o_orderpriority))",
     "SELECT * FROM (UNPIVOT (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders) ON o_orderstatus, o_orderpriority INTO NAME name VALUE v)")
