"""The 22 TPC-H queries (fixed values: their texts are a public benchmark's) on the tables at hand. Columns that these lack are left out; partsupp is made of the pairs that lineitem has."""

from __future__ import annotations

from .base import text

def partsupp(of: str = "") -> str:
    """partsupp as a common table. of: which lines count; pairs are whole or absent as long as it asks about part or supplier alone, so that a query's own filter is passed on."""
    return f"""partsupp AS (
  SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, CAST(sum(l_quantity) AS BIGINT) AS ps_availqty,
         min(l_extendedprice / l_quantity) AS ps_supplycost
  FROM lineitem {of} GROUP BY l_partkey, l_suppkey)"""


text("tpch_q01", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc,
       count(*) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '2001-09-02'
GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""")

text("tpch_q02", f"""
WITH {partsupp("WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 10 AND p_type LIKE '%MO')")}
SELECT round(s_acctbal, 2) AS s_acctbal, s_name, n_name, p_partkey, p_brand
FROM part, supplier, partsupp ps, nation, region
WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size <= 10 AND p_type LIKE '%MO' AND s_nationkey = n_nationkey
  AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
  AND ps_supplycost = (SELECT min(x.ps_supplycost) FROM partsupp x, supplier y, nation z, region w
    WHERE x.ps_partkey = p_partkey AND y.s_suppkey = x.ps_suppkey AND y.s_nationkey = z.n_nationkey AND z.n_regionkey = w.r_regionkey AND w.r_name = 'EUROPE')
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""")

text("tpch_q03", """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate
FROM customer, orders, lineitem
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""")

text("tpch_q04", """
SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-10-01'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate)
GROUP BY o_orderpriority ORDER BY o_orderpriority""")

text("tpch_q05", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey
  AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01'
GROUP BY n_name ORDER BY revenue DESC, n_name""")

text("tpch_q06", """
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24""")

text("tpch_q07", """
SELECT supp_nation, cust_nation, l_year, round(sum(volume), 2) AS revenue FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS BIGINT) AS l_year, l_extendedprice * (1 - l_discount) AS volume
  FROM supplier, lineitem, orders, customer, nation n1, nation n2
  WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
    AND ((n1.n_name = 'NATION_6' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_6'))
    AND l_shipdate BETWEEN DATE '1995-01-01' AND DATE '1999-12-31') shipping
GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""")

text("tpch_q08", """
SELECT o_year, round(sum(CASE WHEN nation = 'NATION_2' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
  SELECT CAST(year(o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation
  FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
  WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
    AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'
    AND p_type = 'ECONOMY') all_nations
GROUP BY o_year ORDER BY o_year""")

text("tpch_q09", f"""
WITH {partsupp("WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE '%ring%')")}
SELECT nation, o_year, round(sum(amount), 2) AS sum_profit FROM (
  SELECT n_name AS nation, CAST(year(o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity * 0.5 AS amount
  FROM part, supplier, lineitem, partsupp, orders, nation
  WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey
    AND s_nationkey = n_nationkey AND p_name LIKE '%ring%') profit
GROUP BY nation, o_year ORDER BY nation, o_year DESC""")

text("tpch_q10", """
SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(c_acctbal, 2) AS c_acctbal, n_name
FROM customer, orders, lineitem, nation
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1997-10-01' AND o_orderdate < DATE '1998-01-01'
  AND l_returnflag = 'R' AND c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")

text("tpch_q11", f"""
WITH {partsupp("WHERE l_suppkey IN (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7')")}, valued AS (
  SELECT ps_partkey, sum(ps_supplycost * ps_availqty) AS v FROM partsupp, supplier, nation
  WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7' GROUP BY ps_partkey)
SELECT ps_partkey, round(v, 2) AS value FROM valued WHERE v > (SELECT sum(v) * 0.005 FROM valued) ORDER BY value DESC, ps_partkey""")

text("tpch_q12", """
SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
       CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM orders, lineitem
WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R') AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' AND o_orderdate < l_shipdate
GROUP BY l_linestatus ORDER BY l_linestatus""")

text("tpch_q13", """
SELECT c_count, count(*) AS custdist FROM (
  SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%NOT%SPECIFIED%'
  GROUP BY c_custkey) c_orders
GROUP BY c_count ORDER BY custdist DESC, c_count DESC""")

text("tpch_q14", """
SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1997-09-01' AND l_shipdate < DATE '1997-10-01'""")

text("tpch_q15", """
WITH revenue AS (
  SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total_revenue FROM lineitem
  WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1998-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue
WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey""")

text("tpch_q16", f"""
WITH {partsupp("WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9))")}
SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM partsupp, part
WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
  AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""")

text("tpch_q17", """
SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem, part
WHERE p_partkey = l_partkey AND p_brand IN ('Brand#2', 'Brand#3') AND p_type = 'SMALL'
  AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)""")

text("tpch_q18", """
SELECT c_name, c_custkey, o_orderkey, o_orderdate, round(o_totalprice, 2) AS o_totalprice, round(sum(l_quantity), 2) AS sum_qty
FROM customer, orders, lineitem
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""")

text("tpch_q19", """
SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem, part
WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity >= 1 AND l_quantity <= 11 AND p_size BETWEEN 1 AND 15 AND l_returnflag IN ('A', 'R'))
   OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity >= 10 AND l_quantity <= 20 AND p_size BETWEEN 1 AND 25 AND l_returnflag IN ('A', 'R'))
   OR (p_partkey = l_partkey AND p_brand = 'Brand#3' AND l_quantity >= 20 AND l_quantity <= 30 AND p_size BETWEEN 1 AND 35 AND l_returnflag IN ('A', 'R'))""")

text("tpch_q20", f"""
WITH {partsupp("WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'red%')")}
SELECT s_name, s_suppkey FROM supplier, nation
WHERE s_suppkey IN (SELECT ps_suppkey FROM partsupp WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'red%')
    AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM lineitem
      WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1999-01-01'))
  AND s_nationkey = n_nationkey AND n_name IN ('NATION_3', 'NATION_4', 'NATION_5') ORDER BY s_name""")

text("tpch_q21", """
SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders, nation
WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_linestatus = 'O'
  AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_linestatus = 'O' AND l3.l_returnflag = 'R')
  AND s_nationkey = n_nationkey AND n_name = 'NATION_20'
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""")

text("tpch_q22", """
SELECT cntrycode, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM (
  SELECT c_nationkey AS cntrycode, c_acctbal FROM customer
  WHERE c_nationkey IN (13, 1, 3, 23, 9, 18, 17) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.00)
    AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '1999-01-01')) custsale
GROUP BY cntrycode ORDER BY cntrycode""")
