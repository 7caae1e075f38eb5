"""Projections, filters, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.engine import Engine
from quernstone.functions import parity as P
from quernstone.session import table

from .base import query, text

#: Null, equal and unlike pairs for three-valued logic.
NULLS = "(VALUES (1, 1, 1, 'a'), (2, 1, 2, 'b'), (3, CAST(NULL AS INT), 2, CAST(NULL AS STRING)), (4, 3, CAST(NULL AS INT), ''), (5, CAST(NULL AS INT), CAST(NULL AS INT), 'a%b')) AS t(id, x, y, s)"
DUCK_NULLS = NULLS.replace("STRING", "VARCHAR")


def both(name: str, sql: str) -> None:
    """A query on the null fixture."""
    text(name, sql.replace("@t", NULLS), sql.replace("@t", DUCK_NULLS))


text("p01_projection", "SELECT c_custkey, c_custkey + 1 AS next, upper(c_mktsegment) AS seg, round(c_acctbal * 2, 2) AS twice FROM customer")
text("p02_projection_folding", "SELECT a + 1 AS b, a FROM (SELECT x * 2 AS a FROM (SELECT p_size AS x, p_name FROM part) q) r")
text("p03_filter", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
both("p04_comparisons", "SELECT id, x = y AS eq, x <> y AS ne, x < y AS lt, x <= y AS le, x > y AS gt, x >= y AS ge FROM @t")
both("p05_distinct_from", "SELECT id, x IS DISTINCT FROM y AS d, x IS NOT DISTINCT FROM y AS n FROM @t")
both("p06_and_or", "SELECT id, (x = 1) AND (y = 1) AS a, (x = 1) OR (y = 2) AS o FROM @t")
both("p07_not_null", "SELECT id, NOT (x = 1) AS n, x IS NULL AS isn, y IS NOT NULL AS nn FROM @t")
text("p08_try", "SELECT p_partkey, try_divide(p_size, p_partkey % 3) AS q FROM part", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size / (p_partkey % 3) END AS q FROM part")
text("p09_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount NOT BETWEEN 0.02 AND 0.08")
both("p10_in_list", "SELECT id, x IN (1, 3) AS a, x NOT IN (1, 3) AS b, x IN (1, CAST(NULL AS INT)) AS c FROM @t")
text("p11_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'large' END AS bin, CASE p_type WHEN 'PROMO' THEN 1 ELSE 0 END AS promo FROM part")
both("p12_coalesce", "SELECT id, coalesce(x, y, 0) AS c, nullif(x, 1) AS n, coalesce(s, 'none') AS s FROM @t")
text("p13_cast", "SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) AS d, CAST(o_orderdate AS DATE) AS dt, CAST(o_orderkey AS STRING) AS s, CAST(CAST(o_orderkey AS STRING) AS BIGINT) AS back FROM orders",
     "SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) AS d, CAST(o_orderdate AS DATE) AS dt, CAST(o_orderkey AS VARCHAR) AS s, CAST(CAST(o_orderkey AS VARCHAR) AS BIGINT) AS back FROM orders")
text("p14_try_cast", "SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS INT) AS d, TRY_CAST(o_orderpriority AS INT) AS n FROM orders")
text("p15_scalar_subquery", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")


@query("p16_parameters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 250000")
def _parameters(spark, sf_dir):
    return Engine(spark, sf_dir).sql("SELECT o_orderkey FROM orders WHERE o_orderstatus = :status AND o_totalprice > :least", {"status": "P", "least": 250000}, label="parameters")


@query("f01_arithmetic", "SELECT p_partkey, p_partkey + p_size AS a, p_partkey - p_size AS s, p_partkey * p_size AS m, -p_size AS neg FROM part")
def _arithmetic(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", (p.p_partkey + p.p_size).alias("a"), (p.p_partkey - p.p_size).alias("s"), (p.p_partkey * p.p_size).alias("m"), (-p.p_size).alias("neg"))


@query("f05_whole_division", "SELECT CAST(a // nullif(b, 0) AS BIGINT) AS q FROM (VALUES (CAST(9007199254740993 AS BIGINT), CAST(1 AS BIGINT)), (-9007199254740993, 2), (9223372036854775807, 3), (7, -2), (5, NULL), (NULL, 5), (5, 0)) AS t(a, b)")
def _whole_division(spark, sf_dir):
    rows = [(9007199254740993, 1), (-9007199254740993, 2), (9223372036854775807, 3), (7, -2), (5, None), (None, 5), (5, 0)]
    t = spark.createDataFrame(rows, "a bigint, b bigint")
    return t.select(P.integer_divide(t.a, t.b).alias("q"))


@query("f04_divide", "SELECT p_partkey, p_size / nullif(p_partkey % 7, 0) AS d, CAST((p_size - 25) // nullif(p_partkey % 7, 0) AS BIGINT) AS i, (p_size - 25) % nullif(p_partkey % 7, 0) AS r FROM part")
def _divide(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    d = p.p_partkey % 7
    return p.select("p_partkey", P.divide(p.p_size, d).alias("d"), P.integer_divide(p.p_size - 25, d).alias("i"), P.modulus(p.p_size - 25, d).alias("r"))


@query("f07_substring", "SELECT c_custkey, substring(c_name, 1, 4) AS a, substring(c_name, 0, 3) AS b, substring(c_name, 10, 3) AS c, substring(c_name, -3, 2) AS d FROM customer")
def _substring(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", P.substring(c.c_name, 1, 4).alias("a"), P.substring(c.c_name, 0, 3).alias("b"), P.substring(c.c_name, 10, 3).alias("c"), P.substring(c.c_name, -3, 2).alias("d"))


text("f08_like", "SELECT p_partkey FROM part WHERE p_name LIKE '%ed%i%' AND p_name NOT LIKE 'small%' AND p_brand LIKE 'Brand#_2'")


@query("f10_contains", "SELECT p_partkey, contains(p_name, 'ring') AS c, starts_with(p_name, 'red') AS p, ends_with(p_name, 'et') AS s FROM part")
def _contains(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", p.p_name.contains("ring").alias("c"), P.starts_with(p.p_name, "red").alias("p"), P.ends_with(p.p_name, "et").alias("s"))


@query("f13_lengths", "SELECT doc_id, strlen(text) AS b, length(text) AS c FROM documents")
def _lengths(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", P.strlen(d.text).alias("b"), P.length(d.text).alias("c"))


@query("f15_regexp_replace", r"SELECT page_id, regexp_replace(url, '[0-9]+', '#') AS one, regexp_replace(url, '[0-9]+', '#', 'g') AS each_one, regexp_replace(url, '^(https?)://([^/]+)/.*$', '\2 by \1') AS host FROM pages")
def _regexp_replace(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", P.regexp_replace(p.url, "[0-9]+", "#").alias("one"), P.regexp_replace(p.url, "[0-9]+", "#", True).alias("each_one"), P.regexp_replace(p.url, "^(https?)://([^/]+)/.*$", r"\2 by \1").alias("host"))


@query("f16_concat", f"SELECT id, concat(s, '-', CAST(x AS VARCHAR)) AS c, s || '-' || CAST(x AS VARCHAR) AS p FROM {DUCK_NULLS}")
def _concat(spark, sf_dir):
    t = spark.sql(f"SELECT * FROM {NULLS}")
    return t.select("id", P.concat(t.s, F.lit("-"), t.x.cast("string")).alias("c"), F.concat(t.s, F.lit("-"), t.x.cast("string")).alias("p"))


_PARTS = ("year", "month", "day", "hour", "minute", "second", "millisecond", "microsecond")


@query("f18_date_parts", f"SELECT event_id, {', '.join(f'{p}(ts) AS p_{p}' for p in _PARTS)} FROM events")
def _date_parts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", *(P.part(p, e.ts).alias(f"p_{p}") for p in _PARTS))


_UNITS = ("day", "hour", "minute", "second", "millisecond", "microsecond")


@query("f26_date_trunc", f"SELECT event_id, {', '.join(f'''date_trunc('{u}', ts) AS t_{u}''' for u in _UNITS)} FROM events")
def _date_trunc(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", *(P.date_trunc(u, e.ts).alias(f"t_{u}") for u in _UNITS))


@query("f27_struct", "SELECT r_regionkey, r.name AS name, r.k AS k FROM (SELECT r_regionkey, struct_pack(name := r_name, k := r_regionkey + 1) AS r FROM region) t")
def _struct(spark, sf_dir):
    r = table(spark, sf_dir, "region").withColumn("r", F.struct(F.col("r_name").alias("name"), (F.col("r_regionkey") + 1).alias("k")))
    return r.select("r_regionkey", "r.name", "r.k")


@query("f29_error_not_reached", "SELECT r_regionkey, CASE WHEN r_regionkey < 0 THEN error('negative') ELSE r_name END AS n FROM region")
def _error(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    return r.select("r_regionkey", F.when(r.r_regionkey < 0, P.fail("negative")).otherwise(r.r_name).alias("n"))


text("fx_strings", """SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, trim(concat('  ', c_name, ' ')) AS t, ltrim('  x') AS lt, rtrim('x  ') AS rt,
 lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '*') AS rp, replace(c_name, '0', 'o') AS r, reverse(c_mktsegment) AS rv, left(c_name, 3) AS le, right(c_name, 3) AS ri,
 repeat('ab', 3) AS rep, CAST(instr(c_name, '#') AS BIGINT) AS i, translate(c_mktsegment, 'AE', 'ae') AS tr, md5(c_name) AS m FROM customer""")
text("fx_math", """SELECT p_partkey, abs(p_size - 25) AS a, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f, round(p_retailprice, 1) AS r, round(sqrt(p_size), 9) AS s,
 round(power(p_size, 2), 3) AS p, round(ln(p_size), 9) AS l, round(log10(p_size), 9) AS lg, round(exp(p_size / 50.0), 9) AS e, CAST(sign(p_size - 25) AS INT) AS sg, greatest(p_size, 10) AS g, least(p_size, 10) AS le FROM part""")
text("fx_dates", """SELECT o_orderkey, date_add(CAST(o_orderdate AS DATE), 10) AS plus, CAST(date_diff(DATE '2002-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS gap, last_day(CAST(o_orderdate AS DATE)) AS eom,
 CAST(dayofweek(o_orderdate) - 1 AS BIGINT) AS dow, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(dayofyear(o_orderdate) AS BIGINT) AS doy, add_months(CAST(o_orderdate AS DATE), 1) AS m FROM orders""",
     """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 10 AS DATE) AS plus, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS BIGINT) AS gap, last_day(CAST(o_orderdate AS DATE)) AS eom,
 dayofweek(o_orderdate) AS dow, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS doy, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS m FROM orders""")
text("fx_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
text("fx_arrays", "SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, element_at(embedding, 1) AS f, round(aggregate(embedding, CAST(0 AS DOUBLE), (a, x) -> a + x), 4) AS s FROM embeddings",
     "SELECT vec_id, len(embedding) AS n, embedding[1] AS f, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS s FROM embeddings")
text("fx_regexp", "SELECT page_id, regexp_extract(url, 'https?://([^/]+)/', 1) AS host, url RLIKE '[?]page=' AS paged FROM pages", "SELECT page_id, regexp_extract(url, 'https?://([^/]+)/', 1) AS host, regexp_matches(url, '[?]page=') AS paged FROM pages")
text("fx_nested", "SELECT t.id, m['a'] AS a, l[1] AS second FROM (SELECT 1 AS id, map('a', 10, 'b', 20) AS m, array(5, 6, 7) AS l) t", "SELECT t.id, m['a'] AS a, l[2] AS second FROM (SELECT 1 AS id, MAP {'a': 10, 'b': 20} AS m, [5, 6, 7] AS l) t")
