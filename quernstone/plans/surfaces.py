"""Sources, sinks, pins, vectors and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quernstone.engine import Engine
from quernstone.operators import vector
from quernstone.sources import scans
from quernstone.sources.tables import VersionedTable
from quernstone.streaming import streams
from quernstone.session import table

from .base import query, text


def _folder(spark) -> str:
    """A new folder where executors and driver both reach it: in the warehouse."""
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch-{uuid.uuid4().hex}"


text("s01_table_scan", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")


@query("s03_parquet", "SELECT p_brand, count(*) AS n FROM part WHERE p_size > 40 GROUP BY p_brand")
def _parquet(spark, sf_dir):
    return scans.parquet(spark, f"{sf_dir}/part.parquet").where("p_size > 40").groupBy("p_brand").agg(F.count("*").alias("n"))


@query("s04_hive_partitions", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _hive(spark, sf_dir):
    path = _folder(spark)
    scans.write(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), path, by=["c_mktsegment"])
    return scans.parquet(spark, path).where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


@query("s08_csv", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _csv(spark, sf_dir):
    path = _folder(spark)
    scans.write(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path, "csv", header="true")
    return scans.csv(spark, path, "s_suppkey bigint, s_name string, s_acctbal double")


@query("s08_json", "SELECT event_id, event_type, value FROM events")
def _json(spark, sf_dir):
    path = _folder(spark)
    scans.write(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), path, "json")
    return scans.json(spark, path, "event_id bigint, event_type string, value double")


@query("s08_orc", "SELECT n_nationkey, n_name FROM nation")
def _orc(spark, sf_dir):
    path = _folder(spark)
    scans.write(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path, "orc")
    return scans.orc(spark, path)


@query("s09_column_data", "SELECT * FROM (VALUES (1, 'a'), (2, NULL)) AS t(id, s)")
def _column_data(spark, sf_dir):
    return scans.values(spark, [(1, "a"), (2, None)], "id int, s string")


text("s10_values", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y')) AS t(a, b)")
text("s12_one_row", "SELECT 1 + 2 AS three, 'x' AS s")
text("s13_empty", "SELECT n_name FROM nation WHERE 1 = 0")


@query("s15_pinned", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus")
def _pinned(spark, sf_dir):
    engine = Engine(spark, sf_dir)
    engine.pins.pin(table(spark, sf_dir, "orders"), "orders", f"{sf_dir}/orders.parquet", ["o_orderstatus", "o_totalprice"])
    return engine.sql("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus")


@query("s15_pinned_other_columns", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderpriority")
def _pinned_other_columns(spark, sf_dir):
    engine = Engine(spark, sf_dir)
    engine.pins.pin(table(spark, sf_dir, "orders"), "orders", f"{sf_dir}/orders.parquet", ["o_orderstatus", "o_totalprice"])
    return engine.sql("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderpriority")


@query("s16_unpinned", "SELECT * FROM region")
def _unpinned(spark, sf_dir):
    engine = Engine(spark, sf_dir)
    engine.pins.pin(table(spark, sf_dir, "region"), "region", "region", ["r_regionkey"])
    engine.pins.unpin("region")
    return engine.sql("SELECT * FROM region")


@query("s07_read_parquet", "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s FROM part WHERE p_size > 10")
def _read_parquet(spark, sf_dir):
    return Engine(spark).sql(f"SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s FROM read_parquet('{sf_dir}/part.parquet') WHERE p_size > 10")


@query("s07_read_csv", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def _read_csv(spark, sf_dir):
    path = _folder(spark)
    scans.write(table(spark, sf_dir, "nation"), path, "csv", header="true")
    return Engine(spark).sql(f"SELECT n_regionkey, count(*) AS n FROM read_csv('{path}') GROUP BY n_regionkey")


@query("s20_arrow", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 1")
def _arrow(spark, sf_dir):
    got = scans.arrow(table(spark, sf_dir, "region").where("r_regionkey > 1"))
    return spark.createDataFrame(got)


@query("s21_labels", "SELECT count(*) AS n FROM supplier")
def _labels(spark, sf_dir):
    return Engine(spark, sf_dir).sql("SELECT count(*) AS n FROM supplier", label="suppliers")


@query("s17_pinned_changes", "SELECT count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS s FROM (SELECT n_nationkey FROM nation WHERE n_regionkey <> 0 UNION ALL SELECT 100) t")
def _pinned_changes(spark, sf_dir):
    engine = Engine(spark, sf_dir)
    engine.pins.pin(table(spark, sf_dir, "nation"), "nation", "nation")
    engine.pins.delete("nation", "n_regionkey = 0")
    engine.pins.append("nation", scans.values(spark, [(100, "NEW", 1)], "n_nationkey int, n_name string, n_regionkey int"))
    return engine.sql("SELECT count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS s FROM nation")


@query("s18_copy_ordered", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey BETWEEN 10 AND 20")
def _copy_ordered(spark, sf_dir):
    path = _folder(spark)
    scans.copy_ordered(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), path, ["l_partkey"], 4)
    return scans.parquet(spark, path).where("l_partkey BETWEEN 10 AND 20").select("l_orderkey", "l_linenumber")


@query("s18_changes", """SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey >= 5
UNION ALL SELECT 100000, 'new', 0.5""")
def _changes(spark, sf_dir):
    t = VersionedTable(spark, _folder(spark)).create(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"))
    t.delete(F.col("s_suppkey") < 5)
    t.update({"s_acctbal": F.col("s_acctbal") + 1}, F.col("s_suppkey") % 3 == 0)
    t.insert(scans.values(spark, [(100000, "old", 0.1)], "s_suppkey bigint, s_name string, s_acctbal double"))
    t.merge(scans.values(spark, [(100000, "new", 0.5)], "s_suppkey bigint, s_name string, s_acctbal double"), "s_suppkey")
    return t.read()


def _query_vector(spark, sf_dir) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 7").first()["embedding"])


_VECTORS = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
for _metric, _function in (("l2", "list_distance"), ("cosine", "list_cosine_distance")):

    @query(f"v01_knn_{_metric}", f"""WITH v AS (SELECT vec_id, label, {_VECTORS} AS x FROM embeddings), d AS (
  SELECT vec_id, label, {_function}(x, (SELECT x FROM v WHERE vec_id = 7)) AS d FROM v)
SELECT vec_id, label, round(abs(d), 6) + 0.0 AS distance FROM d ORDER BY d, vec_id LIMIT 10""")
    def _knn(spark, sf_dir, metric=_metric):
        found = vector.knn(table(spark, sf_dir, "embeddings"), "embedding", _query_vector(spark, sf_dir), 10, metric, ["vec_id", "label"])
        return found.withColumn("distance", F.round(F.abs("distance"), 6) + 0.0)


#: CRC-32 of a text, bit by bit, for engines without such a function.
CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length({s}) + 1), lambda i: ascii(substr({s}, CAST(i AS INT), 1))::UBIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"""


@query("e01_hash_partition", f"SELECT part, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS s FROM (SELECT event_id, CAST({CRC.format(s='CAST(user_id AS VARCHAR)')} % 4 AS BIGINT) AS part FROM events) t GROUP BY part")
def _hash_partition(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("part", streams.crc32_partition(4, "user_id").cast("bigint"))
    return e.groupBy("part").agg(F.count("*").alias("n"), F.sum("event_id").alias("s"))


@query("e03_fragment_partitions", f"SELECT n_nationkey, CAST({CRC.format(s='n_name')} % 3 AS BIGINT) AS part FROM nation")
def _fragment_partitions(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", streams.crc32_partition(3, "n_name").cast("bigint").alias("part"))



@query("t01_exchange_streams", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS s FROM events GROUP BY event_type")
def _streams(spark, sf_dir):
    session = streams.Session()
    for k, senders in ((1, ["a", "b"]), (2, ["f"]), (3, ["f"])):
        session.declare(k, senders)
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    for k, sender in enumerate(("a", "b")):
        session[1].push(sender, e.where(F.col("event_id") % 2 == k))
        session[1].close(sender)
    streams.Fragment(spark, session, "f", "SELECT event_type, value FROM stream_1", [1], [2, 3], ["event_type"]).run()
    parts = [session[k].pull() for k in (2, 3)]
    return parts[0].unionByName(parts[1]).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("s"))


@query("t05_empty_stream", "SELECT event_type, count(*) AS n FROM events WHERE value > 90 GROUP BY event_type")
def _empty_stream(spark, sf_dir):
    """A fragment over one stream with a batch and one without."""
    session, e = streams.Session(), table(spark, sf_dir, "events").select("event_type", "value")
    session.declare(1, ["a"], e.schema)
    session.declare(10, ["a"], e.schema)
    session.declare(2, ["f"])
    session.declare(3, ["r"])
    session[1].push("a", e.where("value > 90"))
    session[1].close("a")
    session[10].close("a")
    streams.Fragment(spark, session, "f", "SELECT event_type FROM stream_1 UNION ALL SELECT event_type FROM stream_10", [1, 10], [2]).run()
    streams.relay(session, "r", 2, [3])
    return session[3].pull().groupBy("event_type").agg(F.count("*").alias("n"))


@query("t06_tumbling", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def _tumbling(spark, sf_dir):
    out = streams.windowed(table(spark, sf_dir, "events"), "1 day", by=("event_type",))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("t06_sliding", """SELECT w AS start, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT value, unnest([time_bucket(INTERVAL '6 hours', ts), time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours']) AS w FROM events) t GROUP BY w""")
def _sliding(spark, sf_dir):
    out = streams.windowed(table(spark, sf_dir, "events"), "12 hours", "6 hours")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 2).alias("total"))


@query("t06_sessions", """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
 (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh FROM events) a) b GROUP BY user_id, s""")
def _sessions(spark, sf_dir):
    return streams.sessions(table(spark, sf_dir, "events"), "2 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
