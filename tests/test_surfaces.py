"""Pins, streams, vectors, functions and plans."""

import pytest
from pyspark.sql import functions as F

from quernstone.engine import Engine
from quernstone.functions import parity as P
from quernstone.operators import joins, ordering, vector
from quernstone.session import table
from quernstone.sources import scans
from quernstone.sources.pins import PinnedError, Pins
from quernstone.streaming import streams


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    p = plan(table(spark, sf_dir, "part").where("p_size > 40").select("p_partkey"))
    assert "PushedFilters: [IsNotNull(p_size), GreaterThan(p_size,40)]" in p
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in p


def test_derived_filters_of_a_disjunction_reach_both_scans(spark, sf_dir):
    from quernstone.plans import registry

    p = plan(registry.QUERIES["tpch_q19"](spark, sf_dir))
    assert p.count("PushedFilters: [") == 2 and "Or(" in p


def test_hive_partitions_are_pruned(spark, sf_dir, tmp_path):
    scans.write(table(spark, sf_dir, "customer"), f"{tmp_path}/c", by=["c_mktsegment"])
    df = scans.parquet(spark, f"{tmp_path}/c").where("c_mktsegment = 'BUILDING'")
    assert "PartitionFilters: [isnotnull(c_mktsegment" in plan(df)
    assert df.count() == table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").count()


def test_escaped_partition_values(spark, tmp_path):
    scans.write(scans.values(spark, [(1, "a b/c=d")], "id int, k string"), f"{tmp_path}/e", by=["k"])
    assert scans.parquet(spark, f"{tmp_path}/e").first().k == "a b/c=d"


def test_bucketed_tables_join_without_exchange(spark, sf_dir):
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scans.co_located(table(spark, sf_dir, "orders"), "b_orders", "o_orderkey", 4)
        scans.co_located(table(spark, sf_dir, "lineitem"), "b_lines", "l_orderkey", 4)
        df = spark.table("b_orders").join(spark.table("b_lines"), F.col("o_orderkey") == F.col("l_orderkey"))
        assert "Exchange" not in plan(df)
        assert df.count() == table(spark, sf_dir, "lineitem").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)
        for t in ("b_orders", "b_lines"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_pins(spark, sf_dir):
    pins = Pins(spark)
    df = table(spark, sf_dir, "nation")
    assert pins.pin(df, "n", "nation", ["n_nationkey"], "memory")
    assert pins.serves("n", "nation", ["n_nationkey"]) and not pins.serves("n", "nation", ["n_name"])
    pins.pin(df, "n", "nation", ["n_name"], "memory")
    assert pins.get("N").columns == ["n_nationkey", "n_name"]
    assert "InMemoryTableScan" in plan(pins.get("n"))
    with pytest.raises(PinnedError):
        pins.update("n")
    pins.delete("n", "n_nationkey < 5")
    assert pins.get("n").count() == 20
    pins.unpin("n")
    with pytest.raises(PinnedError):
        pins.unpin("n")
    with pytest.raises(ValueError):
        pins.pin(df, "n", "nation", ["nope"])
    with pytest.raises(ValueError):
        pins.pin(df, "n", "nation", tier="disk")


def test_pins_fall_through_and_are_replaced(spark, sf_dir):
    engine = Engine(spark, sf_dir)
    nation = table(spark, sf_dir, "nation")
    engine.pins.pin(nation, "nation", "nation", ["n_nationkey"], "memory")
    assert "InMemoryTableScan" in plan(engine.sql("SELECT sum(n_nationkey) AS s FROM nation"))
    assert "InMemoryTableScan" not in plan(engine.sql("SELECT sum(n_nationkey) AS s FROM nation WHERE n_name > 'A'"))
    assert len(engine.sql("SELECT * FROM nation").columns) == 3
    engine.pins.pin(nation.where("n_regionkey = 1"), "nation", "nation", ["n_name"], "memory")  # other rows: replaced
    assert engine.pins.get("nation").columns == ["n_name"] and engine.pins.get("nation").count() < 25
    engine.pins.delete("nation", "n_name = 'NATION_1'")
    with pytest.raises(PinnedError):
        engine.sql("SELECT n_regionkey FROM nation")
    with pytest.raises(PinnedError):
        engine.pins.merge("nation")
    engine.pins.checkpoint("nation")
    assert engine.sql("SELECT * FROM nation").count() == 25
    engine.pins.release()


def test_labels_end_with_their_query(spark, sf_dir):
    engine = Engine(spark, sf_dir)
    said = lambda: spark.sparkContext.getLocalProperty("spark.job.description")
    engine.sql("SELECT 1 AS x", label="one")
    assert said() == "one"
    engine.label("all")
    engine.sql("SELECT 1 AS x")
    assert said() == "all"
    engine.label(None)
    engine.sql("SELECT 1 AS x")
    assert said() is None


def test_s3_paths_are_read_through_s3a():
    assert scans._store("s3://bucket/a/*.parquet") == "s3a://bucket/a/*.parquet" and scans._store("/a") == "/a"


def test_fragments_know_their_inputs(spark):
    session = streams.Session()
    for k in (1, 10):
        session.declare(k, ["a"])
    session.declare(2, ["f"])
    with pytest.raises(streams.StreamError, match="not read"):
        streams.Fragment(spark, session, "f", "SELECT id FROM stream_10", [1, 10], [2])
    session[1].close("a")
    assert streams.Fragment(spark, session, "f", "SELECT id FROM stream_1", [1], [2]).run() is None
    assert session[2].pull() is None and session[2].drained


def test_keys_of_different_types_meet_in_one_partition(spark):
    a = spark.range(50).select(F.col("id").cast("int").alias("k"))
    b = spark.range(50).select(F.col("id").alias("k"))
    parts = [{r.k: r.p for r in x.select("k", streams.partition_of(5, "k", of=x).alias("p")).collect()} for x in (a, b)]
    assert parts[0] == parts[1] and len(set(parts[0].values())) == 5


def test_a_failed_stream_is_relayed_as_failed(spark):
    session = streams.Session()
    session.declare(1, ["a"])
    session.declare(2, ["r"])
    session[1].fail("lost")
    with pytest.raises(streams.StreamError, match="lost"):
        streams.relay(session, "r", 1, [2])
    with pytest.raises(streams.StreamError, match="lost"):
        session[2].pull()


def test_hot_as_of_against_the_plain_one(spark):
    left = spark.range(4000).select((F.col("id") % 3).alias("k"), "id", ((F.col("id") * 7919) % 1000).alias("t"))
    right = spark.range(500).select((F.col("id") % 4).alias("k"), ((F.col("id") * 104729) % 1000).alias("t"), F.col("id").alias("v"))
    plain, spread = (sorted(map(tuple, joins.as_of(left, right, "k", "t", ["v"], hot).select("id", "v").collect()), key=repr) for hot in (False, True))
    assert plain == spread


def test_shares_of_rows_are_not_gathered(spark, sf_dir):
    df = ordering.limit_percent(table(spark, sf_dir, "orders"), 10, "-o_totalprice", "o_orderkey")
    assert "GlobalLimit" not in plan(df) and "TakeOrdered" not in plan(df)
    assert [r.o_orderkey for r in df.collect()] == [r.o_orderkey for r in table(spark, sf_dir, "orders").orderBy(*ordering.keys("-o_totalprice", "o_orderkey")).limit(150).collect()]


def test_engine_needs_known_tables(spark, sf_dir):
    with pytest.raises(KeyError):
        Engine(spark, sf_dir).table("nope")
    engine = Engine(spark)
    engine.register("mine", scans.values(spark, [(1,), (2,)], "x int"))
    assert engine.sql("SELECT sum(x) AS s FROM mine WHERE x >= ?", [2]).first().s == 2
    assert "Scan" in engine.explain("SELECT x FROM mine")


def test_scalar_subquery_of_two_rows_fails(spark, sf_dir):
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        Engine(spark, sf_dir).sql("SELECT (SELECT n_name FROM nation) AS x").collect()


def test_error_raises_when_reached(spark):
    with pytest.raises(Exception, match="negative"):
        spark.range(1).select(F.when(F.col("id") == 0, P.fail("negative")).otherwise("x")).collect()


def test_like_takes_a_backslash_as_it_is(spark):
    df = scans.values(spark, [("a%b",), ("a\\xb",)], "s string")
    assert [r.s for r in df.where(P.like(df.s, "a\\%b")).collect()] == ["a\\xb"]


def test_round_cast(spark):
    row = spark.sql("SELECT 2.5BD AS a, 3.5BD AS b, -2.5BD AS c").select(*(P.round_cast(F.col(c)).alias(c) for c in "abc")).first()
    assert tuple(row) == (3, 4, -3)


def test_knn_rules(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = [0.0] * 64
    for wrong in ({"k": 0}, {"metric": "dot"}, {"output": []}, {"output": ["nope"]}):
        with pytest.raises(ValueError):
            vector.knn(e, "embedding", q, **wrong)
    with pytest.raises(ValueError):
        vector.knn(e, "embedding", [None])
    with pytest.raises(Exception, match="64|components"):
        vector.knn(e, "embedding", [0.0] * 3).collect()
    few = e.limit(3).unionByName(e.limit(1).withColumn("embedding", F.lit(None).cast(e.schema["embedding"].dataType)))
    assert vector.knn(few, "embedding", q, 10).count() == 3


def test_streams_follow_their_contracts(spark):
    s = streams.BatchStream(["a", "b"])
    df = spark.range(1)
    with pytest.raises(streams.StreamError):
        s.push("x", df)
    s.push("a", df)
    s.close("a")
    s.close("a")
    with pytest.raises(streams.StreamError):
        s.push("a", df)
    assert s.pull() is df
    with pytest.raises(TimeoutError):
        s.pull(0.01)
    s.close("b")
    assert s.pull() is None and s.drained
    f = streams.BatchStream(["a"])
    f.fail("first")
    f.fail("second")
    f.close("a")
    with pytest.raises(streams.StreamError, match="first"):
        f.pull()
    assert not f.drained
    with pytest.raises(streams.StreamError):
        streams.Fragment(spark, streams.Session(), "f", "SELECT 1", [1], [])
    with pytest.raises(streams.StreamError):
        streams.Session()[3]


def test_broadcast_fragment(spark):
    session = streams.Session()
    for k, senders in ((1, ["a"]), (2, ["f"]), (3, ["f"])):
        session.declare(k, senders)
    session[1].push("a", spark.range(5))
    session[1].close("a")
    streams.Fragment(spark, session, "f", "SELECT id FROM stream_1", [1], [2, 3], broadcast=True).run()
    assert [session[k].pull().count() for k in (2, 3)] == [5, 5]


def test_event_time_windows_on_a_stream(spark, sf_dir, tmp_path):
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    streams.run_once(streams.windowed(stream, "1 day", late="1 hour", by=("event_type",)), "daily", "complete")
    key = lambda r: (r.start, r.event_type, r.n)
    assert sorted(map(key, spark.table("daily").collect())) == sorted(map(key, streams.windowed(events, "1 day", by=("event_type",)).collect()))


def test_crc32_partition(spark):
    import zlib

    rows = spark.range(50).select("id", streams.crc32_partition(7, "id").alias("p")).collect()
    assert all(r.p == zlib.crc32(str(r.id).encode()) % 7 for r in rows)


def test_numbering_is_dense_over_partitions(spark):
    df = joins.numbered(spark.range(1000).repartition(7), ["id"], "i")
    assert all(r.i == r.id + 1 for r in df.collect())


def test_as_of_and_distinct_on_with_nulls(spark):
    left = scans.values(spark, [(1, 5), (1, None), (None, 5), (2, 1)], "k int, t int")
    right = scans.values(spark, [(1, 5, 7), (1, 6, 8), (None, 1, 9), (2, 2, 1)], "k int, t int, v int")
    got = {(r.k, r.t): r.v for r in joins.as_of(left, right, "k", "t", ["v"]).collect()}
    assert got == {(1, 5): 7, (1, None): None, (None, 5): None, (2, 1): None}
    assert {(r.k, r.t): r.v for r in joins.as_of(left, right, ["k"], "t", ["v"], hot=True).collect()} == got
    df = scans.values(spark, [(1, None), (1, 3), (2, None)], "k int, v int")
    assert {tuple(r) for r in ordering.distinct_on(df, ["k"], "v").collect()} == {(1, 3), (2, None)}


def test_small_checks_the_size(spark, sf_dir):
    assert "broadcast" in scans.small(table(spark, sf_dir, "nation"))._jdf.queryExecution().logical().toString()
    assert "broadcast" not in scans.small(table(spark, sf_dir, "lineitem"), 10)._jdf.queryExecution().logical().toString()


def test_dynamic_partition_pruning(spark, sf_dir, tmp_path):
    scans.write(table(spark, sf_dir, "customer").withColumn("part", F.col("c_nationkey")), f"{tmp_path}/p", by=["part"])
    nation = table(spark, sf_dir, "nation").where("n_name = 'NATION_3'")
    df = scans.parquet(spark, f"{tmp_path}/p").join(nation, F.col("part") == F.col("n_nationkey"))
    assert "dynamicpruningexpression" in plan(df)
    assert df.count() == table(spark, sf_dir, "customer").where("c_nationkey = 3").count()


def test_versions_stay_readable(spark, tmp_path):
    from quernstone.sources.tables import VersionedTable

    t = VersionedTable(spark, f"{tmp_path}/t")
    with pytest.raises(ValueError):
        t.read()
    t.create(scans.values(spark, [(1, None), (2, 5)], "k int, v int"))
    with pytest.raises(ValueError):
        t.create(t.read())
    t.delete(F.col("v") > 1)
    assert [tuple(r) for r in t.read().collect()] == [(1, None)]
    assert t.read(0).count() == 2
    with pytest.raises(ValueError):
        t.read(9)


def test_counted_reduces_before_it_joins(spark, sf_dir):
    p = plan(joins.counted(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey"))
    assert p.index("Join") < p.index("HashAggregate")  # the plan prints its root first


def test_top_n_keeps_n_rows_a_task(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(ordering.top_n(table(spark, sf_dir, "orders"), 5, "-o_totalprice", "o_orderkey"))


def test_top_per_group_cuts_groups_before_the_shuffle(spark, sf_dir):
    df = ordering.top_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], 2, "-o_totalprice", "o_orderkey")
    assert plan(df).count("WindowGroupLimit") == 2


def test_empty_sides_of_joins(spark):
    a, none = scans.values(spark, [(1, 2)], "k int, v int"), scans.empty(spark, "k int, w int")
    assert a.join(none, "k").count() == 0 and a.join(none, "k", "left").count() == 1
    assert joins.mark(a, none, "k", "k").first().mark is False
    assert joins.as_of(a.withColumnRenamed("v", "t"), scans.empty(spark, "k int, t int, w int"), "k", "t", ["w"]).first().w is None
    assert joins.positional(a, scans.empty(spark, "z int"), ["k"], ["z"]).count() == 1


def test_salted_and_range_joins_against_plain_ones(spark):
    a = spark.range(300).select((F.col("id") % 7).alias("k"), "id")
    b = spark.range(14).select((F.col("id") % 7).alias("k"), F.col("id").alias("j"))
    assert sorted(map(tuple, joins.salted(a, b, "k", 3).select("k", "id", "j").collect())) == sorted(map(tuple, a.join(b, "k").select("k", "id", "j").collect()))
    r = scans.values(spark, [(0.5, 9.5), (9.0, 31.0), (5.0, 5.0), (-3.0, 0.0)], "lo double, hi double")
    got = joins.in_range(spark.range(40), r, "id", "lo", "hi", 4)
    want = spark.range(40).join(r, (F.col("id") >= F.col("lo")) & (F.col("id") < F.col("hi")))
    assert sorted(map(tuple, got.select("id", "lo").collect())) == sorted(map(tuple, want.select("id", "lo").collect()))


@pytest.fixture
def laid_out(spark):
    """Sets the session's options for a test."""
    before = {}

    def put(**options):
        for name, value in options.items():
            name = f"spark.sql.{name.replace('_', '.')}"
            before.setdefault(name, spark.conf.get(name))
            spark.conf.set(name, value)

    yield put
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("name", ["n04_null_not_in", "n05_null_not_in_null"])
def test_not_in_broadcasts_no_table(spark, sf_dir, laid_out, name):
    from quernstone.plans import registry

    laid_out(autoBroadcastJoinThreshold="-1")
    assert "BroadcastHashJoin" not in plan(registry.QUERIES[name](spark, sf_dir))


def test_not_in_is_three_valued(spark):
    probe, build = (spark.createDataFrame([(x,) for x in rows], "x int") for rows in ([1, 2, None], [2, 3]))
    assert [r.x for r in joins.not_in(probe, build, "x", "x").collect()] == [1]
    assert joins.not_in(probe, build.union(spark.sql("SELECT CAST(NULL AS INT)")), "x", "x").collect() == []
    assert {r.x for r in joins.not_in(probe, build.where("false"), "x", "x").collect()} == {1, 2, None}


def test_approximate_count_of_many_keys_is_near(spark, tmp_path):
    from quernstone.plans import registry

    spark.range(1200000).select(F.col("id").alias("l_partkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [r.near for r in registry.QUERIES["a20_approximate_distinct"](spark, str(tmp_path)).collect()] == [True]


def test_hot_as_of_over_many_ranges(spark, laid_out):
    laid_out(shuffle_partitions="13", adaptive_coalescePartitions_enabled="false")
    left = spark.range(20000).select(F.when(F.col("id") % 97 > 0, F.col("id") % 3).alias("k"), "id", F.when(F.col("id") % 89 > 0, (F.col("id") * 7919) % 5000).alias("t"))
    right = spark.range(3000).select((F.col("id") % 4).alias("k"), ((F.col("id") * 104729) % 5000).alias("t"), F.col("id").alias("v"))
    plain, spread = (sorted(map(tuple, joins.as_of(left, right, "k", "t", ["v"], hot).select("id", "v").collect()), key=repr) for hot in (False, True))
    assert plain == spread
    assert [r.v for r in joins.as_of(left.where("false"), right, "k", "t", ["v"], hot=True).collect()] == []
    assert {r.v for r in joins.as_of(left, right.where("false"), "k", "t", ["v"], hot=True).collect()} == {None}
