"""Streams give what batches give, once a sentinel has closed the last windows."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates, joins, topn, windows
from tidemark.sinks.writers import KeyedTable, keyed_sink
from tidemark.sources import readers
from tidemark.streaming import routing, stateful

SF = "/root/testdata/sf0.001"


@pytest.fixture
def stream(spark, tmp_path):
    """The events as a stream of one file in time order with a sentinel, watermark one minute."""
    e = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value").where("event_type = 'view'")
    at = str(tmp_path / "in")
    routing.with_sentinel(e, "ts").coalesce(1).sortWithinPartitions("ts").write.parquet(at)
    return e, windows.event_time_watermark(spark.readStream.schema(e.schema).parquet(at), "ts", "1 minute")


def name():
    return "t" + uuid.uuid4().hex


def test_tumbling_and_distinct(stream, rows):
    batch, s = stream
    f = lambda d: windows.tumbling(d, "ts", "1 hour", [], F.count(F.lit(1)).alias("n"))
    assert rows(routing.run_to_memory(f(s), name())) == rows(f(batch))
    g = lambda d: aggregates.distinct_per_window(d, "ts", "1 hour", "user_id")
    assert rows(routing.run_to_memory(g(s), name())) == rows(g(batch))


def test_hop_and_top_n(stream, rows):
    batch, s = stream
    f = lambda d: windows.hopping_count(d, "ts", "1 hour", "10 minutes", ["user_id"])
    assert rows(routing.run_to_memory(f(s), name())) == rows(f(batch))
    counts = s.groupBy(F.window("ts", "1 hour").alias("window"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    top = topn.top_n_stream(counts, "window", "user_id", "n", 2).select(F.col("window.start").alias("w"), "user_id", "n", "rank")
    want = topn.top_n(windows.tumbling(batch, "ts", "1 hour", ["user_id"], F.count(F.lit(1)).alias("n")), ["window_start"], [F.desc("n"), F.asc("user_id")], 2)
    assert rows(routing.run_to_memory(top, name()), "w", "user_id", "n", "rank") == rows(want, "window_start", "user_id", "n", "rank")


def test_sessions(stream, rows):
    batch, s = stream
    f = lambda d: windows.sessions(d, "ts", "2 hours", ["user_id"], F.count(F.lit(1)).alias("n"))
    assert rows(routing.run_to_memory(f(s), name())) == rows(f(batch))


def test_late_rows_are_parted(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    parts = [[0, 100], [95, 20, 130], [50]]
    seen = {"on": [], "late": []}
    router = routing.LateRouter(spark, str(tmp_path / "marks"), "ts", "10 seconds", lambda d, b: seen["on"].extend(r.i for r in d.collect()), lambda d, b: seen["late"].extend(r.i for r in d.collect()))
    for b, part in enumerate(parts):
        router(spark.createDataFrame([(i, t0 + datetime.timedelta(seconds=i)) for i in part], "i int, ts timestamp"), b)
    assert sorted(seen["on"]) == [0, 95, 100, 130] and sorted(seen["late"]) == [20, 50]


def test_retractions(spark, rows):
    a = spark.createDataFrame([("x", 1), ("y", 1)], "k string, n int")
    b = spark.createDataFrame([("x", 2), ("y", 1)], "k string, n int")
    log = routing.retractions(a, b, ["k"])
    assert rows(log) == [(False, "x", 1), (True, "x", 2)]
    assert rows(routing.additions(log)) == [("x", 2)]


def test_keyed_sink_on_stream(spark, tmp_path, rows):
    src = str(tmp_path / "src")
    table = KeyedTable(spark, str(tmp_path / "table"), "id string, t double", ["id"])
    for k, data in enumerate(([("a", 1.0, 1), ("b", 2.0, 2)], [("a", 5.0, 3), ("a", 4.0, 4)])):
        spark.createDataFrame(data, "id string, t double, seq long").coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema("id string, t double, seq long").parquet(src)
        s.writeStream.foreachBatch(keyed_sink(table, ["seq"])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert rows(table.read()) == [("a", 4.0), ("b", 2.0)]


def test_change_stream(spark, tmp_path, rows):
    table = KeyedTable(spark, str(tmp_path / "t"), "id int, v int", ["id"])
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text('{"op":"I","seq":1,"id":1,"v":1}\n{"op":"I","seq":2,"id":2,"v":2}\n{"op":"U","seq":3,"id":1,"v":9}\n{"op":"D","seq":4,"id":2,"v":2}\n')
    s = readers.change_files(spark, str(tmp_path / "log"), "id int, v int", streaming=True)
    s.writeStream.foreachBatch(keyed_sink(table, ["seq"], op="op")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert rows(table.read()) == [(1, 9)]


@pytest.fixture
def timed(spark, tmp_path):
    """Stream from rows (key, seconds, value...) with a sentinel that fires all timers."""
    stateful.use_rocksdb(spark)
    t0 = datetime.datetime(2024, 1, 1)

    def make(data, schema):
        at = str(tmp_path / uuid.uuid4().hex)
        for k, part in enumerate([data, [(None, 10**7, *data[0][2:])], [(None, 2 * 10**7, *data[0][2:])]]):
            spark.createDataFrame([(r[0], t0 + datetime.timedelta(seconds=r[1]), *r[2:]) for r in part], schema).coalesce(1).write.mode("append").parquet(f"{at}/{k}")
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(at)
        return s.withWatermark("ts", "0 seconds")

    return make


def test_order_match_state(timed, rows):
    data = [("1", 0, "create"), ("1", 10, "pay"), ("2", 0, "create"), ("2", 900, "pay"), ("3", 0, "create"), ("4", 5, "pay")]
    out = stateful.order_matches(timed(data, "k string, ts timestamp, kind string"), "k", "ts", "kind")
    got = [r for r in rows(routing.run_to_memory(out, name())) if r[0] is not None]
    assert got == [("1", "payed successfully"), ("2", "payed but already timeout"), ("3", "order timeout"), ("4", "already payed but not found created log")]


def test_two_stream_match_state(timed, rows):
    data = [("a", 0, "left"), ("a", 4, "right"), ("b", 0, "left"), ("b", 6, "right"), ("c", 1, "right")]
    out = stateful.two_stream_matches(timed(data, "k string, ts timestamp, side string"), "k", "ts", "side", {"left": 5000, "right": 3000})
    got = [r for r in rows(routing.run_to_memory(out, name())) if r[0] is not None]
    assert got == [("a", "matched"), ("b", "left_only"), ("b", "right_only"), ("c", "right_only")]


def test_rise_state(timed, rows):
    data = [("a", 0, 30.0), ("a", 1, 31.0), ("a", 2, 31.0), ("b", 0, 30.0), ("b", 1, 31.0), ("b", 2, 30.5)]
    out = stateful.rise_alerts(timed(data, "k string, ts timestamp, v double"), "k", "ts", "v", 2000)
    assert [r[0] for r in rows(routing.run_to_memory(out, name())) if r[0] is not None] == ["a"]


def test_pairs_failures_and_blacklist_state(timed, rows):
    pairs = stateful.pairwise_averages(timed([("a", i, v) for i, v in enumerate((3, 5, 7, 4, 2))], "k string, ts timestamp, v long"), "k", "ts", "v")
    assert [r for r in rows(routing.run_to_memory(pairs, name())) if r[0] == "a"] == [("a", 4), ("a", 5)]
    fails = stateful.login_failures(timed([("a", s, True) for s in (0, 1, 4)] + [("b", 0, True), ("b", 1, False)], "k string, ts timestamp, bad boolean"), "k", "ts", "bad")
    assert [(r[0], r[3]) for r in rows(routing.run_to_memory(fails, name())) if r[0] is not None] == [("a", 3)]
    ads = stateful.blacklisted(timed([("u", i, "ad") for i in range(5)], "k string, ts timestamp, ad string"), ("k", "ad"), "ts", 3)
    assert sorted(r.verdict for r in routing.run_to_memory(ads, name()).where("key1 = 'u'").collect()) == ["pass", "pass", "pass", "warn"]


def test_stream_joins(spark, tmp_path, rows):
    e = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "event_id")
    sides = {}
    for kind, p in (("purchase", "a"), ("signup", "b")):
        d = e.where(F.col("event_type") == kind).select(F.col("ts").alias(f"{p}_ts"), F.col("user_id").alias(f"{p}_user"), F.col("event_id").alias(f"{p}_id"))
        at = str(tmp_path / p)
        routing.with_sentinel(d, f"{p}_ts").coalesce(1).sortWithinPartitions(f"{p}_ts").write.parquet(at)
        sides[p] = d, windows.event_time_watermark(spark.readStream.schema(d.schema).parquet(at), f"{p}_ts", "1 minute")
    f = lambda i, how: joins.interval_join(sides["a"][i], sides["b"][i], "a_user", "b_user", "a_ts", "b_ts", "-2 hours", "3 hours", how).select("a_id", "b_id")
    assert rows(routing.run_to_memory(f(1, "inner"), name())) == rows(f(0, "inner"))
    got, want = set(rows(routing.run_to_memory(f(1, "left"), name()))), set(rows(f(0, "left")))
    assert {r for r in got if r[0] is not None} <= want and all(r[1] is None for r in want - got)  # the last unmatched rows wait for a later batch
    same = lambda i: joins.window_join(sides["a"][i].withColumnRenamed("a_user", "u"), sides["b"][i].withColumnRenamed("b_user", "u"), "u", "a_ts", "b_ts", "1 hour").select("a_id", "b_id")
    assert rows(routing.run_to_memory(same(1), name())) == rows(same(0))


def test_complete_mode_order_by(spark, tmp_path, rows):
    e = spark.read.parquet(f"{SF}/events.parquet").select("event_type", "user_id")
    e.repartition(3).write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    f = lambda d: d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type").limit(3)
    assert rows(routing.run_to_memory(f(s), name(), "complete")) == rows(f(e))


def test_update_mode_refines_a_window(spark, tmp_path):
    """Early results, and again after a row that is late but allowed; too late rows change nothing."""
    t0 = datetime.datetime(2024, 1, 1)
    out = []
    for k, part in enumerate([[1, 2, 15], [3], [40], [4]]):
        spark.createDataFrame([(t0 + datetime.timedelta(seconds=x),) for x in part], "ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        s = windows.event_time_watermark(spark.readStream.schema("ts timestamp").option("recursiveFileLookup", True).parquet(str(tmp_path / "in")), "ts", "10 seconds")
        counts = s.groupBy(F.window("ts", "10 seconds")).agg(F.count(F.lit(1)).alias("n"))
        counts.writeStream.outputMode("update").foreachBatch(lambda d, b: out.extend((r.window.start.second, r.n) for r in d.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [n for at, n in out if at == 0] == [2, 3]
