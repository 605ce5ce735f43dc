"""Sources, sinks and jobs."""

import datetime

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.plans import jobs
from tidemark.sinks import writers
from tidemark.sources import generators, readers

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def test_text_csv_json(spark, tmp_path, rows):
    (tmp_path / "s.csv").write_text("sensor_1, 1547718199, 35.8\nsensor_6,1547718201,15.4\n")
    assert readers.lines(spark, str(tmp_path / "s.csv")).count() == 2
    df = readers.csv_table(spark, str(tmp_path / "s.csv"), schemas.SENSOR, "sensor_table")
    assert rows(spark.sql("SELECT id, temperature FROM sensor_table WHERE id = 'sensor_1'")) == [("sensor_1", 35.8)]
    writers.csv(df.select("id", "temperature"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out")).count() == 2
    timed = readers.csv_table_with_row_time(spark, str(tmp_path / "s.csv"), schemas.SENSOR, "timestamp", "1 second")
    assert str(timed.first().rt) == "2019-01-17 09:43:19"
    writers.json_documents(df, str(tmp_path / "docs"), {"sensor_id": "id", "temp": "temperature"})
    assert '"sensor_id":"sensor_1"' in "".join(r.value for r in spark.read.text(str(tmp_path / "docs")).collect())
    assert readers.collection(spark, [(1, 3), (1, 5)], "f0 long, f1 long").count() == 2
    assert readers.socket_arguments(["--host", "h", "--port", "5"]) == ("h", 5)


def test_jdbc_upsert_insert_delete(spark, rows):
    url = "jdbc:derby:memory:tidemark;create=true"
    spark.createDataFrame([("a", 1.0)], "id string, temp double").write.format("jdbc").option("url", url).option("dbtable", "temps").option("driver", DERBY).option("createTableColumnTypes", "id varchar(20)").save()
    changes = spark.createDataFrame([("a", 2.0), ("b", 4.0)], "id string, temp double")
    writers.jdbc_upsert(changes, url, "temps", ["id"], ["temp"], DERBY)
    assert rows(readers.jdbc_table(spark, url, "temps", DERBY), "id", "temp") == [("a", 2.0), ("b", 4.0)]
    writers.jdbc_upsert(spark.createDataFrame([("b", 4.0, "D"), ("c", 6.0, "I")], "id string, temp double, op string"), url, "temps", ["id"], ["temp"], DERBY, op="op")
    writers.jdbc_insert(spark.createDataFrame([("d", 7.0)], "id string, temp double"), url, "temps", DERBY)
    got = readers.jdbc_query(spark, url, 'SELECT * FROM temps WHERE "temp" > 1', DERBY)
    assert sorted((r["id"], r["temp"]) for r in got.collect()) == [("a", 2.0), ("c", 6.0), ("d", 7.0)]


def test_keyed_table_combine(spark, tmp_path, rows):
    t = writers.KeyedTable(spark, str(tmp_path / "m"), "uid int, dn string, paymoney decimal(18,4)", ["uid", "dn"])
    pay = lambda *r: spark.createDataFrame(r, "uid int, dn string, m string").select("uid", "dn", F.col("m").cast("decimal(18,4)").alias("paymoney"))
    add = {"paymoney": "cast(paymoney + coalesce(old_paymoney, 0) as decimal(18,4))"}
    t.upsert(pay((1, "a", "2.5"), (2, "a", "1")), combine=add)
    t.upsert(pay((1, "a", "2.5")), combine=add)
    t.upsert(pay((1, "a", "100")), batch_id=1, combine=add)  # an old batch number: done before
    assert [(r.uid, float(r.paymoney)) for r in t.read().orderBy("uid").collect()] == [(1, 5.0), (2, 1.0)]


def test_topics(spark, tmp_path, rows):
    recs = spark.createDataFrame([("member", '{"a":1}'), ("basead", "{}")], "topic string, value string")
    writers.topic_files(recs, str(tmp_path / "t"))
    assert rows(readers.topic_files(spark, str(tmp_path / "t"))) == [("dwdbasead", "{}"), ("dwdmember", '{"a":1}')]
    s = readers.topic_files(spark, str(tmp_path / "t"), streaming=True)
    writers.topic_files(s, str(tmp_path / "u"), str(tmp_path / "cp"), prefix="x").awaitTermination()
    assert readers.topic_files(spark, str(tmp_path / "u")).count() == 2


def test_minute_partitions_commit(spark, tmp_path):
    df = spark.createDataFrame([(1, datetime.datetime(2020, 7, 15, 10, 0, 30)), (2, datetime.datetime(2020, 7, 15, 10, 1, 30)), (3, datetime.datetime(2020, 7, 15, 10, 3, 0))], "i int, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "src"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "src"))
    out = str(tmp_path / "out")
    writers.parquet_by_minute(s, out, str(tmp_path / "cp"), "ts").awaitTermination()
    assert writers.commit_partitions(spark, out, datetime.datetime(2020, 7, 15, 10, 2)) == []  # marked before, as event time reached 10:03
    assert writers.commit_partitions(spark, out, datetime.datetime(2020, 7, 15, 10, 9)) == ["2020-07-15 10:03"]
    pruned = spark.read.parquet(out).where("ts_date >= '2020-07-15' and ts_minute = '01'")
    assert [r.i for r in pruned.collect()] == [2] and "PartitionFilters: [" in pruned._jdf.queryExecution().executedPlan().toString()


def test_generators(spark):
    assert generators.sensors(spark, 5).count() == 50
    assert generators.marketing(spark, 100).select("channel").distinct().count() == 5
    assert generators.sensors(spark, rate=5).isStreaming and generators.marketing(spark, rate=5).isStreaming
    t = generators.warehouse_topics(spark, 50, 70)
    assert t.groupBy("topic").count().count() == 6


def test_warehouse(spark):
    routed = jobs.route_topics(generators.warehouse_topics(spark, 60, 80).union(spark.createDataFrame([("member", "no json")], "topic string, value string")))
    assert {r.route for r in routed.select("route").distinct().collect()} == {"fact", "dimension"}
    wide = jobs.dim_member(routed)
    assert wide.columns == ["row_key", *schemas.DIM_MEMBER] and wide.select("uid").distinct().count() == 60
    r = wide.where("ad_id is not null").first()
    assert r.adname == f"ad-{r.ad_id}" and r.bdp_uuid != ""
    rows, keys = jobs.dimension_rows(routed)["basead"]
    assert keys == ["adid", "dn"] and rows.count() == 30


def test_binlog(spark):
    fields = ",".join(f'"f{i:02d}":"{i}"' for i in range(15))
    msgs = [f'{{"isDdl":"false","table":"t_meeting_info","type":"INSERT","data":[{{{fields}}}]}}', f'{{"isDdl":"false","table":"t_meeting_info","type":"UPDATE","data":[{{{fields}}}]}}', "junk"]
    rooms = spark.createDataFrame([(7, "room", 1, "loc", "city")], schemas.MEETING_ADDRESS)
    got = jobs.meetings(spark.createDataFrame([(m,) for m in msgs], "value string"), rooms).collect()
    assert [tuple(r) for r in got] == [(0, "1", 7, "room", "loc", "city")]


def test_record_readers(spark, tmp_path, rows):
    recs = spark.createDataFrame([("a", "1,2,pv", datetime.datetime(2024, 1, 1)), ("b", '{"user":"7","n":"x"}', datetime.datetime(2024, 1, 1))], "topic string, value string, timestamp timestamp")
    r = readers.csv_records(recs.where("topic = 'a'"), "user_id bigint, item_id bigint, behavior string").first()
    assert (r.user_id, r.behavior, r.ts) == (1, "pv", datetime.datetime(2024, 1, 1))
    assert rows(readers.json_topic(recs, "b", "user string, n string, missing int")) == [("7", "x", None)]
    assert rows(readers.as_topic(spark.createDataFrame([("l",)], "value string"), "t")) == [("t", "l")]


def test_partitioned_stream_and_marker_watermark(spark, tmp_path):
    df = spark.createDataFrame([(1, "sensor_1", datetime.datetime(2024, 1, 1)), (2, "sensor_2", datetime.datetime(2024, 1, 2))], "i int, id string, ts timestamp")
    df.write.partitionBy("id").parquet(str(tmp_path / "p"))
    s = readers.partitioned_parquet(spark, str(tmp_path / "p"), "i int, ts timestamp, id string", streaming=True)
    assert s.isStreaming and readers.partitioned_parquet(spark, str(tmp_path / "p"), "i int, ts timestamp, id string").count() == 2
    marked = readers.with_marker_watermark(df, "ts", F.col("id") == "sensor_1", "1 second")
    assert [r.mark_time is None for r in marked.orderBy("i").collect()] == [False, True]
    assert "pt" in readers.with_processing_time(df).columns


def test_supervised_restarts(spark):
    from tidemark.streaming.routing import supervised

    calls = []

    class Query:
        def awaitTermination(self):
            calls.append(1)
            if len(calls) < 3:
                raise RuntimeError("lost")

    supervised(Query, attempts=3, pause=0)
    assert len(calls) == 3
