"""Allowed lateness, triggers, idle state, exactly-once partitions, tables by name, and Kafka options."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.operators import mappers
from tidemark.sinks import writers
from tidemark.sources import catalog, readers
from tidemark.streaming import lateness, routing, stateful

T0 = datetime.datetime(2024, 1, 1)


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def in_batches(spark, at, batches):
    """A stream that reads one file a batch, in order."""
    schema = "k string, ts timestamp, v double"
    for i, batch in enumerate(batches):
        spark.createDataFrame([("a", T0 + datetime.timedelta(seconds=s), float(s)) for s in batch], schema).coalesce(1).write.parquet(f"{at}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/*")


def firings(df):
    out = routing.run_to_memory(df, "t" + uuid.uuid4().hex)
    second = lambda c: (F.unix_timestamp(c) - int(T0.replace(tzinfo=datetime.timezone.utc).timestamp())).cast("int")
    return sorted(tuple(r) for r in out.select(second("window_start"), "n", "total", "firing").collect())


BATCHES = [[1, 5], [21], [7], [45], [3], [100], [101]]


def test_late_rows_fire_again(spark, tmp_path, rocksdb):
    """[0, 15) ends when 21 has come; 7 is late and fires it again; 3 comes when 45 has passed its lateness."""
    s = in_batches(spark, str(tmp_path / "in"), BATCHES)
    got = firings(lateness.late_windows(s, "k", "ts", "v", "15 seconds", lateness="10 seconds"))
    assert got == [(0, 2, 6.0, "end"), (0, 3, 13.0, "late"), (15, 1, 21.0, "end"), (45, 1, 45.0, "end")]


def test_triggers_on_every_row(spark, tmp_path, rocksdb):
    s = in_batches(spark, str(tmp_path / "in"), BATCHES)
    got = firings(lateness.late_windows(s, "k", "ts", "v", "15 seconds", lateness="10 seconds", trigger="every"))
    assert got == [(0, 1, 1.0, "row"), (0, 2, 6.0, "row"), (0, 3, 13.0, "row"), (15, 1, 21.0, "row"), (45, 1, 45.0, "row"), (90, 1, 100.0, "row"), (90, 2, 201.0, "row")]
    got = firings(lateness.late_windows(s, "k", "ts", "v", "15 seconds", trigger="every_purging"))
    assert [g[2] for g in got if g[0] == 0][:2] == [1.0, 5.0] and all(g[1] == 1 for g in got)
    with pytest.raises(ValueError):
        lateness.late_windows(s, "k", "ts", "v", "15 seconds", trigger="never")


def test_idle_state_is_dropped(spark, tmp_path, rocksdb):
    """One value waits; it is forgotten when the key stays idle longer than its state is kept."""
    import time

    for retain, want in ((1, []), (86_400_000, [2])):  # a query with processing time goes on by itself, so it is stopped
        at, found, seen = str(tmp_path / f"in{retain}"), [], []
        put = lambda i, v, at=at: spark.createDataFrame([("a", i, v)], "k string, seq long, v long").coalesce(1).write.mode("append").parquet(at)
        put(0, 1)
        s = spark.readStream.schema("k string, seq long, v long").parquet(at)
        query = routing.started(stateful.pairwise_averages(s, "k", "seq", "v", retain_ms=retain), lambda d, b, f=found, n=seen: (f.extend(r.average for r in d.collect()), n.append(b)), str(tmp_path / f"cp{retain}"), interval="300 milliseconds")
        try:
            for i, v in ((0, None), (1, 3)):
                if v:
                    put(i, v)
                until = time.time() + 20
                while sum(p.numInputRows for p in query.recentProgress) < i + 1 and time.time() < until:
                    time.sleep(0.2)
                time.sleep(0.5)
        finally:
            query.stop()
        assert seen and found == want, retain


def test_minutes_come_once(spark, tmp_path):
    path, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    rows = lambda *s: spark.createDataFrame([(x, T0 + datetime.timedelta(seconds=x)) for x in s], "i long, ts timestamp")
    write = writers.minute_batches(spark, path, marks, "ts")
    write(rows(1, 2, 70), 0)
    write(rows(1, 2, 70), 0)  # the same batch again
    assert sorted(r.i for r in spark.read.parquet(path).collect()) == [1, 2, 70]
    writers.minute_batches(spark, path, marks, "ts")(rows(200), 1)  # after a restart
    assert writers.commit_partitions(spark, path, T0 + datetime.timedelta(seconds=139)) == []  # both early minutes are marked
    assert writers.commit_partitions(spark, path, T0 + datetime.timedelta(seconds=900), T0 + datetime.timedelta(days=1)) == []
    assert writers.commit_partitions(spark, path, T0 + datetime.timedelta(seconds=900)) == ["2024-01-01 00:03"]


def test_tables_by_name(spark, tmp_path, rows):
    db = "d" + uuid.uuid4().hex[:8]
    catalog.create_database(spark, db)
    for name in ("source", "target"):
        catalog.create_table(spark, f"{db}.{name}", "id long, v string", keys=["id"], location=str(tmp_path / name))
    assert catalog.primary_key(spark, f"{db}.target") == ["id"]
    catalog.insert_into(spark, f"{db}.source", spark.createDataFrame([("a", 1)], "v string, id long"))
    catalog.insert_into(spark, f"{db}.target", f"SELECT v, id + 1 AS id FROM {db}.source")
    assert rows(spark.table(f"{db}.target"), "id", "v") == [(2, "a")]
    (tmp_path / "x.csv").write_text("1;b\n")
    catalog.create_table(spark, f"{db}.csv", "id long, v string", "csv", path=str(tmp_path / "x.csv"), sep=";")
    assert rows(spark.table(f"{db}.csv")) == [(1, "b")] and catalog.primary_key(spark, f"{db}.csv") == []
    assert "Scan" in catalog.described(spark.table(f"{db}.csv")) and "id: long" in catalog.described(spark.table(f"{db}.csv"))
    catalog.use_catalog(spark, "spark_catalog", "default")
    catalog.drop_table(spark, f"{db}.csv")
    assert not spark.catalog.tableExists(f"{db}.csv")


def test_mapper_with_a_life_cycle(spark, tmp_path, rows):
    import pyarrow as pa

    mark = str(tmp_path / "closed")
    out = mappers.rich_map(spark.range(3), "id long, zero long", lambda b, r: pa.RecordBatch.from_arrays([b.column(0), pa.array([r] * b.num_rows)], ["id", "zero"]), lambda: 0, lambda r: open(mark, "w").close())
    assert rows(out) == [(0, 0), (1, 0), (2, 0)] and (tmp_path / "closed").exists()


def test_snapshot_then_changes(spark, rows):
    from tidemark.operators.joins import latest

    snapshot = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    changes = spark.createDataFrame([("U", 5, 1, "A"), ("D", 6, 2, None)], "op string, seq bigint, id long, v string")
    assert rows(latest(readers.snapshot_then_changes(snapshot, changes), ["id"], "seq"), "id", "v") == [(1, "A")]


class Recorder:
    """Stands for a reader or writer of a connector that is not there: keeps what it is given."""

    def __init__(self, result=None):
        self.kind, self.kept, self.result = None, {}, result

    def format(self, kind):
        self.kind = kind
        return self

    def option(self, name, value):
        self.kept[name] = value
        return self

    def options(self, **more):
        self.kept |= more
        return self

    def load(self):
        return self.result

    start = load


def test_kafka_options_and_columns(spark, rows):
    class Session:
        readStream = Recorder(spark.createDataFrame([("t", bytearray(b"x"), T0, 7)], "topic string, value binary, timestamp timestamp, offset long"))

    got = readers.kafka(Session, "h:1", ["t", "u"], "earliest", "g", maxOffsetsPerTrigger="5")
    assert Session.readStream.kind == "kafka" and rows(got) == [("t", "x", T0)]
    assert Session.readStream.kept == {"kafka.bootstrap.servers": "h:1", "subscribe": "t,u", "startingOffsets": "earliest", "kafka.group.id": "g", "maxOffsetsPerTrigger": "5"}

    class Stream:
        columns = ["topic", "value", "extra"]

        def select(self, *names):
            self.sent, self.writeStream = names, Recorder("started")
            return self

    for topic, sent in (("out", ("value",)), (None, ("topic", "value"))):
        s = Stream()
        assert writers.kafka(s, "h:1", "/cp", topic) == "started" and s.sent == sent
        assert s.writeStream.kept == {"kafka.bootstrap.servers": "h:1", "checkpointLocation": "/cp"} | ({"topic": topic} if topic else {})
