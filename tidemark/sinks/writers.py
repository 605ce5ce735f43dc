"""Sinks for batches and, through foreachBatch, for streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def console(stream: DataFrame, label: str, mode: str = "append") -> StreamingQuery:
    return stream.writeStream.format("console").queryName(label).outputMode(mode).option("truncate", False).start()


def kafka(records: DataFrame, servers: str, checkpoint: str, topic: str | None = None) -> StreamingQuery:
    """Text values to Kafka, to ``topic`` or to each record's own column ``topic``. Delivery is at least once."""
    out = records.select(*(c for c in ("topic", "key", "value") if c in records.columns and not (topic and c == "topic")))
    writer = out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("checkpointLocation", checkpoint)
    return (writer.option("topic", topic) if topic else writer).start()


def topic_files(records: DataFrame, path: str, checkpoint: str | None = None, prefix: str = "dwd"):
    """Each record into the folder of its target topic (``prefix`` + topic), exactly once on a stream."""
    out = records.select(F.concat(F.lit(prefix), "topic").alias("topic"), "value")
    if not records.isStreaming:
        out.write.mode("append").partitionBy("topic").text(path)
        return None
    return out.writeStream.format("text").partitionBy("topic").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def csv(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).csv(path)


def json_documents(df: DataFrame, path: str, columns: dict[str, str], mode: str = "append") -> None:
    """Documents whose fields are all text, under other names: {field: column}."""
    pairs = [x for name, c in columns.items() for x in (F.lit(name), F.col(c).cast("string"))]
    df.select(F.to_json(F.create_map(*pairs)).alias("value")).write.mode(mode).text(path)


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, so that an upsert sees every key once."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


class KeyedTable:
    """A table with a primary key as versioned Parquet: every upsert writes a new version and then names it
    current, so readers never see half of one, and a batch that is run again changes nothing."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]) -> None:
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        path, fs = self._fs()
        if not fs.exists(path(self.path)):
            return -1
        done = [s.getPath() for s in fs.listStatus(path(self.path)) if fs.exists(path(f"{s.getPath()}/_SUCCESS"))]
        return max((int(p.getName()[1:]) for p in done if p.getName().startswith("v")), default=-1)

    def read(self) -> DataFrame:
        v = self.version()
        return self.spark.createDataFrame([], self.schema) if v < 0 else self.spark.read.schema(self.schema).parquet(f"{self.path}/v{v}")

    def write(self, df: DataFrame, version: int) -> None:
        df.select(*self.read().columns).write.mode("overwrite").parquet(f"{self.path}/v{version}")

    def upsert(self, changes: DataFrame, batch_id: int | None = None, op: str | None = None, combine: dict[str, str] | None = None) -> None:
        """Rows replace those of equal key; with ``op`` = D they delete; ``combine`` are expressions over new
        columns and old ones (``old_`` + name) for columns that add up. Keys must be unique in ``changes``."""
        version = self.version() + 1 if batch_id is None else batch_id
        if batch_id is not None and self.version() >= batch_id:
            return
        old = self.read()
        names = old.columns
        renamed = old.select(*[F.col(c).alias(c if c in self.keys else f"old_{c}") for c in names])
        live = changes.where(F.col(op) != "D") if op else changes
        merged = live.join(renamed, self.keys, "left").select(*[F.expr((combine or {}).get(c, c)).alias(c) for c in names])
        self.write(old.join(changes.select(*self.keys), self.keys, "left_anti").unionByName(merged), version)


def keyed_sink(table: KeyedTable, order: list[str], op: str | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: newest row of each key, upserted once for each batch number."""
    return lambda df, batch_id: table.upsert(last_per_key(df, table.keys, order), batch_id, op)


def jdbc_insert(df: DataFrame, url: str, table: str, driver: str | None = None) -> None:
    writer = df.write.format("jdbc").option("url", url).option("dbtable", table)
    (writer.option("driver", driver) if driver else writer).mode("append").save()


def jdbc_upsert(df: DataFrame, url: str, table: str, keys: list[str], order: list[str], driver: str | None = None, op: str | None = None) -> None:
    """Update rows of known keys, insert the others; with ``op`` = D, delete.

    The newest row of each key is written in parallel to staging tables of the database, shaped like the
    table, and a few statements in one transaction bring them into it: nothing passes through the driver.
    An error undoes all of it, and a batch that runs again comes to the same table.
    """
    rows = last_per_key(df, keys, order)
    columns = [c for c in rows.columns if c != op]
    new, gone = f"{table}_tidemark_new", f"{table}_tidemark_gone"
    jvm = df.sparkSession.sparkContext._jvm
    quoted = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier
    names, key_names = ", ".join(map(quoted, columns)), ", ".join(map(quoted, keys))
    same = " AND ".join(f"s.{quoted(k)} = {table}.{quoted(k)}" for k in keys)
    assign = ", ".join(f"{quoted(c)} = (SELECT s.{quoted(c)} FROM {new} s WHERE {same})" for c in columns if c not in keys)
    if driver:
        jvm.java.lang.Class.forName(driver)
    connection = jvm.java.sql.DriverManager.getConnection(url)
    statement = connection.createStatement()

    def drop() -> None:
        for name in (new, gone):
            if connection.getMetaData().getTables(None, None, name.upper(), None).next() or connection.getMetaData().getTables(None, None, name, None).next():
                statement.executeUpdate(f"DROP TABLE {name}")

    try:
        drop()  # what a failed batch left
        statement.executeUpdate(f"CREATE TABLE {new} AS SELECT {names} FROM {table} WITH NO DATA")
        statement.executeUpdate(f"CREATE TABLE {gone} AS SELECT {key_names} FROM {table} WITH NO DATA")
        jdbc_insert((rows.where(F.col(op) != "D") if op else rows).select(*columns), url, new, driver)
        if op:
            jdbc_insert(rows.where(F.col(op) == "D").select(*keys), url, gone, driver)
        connection.setAutoCommit(False)
        statement.executeUpdate(f"DELETE FROM {table} WHERE EXISTS (SELECT 1 FROM {gone} s WHERE {same})")
        if assign:
            statement.executeUpdate(f"UPDATE {table} SET {assign} WHERE EXISTS (SELECT 1 FROM {new} s WHERE {same})")
        statement.executeUpdate(f"INSERT INTO {table} ({names}) SELECT {names} FROM {new} s WHERE NOT EXISTS (SELECT 1 FROM {table} WHERE {same})")
        connection.commit()
        drop()
        connection.commit()
    except Exception:
        if not connection.getAutoCommit():
            connection.rollback()
        raise
    finally:
        connection.close()


def time_partitioned(df: DataFrame, ts: str) -> DataFrame:
    """Adds ts_date, ts_hour and ts_minute."""
    return df.withColumn("ts_date", F.date_format(ts, "yyyy-MM-dd")).withColumn("ts_hour", F.date_format(ts, "HH")).withColumn("ts_minute", F.date_format(ts, "mm"))


def commit_partitions(spark: SparkSession, path: str, until, since=None) -> list[str]:
    """Marks with _SUCCESS every minute partition that ended at or before ``until`` (a datetime: the watermark
    less the commit delay). Days before ``since`` are not listed again. Returns the newly marked ones."""
    import datetime

    jvm = spark.sparkContext._jvm
    path_of = jvm.org.apache.hadoop.fs.Path
    fs = path_of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new = []
    days = [d.getPath() for d in fs.globStatus(path_of(f"{path}/ts_date=*"))]
    days = [d for d in days if since is None or d.getName() >= f"ts_date={since:%Y-%m-%d}"]
    for status in (s for d in days for s in fs.globStatus(path_of(f"{d}/ts_hour=*/ts_minute=*"))):
        parts = dict(x.split("=", 1) for x in status.getPath().toString().rsplit("/", 3)[1:])
        end = datetime.datetime.strptime(f"{parts['ts_date']} {parts['ts_hour']}:{parts['ts_minute']}", "%Y-%m-%d %H:%M") + datetime.timedelta(minutes=1)
        marker = path_of(f"{status.getPath()}/_SUCCESS")
        if end <= until and not fs.exists(marker):
            fs.create(marker).close()
            new.append(f"{parts['ts_date']} {parts['ts_hour']}:{parts['ts_minute']}")
    return sorted(new)


def parquet_by_minute(stream: DataFrame, path: str, checkpoint: str, ts: str, delay_minutes: int = 1) -> StreamingQuery:
    """Stream to minute partitions; a partition is committed when event time has passed its end by the delay.

    Each batch writes below its own number (partition column ``batch``) and replaces what an earlier try of it
    left, so rows come once. The newest event time is kept by batch beside the checkpoint and outlives restarts."""
    return stream.writeStream.foreachBatch(minute_batches(stream.sparkSession, path, f"{checkpoint.rstrip('/')}-newest", ts, delay_minutes)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def minute_batches(spark: SparkSession, path: str, marks: str, ts: str, delay_minutes: int = 1) -> Callable[[DataFrame, int], None]:
    """The foreachBatch function of ``parquet_by_minute``."""
    import datetime

    delay = datetime.timedelta(minutes=delay_minutes)

    def write(df: DataFrame, batch_id: int) -> None:
        out = time_partitioned(df, ts).withColumn("batch", F.lit(batch_id).cast("long"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ts_date", "ts_hour", "ts_minute", "batch").parquet(path)
        df.agg(F.min(ts).cast("timestamp").alias("oldest"), F.max(ts).cast("timestamp").alias("newest")).write.mode("overwrite").parquet(f"{marks}/batch_id={batch_id}")
        seen = spark.read.schema("oldest timestamp, newest timestamp, batch_id bigint").parquet(marks).where(F.col("batch_id") <= batch_id)
        mine = F.col("batch_id") == batch_id
        newest, before, oldest = seen.agg(F.max("newest"), F.max(F.when(~mine, F.col("newest"))), F.min(F.when(mine, F.col("oldest")))).first()
        if newest is not None:
            since = min(x for x in (before and before - delay, oldest, newest - delay) if x is not None) if before else None
            commit_partitions(spark, path, newest - delay, since)

    return write
