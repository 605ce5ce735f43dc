"""Sources. Each takes ``streaming`` where both forms make sense; the columns are the same."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.windows import event_time_watermark


def collection(spark: SparkSession, rows: Iterable, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Text lines, column ``value``."""
    return (spark.readStream if streaming else spark.read).text(path)


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Stream of lines from a socket; for trials only, as it can't be read again after a failure."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def socket_arguments(arguments: list[str] | None = None) -> tuple[str, int]:
    """Host and port from the command line: --host, --port."""
    import argparse

    parser = argparse.ArgumentParser()
    parser.add_argument("--host", default="localhost")
    parser.add_argument("--port", type=int, default=7777)
    a = parser.parse_args(arguments)
    return a.host, a.port


def kafka(spark: SparkSession, servers: str, topics: list[str], starting: str = "latest", group: str | None = None, **options: str) -> DataFrame:
    """Stream of topic, value (text) and the record's timestamp. Needs Spark's Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", starting)
    if group:
        reader = reader.option("kafka.group.id", group)
    return reader.options(**options).load().select("topic", F.col("value").cast("string").alias("value"), "timestamp")


def topic_files(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """The same shape from files of text under folders topic=<name>: replays, tests, and clusters without Kafka."""
    reader = (spark.readStream if streaming else spark.read).schema("value string, topic string")
    return reader.text(path).select("topic", "value")


def as_topic(lines: DataFrame, topic: str) -> DataFrame:
    """Lines as records of one topic, to seed it from a file through a Kafka or topic-file sink."""
    return lines.select(F.lit(topic).alias("topic"), F.col("value"))


def csv_table(spark: SparkSession, path: str, schema: str, name: str | None = None, streaming: bool = False, header: bool = False) -> DataFrame:
    """CSV files as a table, also registered as a view if named."""
    df = (spark.readStream if streaming else spark.read).schema(schema).option("header", header).option("ignoreLeadingWhiteSpace", True).csv(path)
    if name:
        df.createOrReplaceTempView(name)
    return df


def csv_table_with_row_time(spark: SparkSession, path: str, schema: str, seconds_col: str, delay: str, row_time: str = "rt", streaming: bool = False) -> DataFrame:
    """CSV table with a computed event time (from epoch seconds) and its watermark."""
    df = csv_table(spark, path, schema, streaming=streaming).withColumn(row_time, F.timestamp_seconds(seconds_col))
    return event_time_watermark(df, row_time, delay) if streaming else df.where(F.col(row_time).isNotNull())


def csv_records(records: DataFrame, schema: str, delay: str = "0 seconds", value: str = "value", timestamp: str = "timestamp") -> DataFrame:
    """CSV values of a topic with the record's own timestamp as event time ``ts``."""
    out = records.select(F.from_csv(F.col(value), schema).alias("r"), F.col(timestamp).alias("ts")).select("r.*", "ts")
    return event_time_watermark(out, "ts", delay) if out.isStreaming else out


def json_records(records: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """JSON values; errors and missing fields are null."""
    return records.select(F.from_json(F.col(value), schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")


def json_topic(records: DataFrame, topic: str, schema: str) -> DataFrame:
    """One topic's records as typed columns; generators write every field as text, so they are cast by name."""
    return json_records(records.where(F.col("topic") == topic), schema)


def change_files(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, streaming: bool = False) -> DataFrame:
    """Change log of a table as JSON files: op (I, U, D), seq, and the table's columns or some of them."""
    df = (spark.readStream if streaming else spark.read).schema(f"op string, seq bigint, {schema}").json(path)
    return df.select("op", "seq", *columns) if columns else df


def snapshot_then_changes(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """A changing table from its beginning: the rows it had as inserts with sequence number 0, then its changes."""
    names = [c for c in changes.columns if c not in ("op", "seq")]
    return snapshot.select(F.lit("I").alias("op"), F.lit(0).cast("long").alias("seq"), *names).unionByName(changes.select("op", "seq", *names))


def partitioned_parquet(spark: SparkSession, path: str, schema: str, streaming: bool = False, max_files: int = 1000) -> DataFrame:
    """Partitioned Parquet as table or as stream of new files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path) if streaming else spark.read.schema(schema).parquet(path)


def jdbc_query(spark: SparkSession, url: str, query: str, driver: str | None = None, **options: str) -> DataFrame:
    """A query the database runs (joins are pushed into it), as a bounded table."""
    reader = spark.read.format("jdbc").option("url", url).option("query", query).options(**options)
    return (reader.option("driver", driver) if driver else reader).load()


def jdbc_table(spark: SparkSession, url: str, table: str, driver: str | None = None, partition_column: str | None = None, bounds: tuple[int, int] = (0, 0), partitions: int = 1) -> DataFrame:
    """A table read over JDBC, in parallel if a partition column is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if driver:
        reader = reader.option("driver", driver)
    if partition_column:
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def with_processing_time(df: DataFrame, name: str = "pt") -> DataFrame:
    return df.withColumn(name, F.current_timestamp())


def with_marker_watermark(df: DataFrame, ts: str, marks, delay: str, name: str = "mark_time") -> DataFrame:
    """Watermark that only marker rows advance: the watermark column is null on all others."""
    return df.withColumn(name, F.when(marks, F.col(ts).cast("timestamp"))).withWatermark(name, delay)
