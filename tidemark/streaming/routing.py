"""Late rows, changelogs, and running streams to their end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.windows import seconds


class LateRouter:
    """foreachBatch function that parts rows older than the watermark from the others.

    The watermark is the newest event time of earlier batches less ``delay``. It is kept beside the
    checkpoint, by batch number, so a batch that runs again is parted in the same way.
    """

    def __init__(self, spark: SparkSession, path: str, ts: str, delay: str, on_time: Callable, late: Callable) -> None:
        self.spark, self.path, self.ts, self.delay, self.on_time, self.late = spark, path.rstrip("/"), ts, seconds(delay), on_time, late

    def newest_before(self, batch_id: int):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return None
        marks = self.spark.read.schema("newest timestamp, batch_id bigint").parquet(self.path)
        return marks.where(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]

    def __call__(self, df: DataFrame, batch_id: int) -> None:
        import datetime

        newest = self.newest_before(batch_id)
        ts = F.col(self.ts).cast("timestamp")
        if newest is None:
            self.on_time(df, batch_id)
        else:
            limit = newest - datetime.timedelta(seconds=self.delay)
            self.on_time(df.where(ts.isNull() | (ts >= F.lit(limit))), batch_id)
            self.late(df.where(ts < F.lit(limit)), batch_id)
        df.agg(F.max(ts).alias("newest")).where("newest is not null").write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")


def retractions(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Changelog between two states of a keyed result: (is_add = false, old row), (is_add = true, new row).

    Keys are unique in a state, so one full join by key finds what changed."""
    names = after.columns
    old = before.select(F.struct(*names).alias("old"), *[F.col(k).alias(f"__old_{k}") for k in keys])
    new = after.select(F.struct(*names).alias("new"), *[F.col(k).alias(f"__new_{k}") for k in keys])
    same = [F.col(f"__old_{k}").eqNullSafe(F.col(f"__new_{k}")) for k in keys]
    changed = old.join(new, same, "full").where(~F.col("old").eqNullSafe(F.col("new")))
    row = lambda add, side: F.when(F.col(side).isNotNull(), F.struct(F.lit(add).alias("is_add"), F.col(side).alias("r")))
    steps = F.filter(F.array(row(False, "old"), row(True, "new")), lambda x: x.isNotNull())
    return changed.select(F.explode(steps).alias("step")).select("step.is_add", "step.r.*")


def additions(changelog: DataFrame) -> DataFrame:
    return changelog.where("is_add").drop("is_add")


def with_sentinel(df: DataFrame, ts: str, at: str = "2999-01-01 00:00:00") -> DataFrame:
    """A row far in the future that closes all windows before it at the end of a bounded stream."""
    columns = [F.lit(at).cast("timestamp").alias(c) if c == ts else F.lit(None).cast(kind).alias(c) for c, kind in df.dtypes]
    return df.unionByName(df.sparkSession.range(1).select(*columns))


def run_to_memory(stream: DataFrame, name: str, mode: str = "append", **options: str) -> DataFrame:
    """Runs a bounded stream to its end into a memory table: for tests and small results."""
    query: StreamingQuery = stream.writeStream.format("memory").queryName(name).outputMode(mode).options(**options).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def started(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", interval: str | None = None) -> StreamingQuery:
    """Starts a stream into a foreachBatch function. Watermarks and results advance once a batch: every ``interval``
    (such as "300 milliseconds"), or, without one, once for all that is there until the input is used up."""
    writer = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def supervised(start: Callable[[], StreamingQuery], attempts: int = 3, pause: float = 10.0) -> None:
    """Runs a query to its end, starting it again from its checkpoint after failures."""
    import time

    for attempt in range(attempts + 1):
        try:
            start().awaitTermination()
            return
        except Exception:
            if attempt == attempts:
                raise
            time.sleep(pause)
