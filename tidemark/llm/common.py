"""Shared helpers of the training-data operators: lineage cuts, text expressions, worker caches.

Work tables go to the folder the cluster names in ``spark.checkpoint.dir``; a private temporary
folder is made only when that setting is absent (local runs and tests).
"""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

import tidemark.llm
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Executors need not have this repository on their path: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(tidemark.llm)

WS = "\x20\x09\x0a\x0b\x0c\x0d"
SEP = r"[\x20\x09-\x0D]+"
WORD = rb"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share. A private one is made only in local mode without a setting."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at.rstrip("/")


#: Work tables of this process.
_MADE: list[str] = []


def table_path(spark: SparkSession, name: str) -> str:
    _MADE.append(f"{shared_dir(spark)}/tidemark-work/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows for each file of a work table whose size is about known.
FILE_ROWS = 25_000


def staged(df: DataFrame, name: str = "stage", by: str | None = None, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost
    executors, and lets later readers prune columns. ``by`` names a column of few values to split it by.
    With about how many ``rows`` it has, it comes in no more files than these need, whatever the shuffle
    partitions; for tables whose last step is cheap, as its tasks are as few."""
    spark = df.sparkSession
    path = table_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.parquet(path, compression="zstd", partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unstage(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete work tables that nothing reads any more."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/tidemark-work/" in f}:
            _delete(spark, folder)


def discard_work(spark: SparkSession) -> None:
    """Delete all work tables that this process made and that are left. Call it when the results have been written."""
    while _MADE:
        _delete(spark, _MADE.pop())


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bounds what Spark hands to Python at once by bytes too: texts may be very long."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":  # Spark's own default
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of finished steps; it does so when the driver's heap is collected."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a non-null text; an empty array if there is none."""
    body = F.btrim(text, F.lit(WS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SEP))


def word_count(text: Column) -> Column:
    body = F.btrim(text, F.lit(WS))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, SEP))).cast("long")


def partitions(spark: SparkSession, rows: int, per_task: int) -> int:
    """Enough partitions for ``per_task`` rows each, at least the session's default."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, whatever task it runs."""
    return sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker")).__dict__


def tidy(run, keep: tuple = ()):
    """A mapInArrow function that leaves the worker small: other operators' tables go before it starts, and
    freed memory goes back to the system when it ends. Workers outlive tasks and share the executor's memory."""

    def tidied(batches):
        import ctypes
        import gc

        import pyarrow

        cache = worker_cache()
        for name in [n for n in cache if not n.startswith("__") and n not in keep]:
            del cache[name]
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pyarrow.default_memory_pool().release_unused()  # Arrow's own allocator keeps what its batches took
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return tidied


#: Up to this many ids (8 bytes each) are broadcast.
BROADCAST_IDS = 500_000


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id is not in ``gone`` (one column ``gone``, no nulls). Rows without an id stay."""
    gone = staged(gone, "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs[id_col] == gone["gone"], "left_anti")


def ambiguous_ids(docs: DataFrame, id_col: str) -> bool:
    """Whether an id is null or stands in several rows."""
    return not docs.groupBy(F.col(id_col).alias("id")).count().where("count > 1 or id is null").isEmpty()


def numbered_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """The table, written with a number for each row, and the name of that column."""
    name = fresh(docs, "row_number_")
    return staged(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name
