"""Rules over the ordered events of a key (batch: the ideal event-time answer).

The streaming forms with timers are in ``tidemark.streaming.stateful``; on input in order, with a
watermark that covers the disorder, they give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _by(keys: list[str], order: list[str]):
    return W.partitionBy(*keys).orderBy(*order)


def jumps(df: DataFrame, keys: list[str], order: list[str], value: str, threshold: float = 10.0) -> DataFrame:
    """Rows that differ by more than ``threshold`` from the key's row before. A first row never does."""
    out = df.withColumn("last", F.lag(value).over(_by(keys, order)))
    return out.where(F.abs(F.col(value) - F.col("last")) > threshold)


def rises(df: DataFrame, keys: list[str], order: list[str], ts: str, value: str, lasting: float, zero_init: bool = False) -> DataFrame:
    """Runs without a fall that begin with a rise and last ``lasting`` seconds before a fall ends them.

    An equal value neither starts nor ends a run. One row a run: key, start (the first rise) and alert_at.
    ``zero_init`` counts a first value over zero as a rise.
    """
    w = _by(keys, order)
    before = F.lag(value).over(w)
    before = F.coalesce(before, F.lit(0.0)) if zero_init else before
    d = df.withColumn("__at", F.col(ts).cast("timestamp").cast("double")).withColumn("__before", before)
    d = d.withColumn("__fall", F.coalesce(F.col(value) < F.col("__before"), F.lit(False)).cast("int")).withColumn("__rise", F.coalesce(F.col(value) > F.col("__before"), F.lit(False)))
    d = d.withColumn("__run", F.sum("__fall").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = d.groupBy(*keys, "__run").agg(F.min(F.when(F.col("__rise"), F.col("__at"))).alias("start"), F.min("__at").alias("from_"))
    ends = F.lead("from_").over(W.partitionBy(*keys).orderBy("__run"))
    runs = runs.withColumn("end", ends).where("start is not null").where(F.col("end").isNull() | (F.col("end") > F.col("start") + lasting))
    return runs.select(*keys, F.timestamp_micros((F.col("start") * 1e6).cast("long")).alias("start"), F.timestamp_micros(((F.col("start") + lasting) * 1e6).cast("long")).alias("alert_at"))


def route(df: DataFrame, column: str, **conditions: Column) -> DataFrame:
    """Side outputs as a column: the name of the first condition that holds, else "main"."""
    out = None
    for name, condition in conditions.items():
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return df.withColumn(column, out.otherwise("main") if out is not None else F.lit("main"))


def consecutive_failures(df: DataFrame, keys: list[str], order: list[str], ts: str, failed: Column, within: float = 5.0) -> DataFrame:
    """Two failures in a row of a key, less than ``within`` seconds apart: key, first and last time.

    Rows in order of ``order``: by event time it is the strict pattern (fail, next fail); by arrival it is
    the immediate rule, in which a success between forgets the failure before.
    """
    w = _by(keys, order)
    d = df.withColumn("__failed", failed).withColumn("__last_failed", F.lag("__failed").over(w)).withColumn("first_at", F.lag(ts).over(w))
    gap = F.abs(F.col(ts).cast("timestamp").cast("double") - F.col("first_at").cast("timestamp").cast("double"))
    return d.where(F.col("__failed") & F.col("__last_failed") & (gap < within)).select(*keys, "first_at", F.col(ts).alias("last_at"))


def failures_by_timer(df: DataFrame, keys: list[str], order: list[str], ts: str, failed: Column, wait: float = 5.0, least: int = 2) -> DataFrame:
    """Failures gathered since the last success or firing; ``wait`` seconds after the first of them, at least
    ``least`` gathered ones give a warning: key, first, last and number.

    Failures up to and including the firing time belong to the firing. A success before it clears all.
    Timers set by failures that were cleared fire on whatever is gathered then.

    No timer is ever taken back, so all firing times are known: each failure's time and ``wait``. Successes and
    firings cut a key's history; a cut's failures are a warning if a firing ended it. One shuffle on the key, one
    sorted pass that keeps a count only. ``order`` must agree with event time.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    places = [F.col(c).alias(f"__o{i}") for i, c in enumerate(order)]
    d = df.select(*keys, *places, at.alias("__at"), F.coalesce(failed, F.lit(False)).alias("__failed"))
    timer = F.array(F.lit(0), F.lit(1))
    steps = d.withColumn("__timer", F.explode(F.when(F.col("__failed"), timer).otherwise(F.array(F.lit(0)))))
    steps = steps.withColumn("__at", F.col("__at") + F.col("__timer") * int(wait * 1_000_000))
    before = _by(keys, ["__at", "__timer", *[f"__o{i}" for i in range(len(order))]]).rowsBetween(W.unboundedPreceding, -1)
    cut = F.when((F.col("__timer") == 1) | ~F.col("__failed"), 1).otherwise(0)
    steps = steps.withColumn("__part", F.coalesce(F.sum(cut).over(before), F.lit(0)))
    failure = F.when((F.col("__timer") == 0) & F.col("__failed"), F.col("__at"))
    found = steps.groupBy(*keys, "__part").agg(F.min(failure).alias("first_at"), F.max(failure).alias("last_at"), F.count(failure).alias("times"), F.max("__timer").alias("__fired"))
    stamp = lambda c: F.timestamp_micros(F.col(c)).alias(c)
    return found.where((F.col("__fired") == 1) & (F.col("times") >= least)).select(*keys, stamp("first_at"), stamp("last_at"), "times")


def followed_by(df: DataFrame, keys: list[str], ts: str, first: Column, then: Column, within: float) -> DataFrame:
    """Relaxed pattern: each ``first`` event with the earliest ``then`` event of its key less than ``within``
    seconds after it, whatever lies between; without one it is timed out. Columns: key, first_at, then_at, outcome."""
    at = F.col(ts).cast("timestamp").cast("double")
    later = W.partitionBy(*keys).orderBy(F.col("__at"), F.col("__then").cast("int")).rowsBetween(1, W.unboundedFollowing)
    d = df.select(*keys, at.alias("__at"), F.coalesce(first, F.lit(False)).alias("__first"), F.coalesce(then, F.lit(False)).alias("__then")).where("__first or __then")
    d = d.withColumn("__next", F.min(F.when(F.col("__then"), F.col("__at"))).over(later)).where("__first")
    hit = F.col("__next") < F.col("__at") + within
    stamp = lambda c: F.timestamp_micros((c * 1e6).cast("long"))
    return d.select(*keys, stamp(F.col("__at")).alias("first_at"), F.when(hit, stamp(F.col("__next"))).alias("then_at"), F.when(hit, "payed successfully").otherwise("order timeout").alias("outcome"))


def order_outcomes(df: DataFrame, key: str, ts: str, created: Column, payed: Column, deadline: float = 900.0) -> DataFrame:
    """What became of each order, by its first creation and first payment: payed successfully (less than
    ``deadline`` seconds apart), payed but already timeout, order timeout, or already payed but not found created log."""
    at = F.col(ts).cast("timestamp").cast("double")
    o = df.groupBy(key).agg(F.min(F.when(created, at)).alias("created_at"), F.min(F.when(payed, at)).alias("payed_at")).where("created_at is not null or payed_at is not null")
    outcome = (
        F.when(F.col("created_at").isNull(), "already payed but not found created log")
        .when(F.col("payed_at").isNull(), "order timeout")
        .when(F.col("payed_at") < F.col("created_at") + deadline, "payed successfully")
        .otherwise("payed but already timeout")
    )
    return o.select(key, outcome.alias("outcome"))


def blacklist(df: DataFrame, keys: list[str], ts: str, order: list[str], most: int = 100) -> DataFrame:
    """Rows with ``verdict``: pass for the first ``most`` of a key and UTC day, warn for the next, drop for the rest."""
    day = F.date_trunc("day", F.col(ts).cast("timestamp"))
    nth = F.row_number().over(W.partitionBy(*keys, "__day").orderBy(*order))
    out = df.withColumn("__day", day).withColumn("__nth", nth)
    verdict = F.when(F.col("__nth") <= most, "pass").when(F.col("__nth") == most + 1, "warn").otherwise("drop")
    return out.withColumn("verdict", verdict).drop("__day", "__nth")
