"""Joins in time and to dimensions. Forms without a note work on batch and on streams with watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .windows import seconds, window_column

#: Dimensions up to this size are broadcast by Spark itself (spark.sql.autoBroadcastJoinThreshold); larger ones are shuffled.


def window_join(left: DataFrame, right: DataFrame, on: str, left_ts: str, right_ts: str, size: str, how: str = "inner") -> DataFrame:
    """Pairs with equal key in the same tumbling window. Event times are dropped: a stream has one only."""
    a = left.withColumn("window", window_column(left_ts, size)).drop(left_ts)
    b = right.withColumn("window", window_column(right_ts, size)).drop(right_ts)
    return a.join(b, [on, "window"], how)


def interval_condition(left_ts: Column, right_ts: Column, lower: str, upper: str) -> Column:
    """right in [left + lower, left + upper], both ends included."""
    span = lambda d: F.expr(f"interval {int(seconds(d) * 1000)} milliseconds")
    return (right_ts >= left_ts + span(lower)) & (right_ts <= left_ts + span(upper))


def interval_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, left_ts: str, right_ts: str, lower: str, upper: str, how: str = "inner") -> DataFrame:
    """Equal keys and right time within an interval around left time. Column names of the sides must differ."""
    within = interval_condition(F.col(left_ts), F.col(right_ts), lower, upper)
    return left.join(right, (F.col(left_on) == F.col(right_on)) & within, how)


def bucketed_interval_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, left_ts: str, right_ts: str, lower: str, upper: str) -> DataFrame:
    """The same for batches with hot keys: time is cut into buckets as wide as the interval, so that a key's rows
    are dealt out over its buckets, and no row meets more than two buckets of the other side."""
    width = max(seconds(upper) - seconds(lower), 1.0)
    at = lambda ts, shift: F.floor((F.col(ts).cast("timestamp").cast("double") + shift) / width)
    a = left.withColumn("__bucket", F.explode(F.sequence(at(left_ts, seconds(lower)), at(left_ts, seconds(upper)))))
    b = right.withColumn("__at", at(right_ts, 0.0))
    within = interval_condition(F.col(left_ts), F.col(right_ts), lower, upper)
    return a.join(b, (F.col(left_on) == F.col(right_on)) & (F.col("__bucket") == F.col("__at")) & within).drop("__bucket", "__at")


def as_of_join(left: DataFrame, versions: DataFrame, key: str, left_ts: str, version_ts: str, values: list[str]) -> DataFrame:
    """Every left row with the newest version of its key not after it (batch); null where there is none.

    One shuffle on the key: versions and rows are sorted together by time, and the last version seen is
    carried forward. A version at the row's own time counts.
    """
    version = F.struct(*[F.col(v) for v in values], F.col(version_ts).alias("__from"))
    a = left.select("*", F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"))
    b = versions.select(F.col(key), F.col(version_ts).alias("__ts"), F.lit(0).alias("__side"), version.alias("__version"))
    w = W.partitionBy(key).orderBy("__ts", "__side").rowsBetween(W.unboundedPreceding, 0)
    carried = a.unionByName(b, allowMissingColumns=True).withColumn("__version", F.last("__version", ignorenulls=True).over(w))
    out = carried.where("__side = 1")
    return out.select(*left.columns, *[F.col(f"__version.{v}").alias(v) for v in values], F.col("__version.__from").alias(version_ts))


def co_group_left(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, size: str, fill: list[str]) -> DataFrame:
    """Left join within tumbling windows; right text fields without a partner are empty."""
    a = left.withColumn("window", window_column(left_ts, size)).drop(left_ts)
    b = right.withColumn("window", window_column(right_ts, size)).drop(right_ts)
    out = a.join(b, [*on, "window"], "left")
    return out.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in fill else F.col(c) for c in out.columns])


def enrich(facts: DataFrame, dimension: DataFrame, facts_on: list[str], dimension_on: list[str], fill: list[str]) -> DataFrame:
    """Lookup join to a dimension: a miss gives empty text. Spark broadcasts the dimension if it is small."""
    renamed = dimension.select([F.col(c).alias(f"__{c}") if c in dimension_on else F.col(c) for c in dimension.columns])
    condition = [F.col(a).cast("string") == F.col(f"__{b}").cast("string") for a, b in zip(facts_on, dimension_on)]
    out = facts.join(renamed, condition, "left").drop(*[f"__{c}" for c in dimension_on])
    return out.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in fill else F.col(c) for c in out.columns])


def match_two_streams(left: DataFrame, right: DataFrame, left_on: str, right_on: str, left_ts: str, right_ts: str, left_waits: str, right_waits: str) -> DataFrame:
    """Full outer match: a left row waits for its right one, and the other way round; ``outcome`` is matched,
    left_only or right_only. Column names of the sides must differ."""
    joined = interval_join(left, right, left_on, right_on, left_ts, right_ts, f"-{right_waits}", left_waits, "full")
    outcome = F.when(F.col(left_on).isNull(), "right_only").when(F.col(right_on).isNull(), "left_only").otherwise("matched")
    return joined.withColumn("outcome", outcome)


def latest(changes: DataFrame, key: list[str], sequence: str, op: str = "op") -> DataFrame:
    """The state after a log of changes: the newest row of each key, unless it deletes."""
    newest = changes.groupBy(*key).agg(F.max_by(F.struct(*[c for c in changes.columns if c not in key]), sequence).alias("r"))
    return newest.select(*key, "r.*").where(F.col(op) != "D")


def latest_left_join(left_changes: DataFrame, right_changes: DataFrame, left_key: list[str], right_key: list[str], sequence: str, on: Column) -> DataFrame:
    """Left join of two tables known by their changes (batch, or inside foreachBatch)."""
    a = latest(left_changes, left_key, sequence).drop("op", sequence)
    b = latest(right_changes, right_key, sequence).drop("op", sequence)
    return a.join(b, on, "left")


def lateral_split(df: DataFrame, text: str, separator: str, outer: bool = False) -> DataFrame:
    """Each row once for every part of a text, with the part and its length; ``outer`` keeps rows without text."""
    parts = F.split(F.col(text), separator)
    explode = F.explode_outer if outer else F.explode
    return df.withColumn("word", explode(parts)).withColumn("length", F.length("word"))
