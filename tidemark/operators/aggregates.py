"""Aggregations: rolling, by window, distinct and approximate, and several rows a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalar import polynomial_hash
from .windows import bounds, window_column


def _running(keys: list[str], order: list[str]):
    return W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)


def rolling(df: DataFrame, keys: list[str], order: list[str], **columns: Column) -> DataFrame:
    """One output a row: aggregates over the key's rows so far (batch form of a rolling aggregate)."""
    w = _running(keys, order)
    return df.select("*", *[c.over(w).alias(name) for name, c in columns.items()])


def rolling_extreme(df: DataFrame, keys: list[str], order: list[str], field: str, smallest: bool = True) -> DataFrame:
    """Rolling minimum or maximum of one field; the other fields stay those of the key's first row."""
    w = _running(keys, order)
    pick = F.min(field) if smallest else F.max(field)
    others = [c for c in df.columns if c not in (*keys, field)]
    return df.select(*keys, pick.over(w).alias(field), *[F.first(c).over(w).alias(c) for c in others])


def rolling_reduce(df: DataFrame, keys: list[str], order: list[str], **steps: str) -> DataFrame:
    """Rolling reduce that only looks at the newest row: ``steps`` are expressions over it; the first row stays as it is."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    out = df.withColumn("__nth", nth)
    for name, step in steps.items():
        out = out.withColumn(name, F.when(F.col("__nth") == 1, F.col(name)).otherwise(F.expr(step)))
    return out.drop("__nth")


def window_min_row(df: DataFrame, ts: str, size: str, keys: list[str], field: str, ties: list[str], slide: str | None = None) -> DataFrame:
    """The whole row with the smallest ``field`` of each window; ``ties`` decide between equal ones."""
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    best = F.min_by(row, F.struct(field, *ties)).alias("row")
    grouped = df.groupBy(window_column(ts, size, slide).alias("window"), *keys).agg(best)
    return bounds(grouped).select("window_start", "window_end", *keys, "row.*")


def window_reduce(df: DataFrame, ts: str, size: str, keys: list[str], smallest: str, newest: str, order: list[str]) -> DataFrame:
    """Window reduce to the smallest of one field and another field of the row that came last."""
    out = df.groupBy(window_column(ts, size).alias("window"), *keys).agg(F.min(smallest).alias(smallest), F.max_by(newest, F.struct(*order)).alias(newest))
    return bounds(out)


def distinct_per_window(df: DataFrame, ts: str, size: str, what: str, name: str = "uv") -> DataFrame:
    """Exact number of different values in each window; the form also works on streams."""
    once = df.select(window_column(ts, size).alias("window"), what).dropDuplicates(["window", what])
    return bounds(once.groupBy("window").agg(F.count(what).alias(name)))


def approximate_distinct_per_window(df: DataFrame, ts: str, size: str, what: str, name: str = "uv", rsd: float = 0.02) -> DataFrame:
    return bounds(df.groupBy(window_column(ts, size).alias("window")).agg(F.approx_count_distinct(what, rsd).alias(name)))


def bitmap_distinct_per_window(df: DataFrame, ts: str, size: str, what: str, seed: int = 61, bits: int = 28, name: str = "uv") -> DataFrame:
    """Distinct count of one-hash bitmap positions: undercounts by its collisions, as such a bitmap does."""
    position = polynomial_hash(F.col(what).cast("string"), seed, bits)
    return distinct_per_window(df.select(ts, position.alias("position")), ts, size, "position", name)


def bitmap_distinct_sightings(df: DataFrame, ts: str, size: str, what: str, row: str, seed: int = 61, bits: int = 28, name: str = "uv") -> DataFrame:
    """One row for every first sighting of a bitmap position in a window: ``row`` (the sighting's id) and the count so far."""
    position = polynomial_hash(F.col(what).cast("string"), seed, bits)
    seen = df.groupBy(window_column(ts, size).alias("window"), position.alias("position")).agg(F.min(F.struct(ts, row)).alias("first"))
    so_far = F.row_number().over(W.partitionBy("window").orderBy("first")).cast("long")
    return seen.select(F.col("window.start").alias("window_start"), F.col(f"first.{row}").alias(row), so_far.alias(name))


def top_rows(df: DataFrame, keys: list[str], value: str, n: int = 2) -> DataFrame:
    """Several rows a group: the ``n`` largest values with their rank; fewer where a group has fewer."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(value).desc()))  # Spark limits each group before it shuffles
    return df.select(*keys, value, nth.cast("long").alias("rank")).where(F.col("rank") <= n)


def pairwise_average(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Every two rows of a key give their integer average; a last odd row waits and gives nothing."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    pairs = df.withColumn("pair", F.floor((nth - 1) / 2).cast("long")).groupBy(*keys, "pair")
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).where("n = 2").select(*keys, "pair", F.expr("total div 2").alias("average"))
