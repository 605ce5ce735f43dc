"""Time windows on batch and streaming DataFrames, and windows over rows (batch)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def seconds(duration: str) -> float:
    """Seconds of a duration such as "1 hour" or "-8 hours"."""
    number, unit = re.fullmatch(r"\s*(-?[\d.]+)\s+([a-z]+?)s?\s*", duration).groups()
    return float(number) * _UNITS[unit]


def window_column(ts: str | Column, size: str, slide: str | None = None, offset: str | None = None) -> Column:
    """Event-time window, closed on the left. Any offset is allowed: it counts modulo the slide."""
    slide = slide or size
    start = seconds(offset) % seconds(slide) if offset else 0
    return F.window(ts, size, slide, f"{int(start * 1000)} milliseconds") if start else F.window(ts, size, slide)


def event_time_watermark(df: DataFrame, ts: str, delay: str = "0 seconds") -> DataFrame:
    """Event time as TIMESTAMP with a watermark; rows without event time can't be placed and are left out."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).where(F.col(ts).isNotNull()).withWatermark(ts, delay)


def bounds(df: DataFrame) -> DataFrame:
    """The struct column ``window`` as window_start and window_end."""
    rest = [c for c in df.columns if c != "window"]
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *rest)


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], *aggregates: Column, offset: str | None = None) -> DataFrame:
    return bounds(df.groupBy(window_column(ts, size, offset=offset).alias("window"), *keys).agg(*aggregates))


def hopping(df: DataFrame, ts: str, size: str, slide: str, keys: list[str], *aggregates: Column, offset: str | None = None) -> DataFrame:
    return bounds(df.groupBy(window_column(ts, size, slide, offset).alias("window"), *keys).agg(*aggregates))


def hopping_count(df: DataFrame, ts: str, size: str, slide: str, keys: list[str], offset: str | None = None, name: str = "n") -> DataFrame:
    """Counts in sliding windows in two steps: each row is counted once in its slide, and only the slides'
    counts are spread over the size / slide windows they belong to. The size must be a multiple of the slide."""
    slides = df.groupBy(window_column(ts, slide, offset=offset).alias("slide"), *keys).agg(F.count(F.lit(1)).alias("part"))
    spread = slides.groupBy(window_column(F.window_time("slide"), size, slide, offset).alias("window"), *keys)
    return bounds(spread.agg(F.sum("part").cast("long").alias(name)))


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], *aggregates: Column) -> DataFrame:
    return bounds(df.groupBy(F.session_window(ts, gap).alias("window"), *keys).agg(*aggregates))


def over_range(df: DataFrame, keys: list[str], ts: str, span: str, *columns: tuple[str, Column]) -> DataFrame:
    """Each row with aggregates over the rows of its key in the ``span`` up to it (batch)."""
    w = W.partitionBy(*keys).orderBy("__micros").rangeBetween(-int(seconds(span) * 1_000_000), 0)
    out = df.withColumn("__micros", F.unix_micros(F.col(ts).cast("timestamp")))
    for name, column in columns:
        out = out.withColumn(name, column.over(w))
    return out.drop("__micros")


def row_windows(df: DataFrame, keys: list[str], order: list[str], size: int, slide: int, *aggregates: Column) -> DataFrame:
    """Windows of ``size`` rows every ``slide`` rows of a key, once they are complete to the slide: the first
    windows hold fewer rows. ``nth`` is the number of the window's last row."""
    placed = df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    first = F.ceil(F.col("__rn") / slide) * slide
    ends = F.sequence(first, first + (size - slide), F.lit(slide)) if size > slide else F.array(first)
    counted = placed.withColumn("__last", F.count(F.lit(1)).over(W.partitionBy(*keys)))  # in the order the rows have: no join, no further shuffle
    spread = counted.withColumn("nth", F.explode(ends)).where(F.col("nth") - F.col("__rn") < size)
    return spread.where("nth <= __last").groupBy(*keys, F.col("nth").cast("long").alias("nth")).agg(*aggregates)
