"""Top N of each group. The batch form ranks; the streaming form chains a second aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def top_n(df: DataFrame, groups: list[str], order: list[Column], n: int) -> DataFrame:
    """Rows with their rank in the group, the first ``n``. Spark drops lower ranks before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*groups).orderBy(*order)).cast("long")).where(F.col("rank") <= n)


def top_n_stream(counts: DataFrame, window: str, item: str, count: str, n: int) -> DataFrame:
    """Top ``n`` items of each window on a stream of window counts: by count, then by smaller item (numeric)."""
    best = F.slice(F.sort_array(F.collect_list(F.struct(F.col(count), (-F.col(item)).alias("minus"))), asc=False), 1, n)
    ranked = counts.groupBy(window).agg(best.alias("best")).select(window, F.posexplode("best").alias("at", "b"))
    return ranked.select(window, (-F.col("b.minus")).alias(item), F.col(f"b.{count}").alias(count), (F.col("at") + 1).cast("long").alias("rank"))


def report(ranked: DataFrame, window_end: str, item: str, count: str) -> DataFrame:
    """One text for each window: its time, a line for each rank, and a rule."""
    line = F.struct("rank", F.format_string("No%d: id=%s count=%d", F.col("rank"), F.col(item).cast("string"), F.col(count)).alias("line"))
    lines = F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"])
    head = F.concat(F.lit("time: "), F.date_format(window_end, "yyyy-MM-dd HH:mm:ss"))
    return ranked.groupBy(window_end).agg(lines.alias("lines")).select(window_end, F.concat(head, F.lit("\n"), F.array_join("lines", "\n"), F.lit("\n" + "=" * 30)).alias("report"))
