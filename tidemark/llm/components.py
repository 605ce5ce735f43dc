"""Joins on keys that may be hot, and connected components, all distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import staged, unstage

#: A key is hot with over 1/HOT_SHARE of all rows; so at most HOT_SHARE keys are, and these may be broadcast.
HOT_SHARE = 1000
#: A task takes this many rows of one key without harm, so with fewer rows than this no key is hot.
TASK_ROWS = 1_000_000


def join_hot(rows: DataFrame, keys: DataFrame, on: str, count_col: str, n_rows: int) -> DataFrame:
    """Inner join of ``rows`` with ``keys`` (one row a key, with its number of rows). Hot keys are
    joined by broadcast, of which there are at most ``HOT_SHARE``; the others by shuffle."""
    if n_rows <= TASK_ROWS:
        return rows.join(keys, on)
    limit = n_rows // HOT_SHARE
    hot, cold = keys.where(F.col(count_col) > limit), keys.where(F.col(count_col) <= limit)
    hot_names = hot.select(on)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot_names), on, "left_anti").join(cold, on))


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Each node's larger neighbours go to its least neighbour. Edges (a, b), a > b. Centres are hot keys."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree")).select("a", F.least("a", "m").alias("m"), "degree")
    up = join_hot(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), low, "a", "degree", 2 * n_edges).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return up.union(low.where("m < a").select("a", F.col("m").alias("b"))).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours go to the least of them; a large star leaves a node few of these."""
    small = edges.join(edges.groupBy("a").agg(F.min("b").alias("m")), "a")
    return small.select("a", F.col("m").alias("b")).union(small.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame, most_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """node, root: for every node of links (a, b) the smallest node it is connected to.

    Alternates large-star and small-star steps until nothing changes; every step is written to the
    shared folder, so plans stay small. Edges stay as many as the links at most, and every step is
    written in as few files as they need. ``rows``: about how many links there are, if known.
    """
    spark = links.sparkSession
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", rows=rows)
    seen, size = None, edges.count()
    for _ in range(most_rounds):
        large = staged(_large_star(edges, size), "large-stars", rows=size)
        after = staged(_small_star(large), "small-stars", rows=size)
        unstage(spark, edges, large)
        edges = after
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        seen, size = now, now[0]
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
