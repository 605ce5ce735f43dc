"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key. Within its source the key space is cut into ranges of about
``rows_per_range`` documents, and the ranges into spans. Totals are prefix-summed over the spans of a
source, over the ranges of a span, and over the sorted documents of a range, so no task ever holds a
source, however hot. A source is taken in whole
epochs first, then in key order up to its exact budget.

Defined cases: null text has size 0; a null source is a source of its own and sorts last; rows with
equal ids and equal keys are ordered by size; an empty table gives an empty result; columns of the
input that clash with result names are ignored, only id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import ambiguous_ids, numbered_rows, staged, text_or_empty, word_count

#: Ranges of a source are gathered into so many spans, so that prefix sums over ranges are spread too.
SPANS = 1024
#: Hexadecimal digits of MD5 used as random key: 60 bits, the same in other SQL engines.
KEY_DIGITS = 15


def random_key(id_col: str, seed: int) -> Column:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, KEY_DIGITS), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple, share: float, max_epochs: float) -> DataFrame:
    """One row a source: target = min(max_epochs * size, level * weight), where the level makes the
    targets add up to ``share`` of all sizes. That is the fixed point of capping and resharing the
    excess by weight. With sources by cap / weight, each level supposes that those before are capped; of
    the levels that cap none after, the highest is the one. The windows here run over sources, not documents."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, len(weights)) + 1).cast("int"))
    by_ratio = W.orderBy("ratio", F.col("source").isNull(), F.col("source"))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = (
        totals.withColumn("weight", weight)
        .withColumn("cap", max_epochs * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("free", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("budget", share * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("free"))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    )
    return t.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 42,
    boundary: str = "split",
    rows_per_range: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, epochs: what the mix takes of each document.

    ``boundary``: "split" takes only part of the one document at the cut, so a source's taken words
    are its target rounded down; "whole" takes that document if over half of it fits.
    """
    sized = staged(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_or_empty(text_col)).alias("size")), "mix")
    ranges = max(1, -(-sized.count() // rows_per_range))
    keyed = sized.withColumn("key", random_key("doc_id", seed)).withColumn("range", F.floor(F.col("key") / F.lit(float(16**KEY_DIGITS)) * ranges).cast("int"))

    targets = source_targets(sized, weights, share, max_epochs)
    wide = -(-ranges // SPANS)
    sums = keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size")).withColumn("span", F.floor(F.col("range") / wide).cast("int"))
    start = lambda size, order, *within: F.coalesce(F.sum(size).over(W.partitionBy(*within).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = sums.groupBy("source", "span").agg(F.sum("range_size").alias("span_size"))
    spans = spans.select(F.col("source").alias("s"), F.col("span").alias("p"), start("span_size", "span", "source").alias("span_start"))
    ends = sums.withColumn("in_span", start("range_size", "range", "source", "span"))
    ends = ends.join(spans, F.col("source").eqNullSafe(F.col("s")) & (F.col("span") == F.col("p")))
    ends = ends.select(F.col("source").alias("s"), F.col("range").alias("r"), (F.col("span_start") + F.col("in_span")).alias("range_start"))
    ends = ends.join(targets.withColumnRenamed("source", "t"), F.col("s").eqNullSafe(F.col("t"))).drop("t")

    inside = W.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor((F.col("target") + 1e-6) / F.col("source_size"))).otherwise(0)
    rest = F.greatest(F.lit(0), F.floor(F.col("target") + 1e-6) - F.col("epochs") * F.col("source_size") - F.col("start"))
    last = F.least(F.col("size"), F.col("rest"))
    if boundary == "whole":
        last = F.when(2 * last > F.col("size"), F.col("size")).otherwise(0)
    return (
        keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
        .withColumn("start", F.col("range_start") + F.col("inside"))
        .withColumn("epochs", epochs)
        .withColumn("rest", rest)
        .select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"))
    )


def mixed_documents(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each repeated once for every epoch it is taken in, whole. If ids repeat or are
    null, rows are numbered as they are stored, and the numbers stand for the ids."""
    columns, number = docs.columns, id_col
    if ambiguous_ids(docs, id_col):
        docs, number = numbered_rows(docs)
    plan = mix(docs, seed=seed, boundary="whole", id_col=number, **options).where("taken > 0")
    plan = plan.select(F.col("doc_id").alias("plan_id"), F.expr("taken div size").cast("int").alias("times"))
    taken = docs.join(plan, docs[number] == plan["plan_id"])
    return taken.select(F.explode(F.sequence(F.lit(1), plan["times"])), *[docs[f"`{c}`"] for c in columns]).select(*[docs[f"`{c}`"] for c in columns])
