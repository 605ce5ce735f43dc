"""Quality rules by cross-document line frequency, with DataFrame operations only.

Lines are normalised (lower case, runs of white space as one space, trimmed) and hashed together with
their host. A line that stands in more than ``max_docs`` different documents of one host is removed
everywhere on that host; a document of which less than ``min_left`` of its words is left is depleted
and rejected. Counts are combined before the shuffle, and matches against frequent lines are salted,
so a line that a third of all documents hold is no hot key.

Defined cases: null text has no words and fails the base rule; a null host is a host of its own; of
rows that repeat an id each counts as a document in line counts and is judged by its own text; an empty table gives an empty result; only id, text and host are
read, so clashing names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SEP, WS, staged, text_or_empty, word_array, word_count

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: A set of frequent lines up to this size is broadcast (8 bytes each); a larger one is joined by shuffle.
BROADCAST_LINES = 500_000
SALTS = 32


def repeated_words(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words covered by windows of five words found twice or more in the text.

    Windows are compared by 64-bit hash within one text. Only texts with a repeated window are sorted.
    """
    n = F.col("n_words").cast("int")

    def beside(d: DataFrame, name: str, left: str, right: str, width: int) -> DataFrame:
        """Hashes of ``width`` words from hashes (or words) of its two ends."""
        count, from_ = n - width + 1, {2: 2, 4: 3, 5: 5}[width]
        pairs = F.zip_with(F.slice(left, F.lit(1), count), F.slice(right, F.lit(from_), count), lambda x, y: F.xxhash64(x, y))
        return d.withColumn(name, F.when(count > 0, pairs).otherwise(F.array().cast("array<bigint>")))

    d = beside(docs, "two", "words", "words", 2)
    d = beside(d, "four", "two", "two", 4)
    d = beside(d, "windows", "four", "words", WINDOW)
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("placed", F.when(repeats, placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    again = F.filter(
        F.transform("placed", lambda s, k: F.when((s["h"] == F.get("placed", k - 1)["h"]) | (s["h"] == F.get("placed", k + 1)["h"]), s["i"])),
        lambda i: i.isNotNull(),
    )
    d = d.withColumn("starts", F.sort_array(again))
    covered = F.transform("starts", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - i, F.lit(WINDOW))))
    return d.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).drop("two", "four", "windows", "placed", "starts")


def without(text: Column, characters: str) -> Column:
    """The text without some characters; each absent one costs a search only."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words to rows with a ``body``."""
    lines = F.filter(F.split("body", "\n"), lambda x: F.btrim(x, F.lit(WS)) != "")
    d = docs.withColumn("words", word_array(F.col("body")))
    d = d.withColumn("n_words", F.size("words").cast("long")).withColumn("lines", lines)
    d = d.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    d = d.withColumn("word_chars", F.length(without(F.col("body"), WS)).cast("long"))
    d = d.withColumn("n_symbols", (F.length("body") - F.length(without(F.col("body"), SYMBOLS))).cast("long"))
    return repeated_words(d).drop("lines", "words")


def _host() -> Column:
    return F.struct(F.col("host").isNull(), F.coalesce(F.col("host").cast("string"), F.lit("")))


#: Tells rows that repeat an id apart.
ROW_SQL = "xxhash64(host, body)"


def line_rows(docs: DataFrame) -> DataFrame:
    """One row for each line of a document: id, row (hash of host and text), at, line (hash with host), n (its words)."""
    line = F.posexplode(F.split("body", "\n")).alias("at", "line")
    rows = docs.select("id", F.expr(ROW_SQL).alias("row"), _host().alias("h"), line).withColumn("line", F.regexp_replace(F.btrim(F.lower("line"), F.lit(WS)), SEP, " ")).where("line <> ''")
    return rows.select("id", "row", "at", F.xxhash64("h", "line").alias("line"), word_count(F.col("line")).alias("n"))


def frequent_lines(docs: DataFrame, max_docs: int) -> DataFrame:
    """line: hashes (with host) of lines in more than ``max_docs`` documents of a host."""
    each = F.transform(F.split(F.lower("body"), "\n"), lambda x: F.regexp_replace(F.btrim(x, F.lit(WS)), SEP, " "))
    hashed = F.transform(F.array_distinct(F.filter(each, lambda x: x != "")), lambda x: F.xxhash64("h", x))
    counts = docs.select(_host().alias("h"), "body").select(F.explode(hashed).alias("line")).groupBy("line").count()
    return staged(counts.where(F.col("count") > max_docs).select("line"), "frequent-lines")


def line_verdicts(docs: DataFrame, max_docs: int) -> DataFrame:
    """id, row, removed: the words of each document that stand in lines frequent on its host."""
    frequent = frequent_lines(docs, max_docs)
    rows = line_rows(docs)
    if frequent.count() <= BROADCAST_LINES:
        hits = rows.join(F.broadcast(frequent), "line")
    else:
        salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["line", "salt"])
    hits = hits.groupBy("id", "row", "at").agg(F.first("n").alias("n"))  # rows that repeat id and text have the same lines
    return hits.groupBy("id", "row").agg(F.sum("n").alias("removed"))


def apply_rules(
    docs: DataFrame,
    max_docs: int = 100,
    min_left: float = 0.3,
    min_words: int = 10,
    max_repeat_percent: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, base_failed, kept, row (hash of host and text)."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body"), F.col(host_col).alias("host"))
    removed = line_verdicts(rows, max_docs).withColumnsRenamed({"id": "rid", "row": "rrow"})
    base = base_counts(rows).withColumn("row", F.expr(ROW_SQL)).drop("body", "host")
    out = base.join(removed, F.col("id").eqNullSafe(F.col("rid")) & (F.col("row") == F.col("rrow")), "left")
    lost = F.coalesce(F.col("removed"), F.lit(0))
    failed: Column = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - lost
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        lost.alias("removed_words"), failed.alias("base_failed"), (~failed & (left >= min_left * F.col("n_words"))).alias("kept"), "row",
    )


def cleaned(docs: DataFrame, max_docs: int = 100, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """doc_id, text of kept documents without their frequent lines, empty lines included; of rows that repeat id, text and host one."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body"), F.col(host_col).alias("host"))
    verdict = apply_rules(docs, max_docs, id_col=id_col, text_col=text_col, host_col=host_col, **limits)
    removed = frequent_lines(rows, max_docs)
    norm = F.regexp_replace(F.btrim(F.lower("line"), F.lit(WS)), SEP, " ")
    lines = rows.select("id", F.expr(ROW_SQL).alias("row"), _host().alias("h"), F.posexplode(F.split("body", "\n")).alias("at", "text_line"))
    lines = lines.withColumn("line", F.col("text_line")).withColumn("line", F.xxhash64("h", norm))
    if removed.count() <= BROADCAST_LINES:
        left = lines.join(F.broadcast(removed), "line", "left_anti")
    else:
        salted = removed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = lines.withColumn("salt", F.pmod(F.xxhash64("id", "row", "at"), F.lit(SALTS)).cast("int")).join(salted, ["line", "salt"], "left_anti")
    left = left.groupBy("id", "row").agg(F.sort_array(F.collect_set(F.struct("at", "text_line"))).alias("l"))
    kept = verdict.where("kept").select(F.col("doc_id").alias("kid"), F.col("row").alias("krow")).distinct()
    found = left.join(kept, F.col("id").eqNullSafe(F.col("kid")) & (F.col("row") == F.col("krow")))
    return found.select(F.col("id").alias("doc_id"), F.array_join(F.transform("l", lambda x: x["text_line"]), "\n").alias("text"))
