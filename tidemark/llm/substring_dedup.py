"""Substring deduplication by line or paragraph hashing.

Units are lines and the sentences in them (or whole lines, or paragraphs between blank lines). They are
normalised (lower case, white space as single spaces) and hashed with 128 bits. Of all units of the
table with one digest the earliest by (id, offset) is the original, the others are repeats. Neighbouring
repeats of a text form a run; runs of at least ``min_words`` words are removed and their original
character offsets reported. So a passage is found wherever it stands in a line, while single short
sentences that repeat by chance stay. Units of fewer than ``least_words`` words belong to a run but don't
count for its length.

Each unit travels once, as five numbers, to the place of its digest. Repeats within the texts that are
parsed together are told there and go on under a key of their own, so one digest has a row for each
such batch at most, however many documents hold it. Rows of a digest are read in order, none is gathered.

Defined cases: null text is an empty text without units; rows that repeat id and text share their spans,
rows that repeat an id with other texts have spans of their own, and units at the same offset of one id
are not later than each other; null ids come last; an empty table gives an empty result; only id and text
are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import text_or_empty, tidy

BREAKS = {
    "sentence": re.compile(r"[.!?][.!?\"')\]]*[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*"),
    "line": re.compile(r"\n[\x20\x09-\x0D]*"),
    "paragraph": re.compile(r"\n[ \t\r\x0b\x0c]*\n[\x20\x09-\x0D]*"),
}
#: Units are combined and handed on when so many are parsed.
AT_ONCE = 200_000
LAST = (1 << 63) - 1
UNIT = "high long, low long, known boolean, doc_id long, body long, place long, size long"


def unit_rows(rows: DataFrame, unit: str) -> DataFrame:
    """Units of (doc_id, body, text): two halves of the digest, doc_id, body, place (number << 32 | start) and size
    (characters << 32 | words). ``known`` ones repeat a unit parsed before them; their high and low tell nothing."""
    breaks = BREAKS[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, docs, bodies, counts, places, sizes = [], [], [], [], [], []
        for batch in batches:
            for doc_id, body, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text, at, number, before = text.as_py(), 0, 0, len(digests)
                for end in [*(m.end() for m in breaks.finditer(text)), len(text)]:
                    words = text[at:end].lower().encode().split()
                    if words:
                        digests.append(hashlib.md5(b" ".join(words)).digest())
                        places.append(number << 32 | at)
                        sizes.append(end - at << 32 | len(words))
                        number += 1
                    at = end
                docs.append(LAST if doc_id is None else doc_id)
                bodies.append(body)
                counts.append(len(digests) - before)
                if len(digests) >= AT_ONCE:
                    yield packed(digests, docs, bodies, counts, places, sizes)
                    digests, docs, bodies, counts, places, sizes = [], [], [], [], [], []
        if digests:
            yield packed(digests, docs, bodies, counts, places, sizes)

    def packed(digests: list, docs: list, bodies: list, counts: list, places: list, sizes: list) -> pa.RecordBatch:
        high, low = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2).T.copy()
        doc, body = (np.repeat(np.array(x, np.int64), counts) for x in (docs, bodies))
        place, size = np.array(places, np.int64), np.array(sizes, np.int64)
        start = place & 0xFFFFFFFF
        order = np.lexsort((body, start, doc, low, high))
        differs = lambda *columns: np.concatenate(([True], np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)))
        new = differs(high, low)
        head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        later = (doc[order] != doc[head]) | (start[order] != start[head])
        keep = new | differs(doc, start, body)  # of repeated rows one tells all
        order, later = order[keep], later[keep]
        high, low, doc, body, place, size = (c[order] for c in (high, low, doc, body, place, size))
        high, low = np.where(later, body ^ (doc * 0x5851F42D4C957F2D), high), np.where(later, place, low)
        known = later
        return pa.RecordBatch.from_arrays([pa.array(high), pa.array(low), pa.array(known), pa.array(doc), pa.array(body), pa.array(place), pa.array(size)], [f.split()[0] for f in UNIT.split(", ")])

    return rows.mapInArrow(tidy(run), UNIT)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, body (a hash of the text, which tells rows that repeat an id apart), text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("body"), "text")


def repeated_spans(docs: DataFrame, unit: str = "sentence", min_words: int = 25, least_words: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """sid, sbody, cuts: the removed runs of each row that has any, as sorted structs (start, stop, n units). A null id is the largest long."""
    units = unit_rows(keyed(docs, id_col, text_col), unit)
    start = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))
    in_order = W.partitionBy("known", "high", "low").orderBy("doc_id", "start").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = units.withColumn("start", start).withColumn("first_doc", F.first("doc_id").over(in_order)).withColumn("first_start", F.first("start").over(in_order))
    later = placed.where(F.col("known") | (F.col("doc_id") != F.col("first_doc")) | (F.col("start") != F.col("first_start")))
    number, length, words = F.shiftright("place", 32), F.shiftright("size", 32), F.col("size").bitwiseAND(F.lit(0xFFFFFFFF))
    later = later.select("doc_id", "body", number.alias("number"), "start", (F.col("start") + length).alias("stop"), words.alias("words"))
    later = later.repartition("doc_id", "body").dropDuplicates(["doc_id", "body", "number"])
    island = F.col("number") - F.row_number().over(W.partitionBy("doc_id", "body").orderBy("number"))
    runs = later.withColumn("island", island).groupBy("doc_id", "body", "island").agg(
        F.min("start").cast("int").alias("start"), F.max("stop").cast("int").alias("stop"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("words") >= least_words, F.col("words")).otherwise(0)).alias("words")
    )
    cuts = F.sort_array(F.collect_list(F.struct("start", "stop", "n"))).alias("cuts")
    return runs.where(F.col("words") >= min_words).groupBy(F.col("doc_id").alias("sid"), F.col("body").alias("sbody")).agg(cuts)


def without_repeats(docs: DataFrame, unit: str = "sentence", min_words: int = 25, least_words: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (what is left), n_removed (units), removed_chars, spans ("start-stop" of removed runs, in order, comma-separated)."""
    spans = repeated_spans(docs, unit, min_words, least_words, id_col, text_col)
    rows = keyed(docs, id_col, text_col).withColumn("key", F.coalesce("doc_id", F.lit(LAST)))
    out = rows.join(spans, (F.col("key") == F.col("sid")) & (F.col("body") == F.col("sbody")), "left")
    kept = F.expr(
        """concat(array_join(transform(cuts, (c, i) -> substr(text, if(i = 0, 1, get(cuts, i - 1).stop + 1),
             c.start - if(i = 0, 0, get(cuts, i - 1).stop))), ''), substr(text, element_at(cuts, -1).stop + 1))"""
    )
    return out.select(
        "doc_id", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.coalesce(F.expr("aggregate(cuts, 0L, (a, c) -> a + c.n)"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.expr("aggregate(cuts, 0L, (a, c) -> a + c.stop - c.start)"), F.lit(0)).cast("long").alias("removed_chars"),
        F.coalesce(F.expr("array_join(transform(cuts, c -> concat(c.start, '-', c.stop)), ',')"), F.lit("")).alias("spans"),
    )
