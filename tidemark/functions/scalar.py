"""Scalar functions as native column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F


def polynomial_hash(text: Column, seed: int, bits: int) -> Column:
    """Sum of characters by powers of ``seed``, the low ``bits`` bits. Keeping only those at each step gives
    the same as wrapping at 32 bits and masking once."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    mask = F.lit((1 << bits) - 1).cast("long")
    return F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(0).cast("long"), lambda h, c: (h * seed + c).bitwiseAND(mask))


def wrap32(x: Column) -> Column:
    """A long as a signed 32-bit number that wraps round."""
    low = x.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low)


def hash_code(text: Column, factor: int = 1) -> Column:
    """String hash with base 31, times a factor, both wrapping at 32 bits."""
    return wrap32(wrap32(polynomial_hash(text, 31, 32)) * factor).cast("int")


def md5_hex(text: Column) -> Column:
    """32 hexadecimal digits; null for null."""
    return F.md5(text.cast("binary"))


def row_key(uid: Column, dn: Column) -> Column:
    """Wide-row key: five digits of the id's MD5 spread keys over regions, then id and domain."""
    return F.concat(F.substring(md5_hex(uid.cast("string")), 1, 5), uid.cast("string"), dn)


def next_midnight(ts: Column) -> Column:
    return F.date_trunc("day", ts) + F.expr("interval 1 day")


def next_midnight_ms(ms: Column) -> Column:
    return (F.floor(ms / 86_400_000) + 1).cast("long") * 86_400_000


def money(text: Column) -> Column:
    """Decimal amount; blank or unreadable is zero."""
    return F.coalesce(F.trim(text).try_cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)"))


def event_time(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def event_time_ms(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def not_static(url: Column) -> Column:
    """URL that does not end in a static file's suffix."""
    return ~url.rlike(r"\.(css|js|png|ico)$")


def register(spark: SparkSession) -> None:
    """Names for SQL: hash_code(text, factor), a function of native expressions; split_words(text, separator), a table
    function; avg_temp, an aggregate; and top_two, a table aggregate over a table of (key as text, value):
    SELECT * FROM top_two(TABLE(SELECT CAST(id AS STRING), value FROM t) PARTITION BY id)."""
    from pyspark.sql.functions import pandas_udf, udtf

    low = "(x & 4294967295L)"
    wrapped = f"if({low} >= 2147483648L, {low} - 4294967296L, {low})"
    hashed = "aggregate(filter(transform(split(text, ''), c -> cast(ascii(c) as bigint)), c -> c > 0), 0L, (h, c) -> (h * 31L + c) & 4294967295L)"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION hash_code(text STRING, factor INT) RETURNS INT
        RETURN CAST(element_at(transform(transform(array({hashed}), x -> {wrapped} * factor), x -> {wrapped}), 1) AS INT)""")

    @udtf(returnType="id string, value double, rank bigint")
    class TopTwo:
        def __init__(self):
            self.id, self.best = None, []

        def eval(self, row):
            self.id = row[0]
            if row[1] is not None:
                self.best = sorted([*self.best, float(row[1])], reverse=True)[:2]

        def terminate(self):
            for rank, value in enumerate(self.best, 1):
                yield self.id, value, rank

    @udtf(returnType="word: string, length: int")
    class SplitWords:
        def eval(self, text: str, separator: str):
            for word in (text or "").split(separator):
                yield word, len(word)

    @pandas_udf("double")
    def avg_temp(temperature: pd.Series) -> float:
        return float(temperature.mean())

    spark.udf.register("avg_temp", avg_temp)
    spark.udtf.register("top_two", TopTwo)
    spark.udtf.register("split_words", SplitWords)
