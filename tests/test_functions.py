"""Scalar functions and parsers."""

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import scalar


def java_hash(s, factor):
    h = 0
    for c in s:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    h = (h - (1 << 32) if h >> 31 else h) * factor & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


@pytest.mark.parametrize("text", ["", "a", "sensor_1", "a much longer text that wraps round"])
def test_hashes(spark, text):
    df = spark.createDataFrame([(text,)], "s string")
    got = df.select(scalar.hash_code(F.col("s"), 10).alias("h"), scalar.polynomial_hash(F.col("s"), 61, 28).alias("p")).first()
    assert got.h == java_hash(text, 10)
    h = 0
    for c in text:
        h = h * 61 + ord(c)
    assert got.p == h & ((1 << 28) - 1)


def test_sql_functions(spark, rows):
    scalar.register(spark)
    spark.createDataFrame([("a b", 1.0), ("c", 3.0)], "s string, t double").createOrReplaceTempView("t_words")
    assert rows(spark.sql("SELECT word, length FROM t_words, LATERAL split_words(s, ' ')")) == [("a", 1), ("b", 1), ("c", 1)]
    assert spark.sql("SELECT avg_temp(t) AS a FROM t_words").first().a == 2.0
    assert rows(spark.sql("SELECT hash_code(s, 10) AS h FROM t_words")) == sorted([(java_hash("a b", 10),), (java_hash("c", 10),)], key=repr)


def test_money_and_keys(spark):
    df = spark.createDataFrame([("12.5", 7, "webA"), ("", 8, "webB"), (None, 9, "webC"), ("x", 1, "d")], "m string, uid int, dn string")
    assert [float(r.m) for r in df.select(scalar.money(F.col("m")).alias("m")).collect()] == [12.5, 0, 0, 0]
    assert df.select(scalar.row_key(F.col("uid"), F.col("dn")).alias("k")).first().k == "8f14e7webA"


def test_static_suffix(spark):
    df = spark.createDataFrame([("/a.css",), ("/a.css/b",), ("/png",), ("/x.png",)], "u string")
    assert [r.u for r in df.where(scalar.not_static(F.col("u"))).collect()] == ["/a.css/b", "/png"]


def test_parse_delimited(spark, rows):
    lines = spark.createDataFrame([("sensor_1, 1547718199, 35.8",), ("sensor_2,1547718201,34",), ("bad,line",), ("s,x,1",), (None,)], "value string")
    p = schemas.parse_delimited(lines, schemas.SENSOR)
    assert rows(schemas.accepted(p)) == [("sensor_1", 1547718199, 35.8), ("sensor_2", 1547718201, 34.0)]
    assert schemas.rejected(p).count() == 3


def test_empty_text_is_no_null(spark, rows):
    p = schemas.parse_delimited(spark.createDataFrame([("1,create,,5",)], "value string"), schemas.ORDER_EVENT)
    assert rows(schemas.accepted(p)) == [(1, "create", "", 5)]


def test_access_log(spark):
    lines = spark.createDataFrame([("83.149.9.216 7 - 17/05/2015:10:05:03 +0000 GET /a/b.png",), ("short",)], "value string")
    r = schemas.parse_access_log(lines).collect()
    assert (r[0].ip, r[0].method, r[0].url, str(r[0].event_time)) == ("83.149.9.216", "GET", "/a/b.png", "2015-05-17 10:05:03") and r[1].event_time is None


def test_json(spark, rows):
    lines = spark.createDataFrame([('{"uid":"3","paymoney":"9.5"}',), ("no json",), ("[1]",), (None,)], "value string")
    assert lines.where(schemas.is_json_object(F.col("value"))).count() == 1
    assert schemas.parse_json(lines, "uid int, paymoney string, dn string").where("uid = 3").first().paymoney == "9.5"
