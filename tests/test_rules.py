"""Rules on small inputs, with the cases that are easy to get wrong."""

import datetime

from pyspark.sql import functions as F

from tidemark.operators import aggregates, joins, rules, topn, windows

T0 = datetime.datetime(2019, 5, 21, 9, 0, 0)


def at(s):
    return T0 + datetime.timedelta(seconds=s)


def frame(spark, data, schema):
    """Rows whose timestamp column is given in seconds after T0."""
    place = next(i for i, c in enumerate(schema.split(", ")) if c.endswith("timestamp"))
    return spark.createDataFrame([tuple(at(x) if i == place else x for i, x in enumerate(r)) for r in data], schema)


def test_consecutive_failures(spark, rows):
    logs = [(1035, "fail", 42, 0), (1035, "fail", 43, 1), (1035, "fail", 44, 2), (1035, "fail", 45, 3), (83419, "fail", 82, 4), (83419, "success", 84, 5), (83419, "fail", 86, 6), (7, "fail", 0, 7), (7, "fail", 5, 8), (8, "fail", 0, 9), (8, "fail", 4, 10)]
    df = frame(spark, logs, "user_id long, status string, ts timestamp, seq long")
    got = rules.consecutive_failures(df, ["user_id"], ["ts", "seq"], "ts", F.col("status") == "fail", 5.0)
    assert rows(got) == sorted([(1035, at(42), at(43)), (1035, at(43), at(44)), (1035, at(44), at(45)), (8, at(0), at(4))], key=repr)  # a gap of exactly 5 s is no warning


def test_failures_by_timer(spark, rows):
    logs = [(5402, "fail", s, i) for i, s in enumerate((0, 1, 1, 2, 3, 4))] + [(9, "fail", 0, 10), (9, "success", 2, 11), (9, "fail", 3, 12)]
    df = frame(spark, logs, "user_id long, status string, ts timestamp, seq long")
    got = rules.failures_by_timer(df, ["user_id"], ["ts", "seq"], "ts", F.col("status") == "fail", 5.0)
    assert rows(got) == [(5402, at(0), at(4), 6)]


def test_order_outcomes(spark, rows):
    logs = [(1, "create", 0), (1, "pay", 899), (2, "create", 0), (2, "pay", 900), (3, "create", 0), (4, "pay", 5), (5, "pay", 3), (5, "create", 7), (6, "other", 1)]
    df = frame(spark, logs, "order_id long, kind string, ts timestamp")
    got = rules.order_outcomes(df, "order_id", "ts", F.col("kind") == "create", F.col("kind") == "pay")
    assert rows(got) == [(1, "payed successfully"), (2, "payed but already timeout"), (3, "order timeout"), (4, "already payed but not found created log"), (5, "payed successfully")]
    pattern = rules.followed_by(df, ["order_id"], "ts", F.col("kind") == "create", F.col("kind") == "pay", 900.0)
    assert rows(pattern, "order_id", "outcome") == [(1, "payed successfully"), (2, "order timeout"), (3, "order timeout"), (5, "order timeout")]


def test_blacklist(spark):
    df = frame(spark, [(1, 2, i, i) for i in range(103)] + [(1, 2, 86400, 200)], "user_id long, ad_id long, ts timestamp, seq long")
    got = rules.blacklist(df, ["user_id", "ad_id"], "ts", ["ts", "seq"], 100).groupBy("verdict").count().collect()
    assert {r.verdict: r["count"] for r in got} == {"pass": 101, "warn": 1, "drop": 2}  # exactly 100 pass a day; the next day starts anew


def test_jumps_and_rises(spark, rows):
    df = frame(spark, [("a", 0, 30.0), ("a", 1, 41.0), ("a", 2, 51.0), ("a", 3, 51.0), ("a", 9, 40.0), ("b", 0, 99.0)], "id string, ts timestamp, t double")
    assert rows(rules.jumps(df, ["id"], ["ts"], "t"), "last", "t") == [(30.0, 41.0), (51.0, 40.0)]  # a difference of exactly 10 is none
    assert rows(rules.rises(df, ["id"], ["ts"], "ts", "t", 2.0), "id", "alert_at") == [("a", at(3))]
    assert rows(rules.rises(df, ["id"], ["ts"], "ts", "t", 8.0)) == []  # the fall comes in the same second
    assert ("b", at(2)) in rows(rules.rises(df, ["id"], ["ts"], "ts", "t", 2.0, zero_init=True), "id", "alert_at")


def test_route(spark, rows):
    df = spark.createDataFrame([(30.0,), (35.0,), (None,)], "t double")
    assert rows(rules.route(df, "r", freezing=F.col("t") < 35)) == sorted([(30.0, "freezing"), (35.0, "main"), (None, "main")], key=repr)


def test_pairwise_average(spark, rows):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate((3, 5, 7, 4, 2))], "k long, i long, v long")
    assert rows(aggregates.pairwise_average(df, ["k"], ["i"], "v"), "average") == [(4,), (5,)]


def test_rolling_extreme_keeps_first_fields(spark, rows):
    df = spark.createDataFrame([("a", 1, 9.0), ("a", 2, 4.0), ("a", 3, 6.0)], "id string, ts long, t double")
    assert rows(aggregates.rolling_extreme(df, ["id"], ["ts"], "t"), "ts", "t") == [(1, 4.0), (1, 4.0), (1, 9.0)]


def test_top_two_of_one_row(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 2.0), ("b", 1.0)], "k string, v double")
    assert rows(aggregates.top_rows(df, ["k"], "v")) == [("a", 1.0, 1), ("b", 2.0, 1), ("b", 2.0, 2)]


def test_top_n_ties(spark, rows):
    df = spark.createDataFrame([(1, 5, 3), (1, 2, 3), (1, 9, 4)], "w int, item int, n long")
    assert rows(topn.top_n(df, ["w"], [F.desc("n"), F.asc("item")], 2), "item", "rank") == [(2, 2), (9, 1)]


def test_interval_bounds_and_outer_match(spark, rows):
    a = frame(spark, [("x", 100), ("y", 100)], "l string, lt timestamp")
    b = frame(spark, [("x", 85), ("x", 120), ("x", 121), ("z", 100)], "r string, rt timestamp")
    got = joins.interval_join(a, b, "l", "r", "lt", "rt", "-15 seconds", "20 seconds")
    assert rows(got, "l", "rt") == [("x", at(85)), ("x", at(120))]
    same = joins.bucketed_interval_join(a, b, "l", "r", "lt", "rt", "-15 seconds", "20 seconds")
    assert rows(same, "l", "rt") == rows(got, "l", "rt")
    outcomes = joins.match_two_streams(a, b, "l", "r", "lt", "rt", "20 seconds", "15 seconds")
    assert sorted(r.outcome for r in outcomes.collect()) == ["left_only", "matched", "matched", "right_only", "right_only"]


def test_as_of(spark, rows):
    orders = frame(spark, [("p1", 10), ("p1", 20), ("p1", 5), ("p2", 10)], "product string, order_time timestamp")
    versions = frame(spark, [("p1", 10, 1.0), ("p1", 15, 2.0)], "product string, update_time timestamp, price double")
    got = joins.as_of_join(orders, versions, "product", "order_time", "update_time", ["price"])
    assert rows(got, "product", "order_time", "price") == sorted([("p1", at(10), 1.0), ("p1", at(20), 2.0), ("p1", at(5), None), ("p2", at(10), None)], key=repr)


def test_co_group_keeps_every_left_row_once(spark, rows):
    a = frame(spark, [(1, 0), (1, 1), (2, 0)], "uid long, a_ts timestamp")
    b = frame(spark, [(1, 2, "x")], "uid long, b_ts timestamp, v string")
    got = joins.co_group_left(a, b, ["uid"], "a_ts", "b_ts", "10 minutes", ["v"])
    assert rows(got, "uid", "v") == [(1, "x"), (1, "x"), (2, "")]


def test_enrich_miss_is_empty(spark, rows):
    facts = spark.createDataFrame([(1, "w"), (9, "w")], "ad_id int, dn string")
    dim = spark.createDataFrame([("1", "w", "ad-1")], "adid string, dn string, adname string")
    assert rows(joins.enrich(facts, dim, ["ad_id", "dn"], ["adid", "dn"], ["adname"]), "ad_id", "adname") == [(1, "ad-1"), (9, "")]


def test_latest_left_join_with_delete(spark, rows):
    a = spark.createDataFrame([(1, 1, "I", 10), (1, 2, "U", 11), (2, 3, "I", 20), (2, 4, "D", 20), (3, 5, "I", 30)], "id int, seq long, op string, v int")
    b = spark.createDataFrame([(1, 1, "I", 7), (3, 2, "I", 8), (3, 3, "D", 8)], "id2 int, seq long, op string, w int")
    assert rows(joins.latest_left_join(a, b, ["id"], ["id2"], "seq", F.col("id") == F.col("id2")), "id", "v", "w") == sorted([(1, 11, 7), (3, 30, None)], key=repr)


def test_hopping_count_equals_plain_windows(spark, rows):
    df = frame(spark, [("a", s) for s in (0, 1, 59, 60, 61, 600)] + [("b", 3599)], "k string, ts timestamp")
    plain = windows.hopping(df, "ts", "10 minutes", "1 minute", ["k"], F.count(F.lit(1)).alias("n"))
    two = windows.hopping_count(df, "ts", "10 minutes", "1 minute", ["k"])
    assert rows(two, "window_start", "k", "n") == rows(plain, "window_start", "k", "n")
    assert sum(r[2] for r in rows(two, "window_start", "k", "n")) == 7 * 10


def test_offsets(spark, rows):
    df = frame(spark, [("a", 0)], "k string, ts timestamp")
    w = windows.tumbling(df, "ts", "1 hour", ["k"], F.count(F.lit(1)).alias("n"), offset="30 minutes")
    assert rows(w, "window_start") == [(T0 - datetime.timedelta(minutes=30),)]
    assert windows.seconds("-8 hours") == -28800
    assert windows.hopping(df, "ts", "1 minute", "10 seconds", ["k"], F.count(F.lit(1)).alias("n"), offset="-8 hours").count() == 6


def test_row_windows(spark, rows):
    df = spark.createDataFrame([("a", i) for i in range(1, 13)], "k string, i int")
    got = windows.row_windows(df, ["k"], ["i"], 10, 5, F.min("i").alias("lo"), F.max("i").alias("hi"))
    assert rows(got, "nth", "lo", "hi") == [(10, 1, 10), (5, 1, 5)]
