"""The library's queries over the driver's tables, each with the SQL that says the same.

``events`` plays the logs: views are page views, clicks are ad clicks, errors are failed logins, signups
create orders and purchases pay them; the number in ``props`` is the item; ``value`` is a temperature.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import scalar
from ..operators import aggregates, joins, rules, topn, windows
from ..sinks import writers
from ..streaming import routing

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        @wraps(f)
        def in_utc(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables' times are UTC without a zone
            return f(spark, sf_dir)

        _QUERIES[f.__name__] = in_utc
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    e = table(spark, sf_dir, "events")
    e = e.withColumn("item", F.get_json_object("props", "$.k").cast("int"))
    return e.where(F.col("event_type") == kind) if kind else e


def epoch(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


ITEM = "CAST(json_extract_string(props, '$.k') AS INT)"


# Windows and top N


@query(f"""
WITH b AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS b, {ITEM} AS item, count(*) AS c FROM events WHERE event_type = 'view' GROUP BY ALL),
w AS (SELECT b + INTERVAL '5 minutes' * i AS window_end, item, CAST(sum(c) AS BIGINT) AS n FROM b, range(1, 13) AS t(i) GROUP BY ALL)
SELECT window_end, item, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY window_end ORDER BY n DESC, item) AS rank FROM w) WHERE rank <= 3
""")
def hot_items_topn(spark, sf_dir):
    """Three most viewed items of every hour, every five minutes."""
    counts = windows.hopping_count(events(spark, sf_dir, "view"), "ts", "1 hour", "5 minutes", ["item"])
    return topn.top_n(counts.drop("window_start"), ["window_end"], [F.desc("n"), F.asc("item")], 3)


@query(f"""
WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts, INTERVAL '30 minutes') AS window_start, {ITEM} AS item, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT window_start, window_start + INTERVAL '1 hour' AS window_end, item, n, rank
FROM (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, item) AS rank FROM w) WHERE rank <= 2
""")
def hot_items_offset(spark, sf_dir):
    counts = windows.tumbling(events(spark, sf_dir, "view"), "ts", "1 hour", ["item"], F.count(F.lit(1)).alias("n"), offset="30 minutes")
    return topn.top_n(counts, ["window_start", "window_end"], [F.desc("n"), F.asc("item")], 2)


@query(f"""
WITH b AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS b, {ITEM} AS item, count(*) AS c FROM events WHERE event_type = 'view' GROUP BY ALL),
w AS (SELECT b + INTERVAL '5 minutes' * i AS window_end, item, CAST(sum(c) AS BIGINT) AS n FROM b, range(1, 13) AS t(i) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY window_end ORDER BY n DESC, item) AS rank FROM w)
SELECT window_end, 'time: ' || strftime(window_end, '%Y-%m-%d %H:%M:%S') || chr(10)
  || string_agg('No' || rank || ': id=' || item || ' count=' || n, chr(10) ORDER BY rank) || chr(10) || repeat('=', 30) AS report
FROM r WHERE rank <= 3 GROUP BY window_end
""")
def hot_items_report(spark, sf_dir):
    return topn.report(hot_items_topn(spark, sf_dir), "window_end", "item", "n")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, count(*) AS pv FROM events WHERE event_type = 'view' GROUP BY ALL")
def page_view_hourly(spark, sf_dir):
    return windows.tumbling(events(spark, sf_dir, "view"), "ts", "1 hour", [], F.count(F.lit(1)).alias("pv"))


@query("""
WITH b AS (SELECT time_bucket(INTERVAL '25 minutes', ts, TIMESTAMP '1970-01-01 00:20:00') AS b, user_id, value FROM events)
SELECT b - INTERVAL '25 minutes' * i AS window_start, b - INTERVAL '25 minutes' * i + INTERVAL '50 minutes' AS window_end, user_id, min(value) AS lowest
FROM b, range(0, 2) AS t(i) GROUP BY ALL
""")
def sliding_with_offset(spark, sf_dir):
    """Windows of 50 minutes every 25, moved by -8 hours, which is 20 minutes modulo the slide."""
    return windows.hopping(events(spark, sf_dir), "ts", "50 minutes", "25 minutes", ["user_id"], F.min("value").alias("lowest"), offset="-8 hours")


@query("""
WITH b AS (SELECT time_bucket(INTERVAL '15 minutes', ts) AS b, event_type, count(*) AS c FROM events GROUP BY ALL)
SELECT b - INTERVAL '15 minutes' * i AS hop_start, b - INTERVAL '15 minutes' * i + INTERVAL '1 hour' AS hop_end,
       b - INTERVAL '15 minutes' * i + INTERVAL '1 hour' - INTERVAL '1 microsecond' AS hop_rowtime, event_type, CAST(sum(c) AS BIGINT) AS n
FROM b, range(0, 4) AS t(i) GROUP BY ALL
""")
def hop_sql(spark, sf_dir):
    """The SQL form of a sliding window, with its start, end and row time."""
    events(spark, sf_dir).createOrReplaceTempView("tidemark_events")
    return spark.sql("""
        SELECT window.start AS hop_start, window.end AS hop_end, window_time(window) AS hop_rowtime, event_type, n
        FROM (SELECT window, event_type, count(*) AS n FROM tidemark_events GROUP BY window(ts, '1 hour', '15 minutes'), event_type)""")


@query("""
WITH f AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL '3 hours' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT min(ts) AS session_start, max(ts) + INTERVAL '3 hours' AS session_end, user_id, count(*) AS n, max(value) AS highest FROM s GROUP BY user_id, k
""")
def session_sql(spark, sf_dir):
    """The SQL form of a session window."""
    events(spark, sf_dir).createOrReplaceTempView("tidemark_events")
    return spark.sql("""
        SELECT session_window.start AS session_start, session_window.end AS session_end, user_id, count(*) AS n, max(value) AS highest
        FROM tidemark_events GROUP BY session_window(ts, '3 hours'), user_id""")


@query("""
WITH h AS (SELECT event_id, ts, time_bucket(INTERVAL '1 hour', ts) AS window_start,
  list_reduce(list_transform(string_split(user_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (h * 61 + c) & 268435455, 0::BIGINT) AS position FROM events WHERE event_type = 'view'),
f AS (SELECT *, row_number() OVER (PARTITION BY window_start, position ORDER BY ts, event_id) AS nth FROM h)
SELECT window_start, event_id, row_number() OVER (PARTITION BY window_start ORDER BY ts, event_id) AS uv FROM f WHERE nth = 1
""")
def unique_visitors_first_sighting(spark, sf_dir):
    """The bitmap's running count of each hour, given out whenever a position is set for the first time."""
    return aggregates.bitmap_distinct_sightings(events(spark, sf_dir, "view"), "ts", "1 hour", "user_id", "event_id")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, count(DISTINCT user_id) AS uv FROM events WHERE event_type = 'view' GROUP BY ALL")
def unique_visitors_hourly(spark, sf_dir):
    return aggregates.distinct_per_window(events(spark, sf_dir, "view"), "ts", "1 hour", "user_id")


@query("""
WITH h AS (SELECT ts, list_reduce(list_transform(string_split(user_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (h * 61 + c) & 268435455, 0::BIGINT) AS position FROM events WHERE event_type = 'view')
SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, count(DISTINCT position) AS uv FROM h GROUP BY ALL
""")
def unique_visitors_bitmap(spark, sf_dir):
    return aggregates.bitmap_distinct_per_window(events(spark, sf_dir, "view"), "ts", "1 hour", "user_id")


@query()
def unique_visitors_approximate(spark, sf_dir):
    return aggregates.approximate_distinct_per_window(events(spark, sf_dir, "view"), "ts", "1 day", "user_id")


@query("""
WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT min(ts) AS window_start, max(ts) + INTERVAL '6 hours' AS window_end, user_id, count(*) AS n FROM s GROUP BY user_id, k
""")
def session_activity(spark, sf_dir):
    return windows.sessions(events(spark, sf_dir), "ts", "6 hours", ["user_id"], F.count(F.lit(1)).alias("n"))


@query("""
WITH u AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_replace(url, '[?#].*$', '') AS path FROM pages WHERE NOT regexp_matches(url, '\\.(css|js|png|ico)$')),
c AS (SELECT host, path, count(*) AS n FROM u GROUP BY ALL)
SELECT host, path, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n DESC, path) AS rank FROM c) WHERE rank <= 5
""")
def hot_urls_filtered(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where(scalar.not_static(F.col("url")))
    c = p.groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_replace("url", "[?#].*$", "").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return topn.top_n(c, ["host"], [F.desc("n"), F.asc("path")], 5)


@query("""
WITH b AS (SELECT time_bucket(INTERVAL '10 minutes', ts) AS b, event_type, user_id % 5 AS channel, count(*) AS c FROM events WHERE event_type <> 'error' GROUP BY ALL)
SELECT b + INTERVAL '10 minutes' * i AS window_end, event_type, channel, CAST(sum(c) AS BIGINT) AS n FROM b, range(1, 7) AS t(i) GROUP BY ALL
""")
def channel_behavior_counts(spark, sf_dir):
    """Counts by channel and behavior without one behavior, hour by hour, every ten minutes."""
    e = events(spark, sf_dir).where("event_type <> 'error'").withColumn("channel", F.col("user_id") % 5)
    return windows.hopping_count(e, "ts", "1 hour", "10 minutes", ["event_type", "channel"]).drop("window_start")


@query("""
WITH b AS (SELECT time_bucket(INTERVAL '10 minutes', ts) AS b, count(*) AS c FROM events WHERE event_type <> 'error' GROUP BY ALL)
SELECT b + INTERVAL '10 minutes' * i AS window_end, CAST(sum(c) AS BIGINT) AS n FROM b, range(1, 7) AS t(i) GROUP BY ALL
""")
def total_counts(spark, sf_dir):
    return windows.hopping_count(events(spark, sf_dir).where("event_type <> 'error'"), "ts", "1 hour", "10 minutes", []).drop("window_start")


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n, sum(value) > 0 AS positive FROM events GROUP BY ALL")
def tumble_sql(spark, sf_dir):
    """The SQL form of a tumbling window."""
    events(spark, sf_dir).createOrReplaceTempView("tidemark_events")
    return spark.sql("SELECT window.start AS window_start, event_type, count(*) AS n, sum(value) > 0 AS positive FROM tidemark_events GROUP BY window(ts, '1 day'), event_type")


@query("""
SELECT event_id, user_id, CAST(count(*) OVER w AS BIGINT) AS n, round(sum(CAST(round(value * 100) AS BIGINT)) OVER w, 0)::BIGINT AS cents
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '6 hours' PRECEDING AND CURRENT ROW)
""")
def over_range_count_sum(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("c", F.round(F.col("value") * 100).cast("long"))
    return windows.over_range(e, ["user_id"], "ts", "6 hours", ("n", F.count(F.lit(1))), ("cents", F.sum("c"))).select("event_id", "user_id", "n", "cents")


@query("""
WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, CAST(round(value * 100) AS BIGINT) AS c FROM events),
e AS (SELECT user_id, rn AS nth FROM r WHERE rn % 5 = 0)
SELECT e.user_id, e.nth, count(*) AS n, CAST(sum(r.c) AS BIGINT) AS cents FROM e JOIN r ON e.user_id = r.user_id AND r.rn > e.nth - 10 AND r.rn <= e.nth GROUP BY ALL
""")
def row_count_window(spark, sf_dir):
    """Windows of ten rows every five rows."""
    e = events(spark, sf_dir).withColumn("c", F.round(F.col("value") * 100).cast("long"))
    return windows.row_windows(e, ["user_id"], ["ts", "event_id"], 10, 5, F.count(F.lit(1)).alias("n"), F.sum("c").alias("cents"))


@query("""
SELECT event_type, user_id, n, rank() OVER w AS rank, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS row_number
FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) WINDOW w AS (PARTITION BY event_type ORDER BY n DESC)
""")
def rank_row_number(spark, sf_dir):
    events(spark, sf_dir).groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n")).createOrReplaceTempView("tidemark_counts")
    return spark.sql(
        "SELECT event_type, user_id, n, CAST(rank() OVER (PARTITION BY event_type ORDER BY n DESC) AS BIGINT) AS rank, "
        "CAST(row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS BIGINT) AS row_number FROM tidemark_counts"
    )


# Aggregations


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events")
def running_count(spark, sf_dir):
    return aggregates.rolling(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], n=F.count(F.lit(1))).select("event_id", "user_id", "n")


@query("""
SELECT user_id, first_value(event_id) OVER w AS event_id, min(value) OVER w AS value, first_value(event_type) OVER w AS event_type
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def rolling_min(spark, sf_dir):
    """The smallest value so far; the other fields stay the first row's."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "event_type")
    return aggregates.rolling_extreme(e, ["user_id"], ["ts", "event_id"], "value").select("user_id", "event_id", "value", "event_type")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
SELECT event_id, user_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS highest,
       CASE WHEN rn = 1 THEN value ELSE value + 10 END AS reduced FROM r
""")
def rolling_max_reduce(spark, sf_dir):
    e = aggregates.rolling(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], highest=F.max("value")).withColumn("reduced", F.col("value"))
    return aggregates.rolling_reduce(e, ["user_id"], ["ts", "event_id"], reduced="value + 10").select("event_id", "user_id", "highest", "reduced")


@query("""
SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS window_end, user_id,
       arg_min(event_id, (value, event_id)) AS event_id, arg_min(value, (value, event_id)) AS value FROM events GROUP BY ALL
""")
def window_min_by(spark, sf_dir):
    return aggregates.window_min_row(table(spark, sf_dir, "events").select("ts", "user_id", "event_id", "value"), "ts", "1 day", ["user_id"], "value", ["event_id"]).drop("ts")


@query("""
SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS window_end, user_id,
       min(value) AS value, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY ALL
""")
def window_reduce(spark, sf_dir):
    return aggregates.window_reduce(events(spark, sf_dir), "ts", "1 day", ["user_id"], "value", "event_type", ["ts", "event_id"])


@query("SELECT user_id, round(avg(value), 6) AS average, count(*) AS n FROM events GROUP BY ALL")
def udaf_avg(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("average"), F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, CAST(round(avg(value) * count(*) * 100) AS BIGINT) AS cents FROM events GROUP BY user_id")
def udaf_avg_sql(spark, sf_dir):
    """The registered aggregate in SQL."""
    scalar.register(spark)
    table(spark, sf_dir, "events").select("user_id", "value").createOrReplaceTempView("tidemark_events")
    return spark.sql("""
        SELECT user_id, CAST(round(average * n * 100) AS BIGINT) AS cents
        FROM (SELECT user_id, avg_temp(value) AS average FROM tidemark_events GROUP BY user_id) JOIN (SELECT user_id, count(*) AS n FROM tidemark_events GROUP BY user_id) USING (user_id)""")


@query("SELECT user_id, value, rank FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC) AS rank FROM events) WHERE rank <= 2")
def table_agg_top2_sql(spark, sf_dir):
    """The registered table aggregate in SQL."""
    scalar.register(spark)
    table(spark, sf_dir, "events").selectExpr("cast(user_id as string) AS id", "value").createOrReplaceTempView("tidemark_values")
    return spark.sql("SELECT CAST(id AS BIGINT) AS user_id, value, rank FROM top_two(TABLE(SELECT id, value FROM tidemark_values) PARTITION BY id)")


@query("SELECT user_id, value, rank FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC) AS rank FROM events) WHERE rank <= 2")
def table_agg_top2(spark, sf_dir):
    return aggregates.top_rows(events(spark, sf_dir), ["user_id"], "value", 2)


@query("""
WITH r AS (SELECT user_id, CAST(floor(value) AS BIGINT) AS v, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 2 AS pair FROM events)
SELECT user_id, pair, CAST(sum(v) // 2 AS BIGINT) AS average FROM r GROUP BY user_id, pair HAVING count(*) = 2
""")
def pairwise_avg(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("v", F.floor("value"))
    return aggregates.pairwise_average(e, ["user_id"], ["ts", "event_id"], "v")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name || ' ' || p_type, ' ')) AS word FROM part) WHERE word <> '' GROUP BY word")
def word_count(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC LIMIT 10")
def top10_order_by(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type").limit(10)


@query("SELECT o_custkey AS uid, o_orderstatus AS dn, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS paymoney FROM orders GROUP BY ALL")
def merge_sum(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderstatus").alias("dn"), scalar.money(F.format_string("%.2f", "o_totalprice")).alias("m"))
    return o.groupBy("uid", "dn").agg(F.sum("m").cast("double").alias("paymoney"))


# Rules and patterns


@query("""
SELECT event_id, user_id, last, value FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events) WHERE abs(value - last) > 10
""")
def temperature_jump(spark, sf_dir):
    return rules.jumps(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value", 10.0).select("event_id", "user_id", "last", "value")


@query("""
WITH l AS (SELECT user_id, ts, event_id, value, lag(value) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(CASE WHEN value < before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM l),
g AS (SELECT user_id, run, min(CASE WHEN value > before THEN ts END) AS start, min(ts) AS from_ FROM r GROUP BY user_id, run),
e AS (SELECT *, lead(from_) OVER (PARTITION BY user_id ORDER BY run) AS stop FROM g)
SELECT user_id, epoch_us(start) AS start_us FROM e WHERE start IS NOT NULL AND (stop IS NULL OR stop > start + INTERVAL '2 hours')
""")
def rise_alert(spark, sf_dir):
    r = rules.rises(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "ts", "value", 7200.0)
    return r.select("user_id", F.round(epoch("start"), -0).cast("long").alias("start_us"))


@query("SELECT event_id, value, CASE WHEN value < 35.0 THEN 'freezing' ELSE 'main' END AS route FROM events")
def freezing_route(spark, sf_dir):
    return rules.route(events(spark, sf_dir), "route", freezing=F.col("value") < 35.0).select("event_id", "value", "route")


_FAILS = """
WITH l AS (SELECT user_id, ts, event_type, lag(event_type) OVER w AS before, lag(ts) OVER w AS first_at FROM events WINDOW w AS (PARTITION BY user_id ORDER BY {order}))
SELECT user_id, first_at, ts AS last_at FROM l WHERE event_type = 'error' AND before = 'error' AND abs(epoch(ts) - epoch(first_at)) < 21600
"""


@query(_FAILS.format(order="ts, event_id"))
def login_fail_strict(spark, sf_dir):
    return rules.consecutive_failures(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "ts", F.col("event_type") == "error", 21600.0)


@query(_FAILS.format(order="event_id"))
def login_fail_immediate(spark, sf_dir):
    return rules.consecutive_failures(events(spark, sf_dir), ["user_id"], ["event_id"], "ts", F.col("event_type") == "error", 21600.0)


@query("""
WITH e AS (SELECT user_id, event_id, ts, event_type = 'error' AS failed FROM events),
s AS (SELECT user_id, event_id, ts AS t, failed, 0 AS timer FROM e UNION ALL SELECT user_id, event_id, ts + INTERVAL '6 hours', failed, 1 FROM e WHERE failed),
c AS (SELECT *, coalesce(sum(CASE WHEN timer = 1 OR NOT failed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, timer, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM s)
SELECT user_id, epoch_us(min(t) FILTER (timer = 0 AND failed)) AS first_us, epoch_us(max(t) FILTER (timer = 0 AND failed)) AS last_us, count(*) FILTER (timer = 0 AND failed) AS times
FROM c GROUP BY user_id, part HAVING max(timer) = 1 AND count(*) FILTER (timer = 0 AND failed) >= 2
""")
def login_fail_timer(spark, sf_dir):
    found = rules.failures_by_timer(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "ts", F.col("event_type") == "error", 21600.0)
    return found.select("user_id", epoch("first_at").alias("first_us"), epoch("last_at").alias("last_us"), "times")


@query("""
WITH p AS (SELECT f.user_id, f.event_id, f.ts AS first_at, (SELECT min(n.ts) FROM events n WHERE n.user_id = f.user_id AND n.event_type = 'purchase' AND n.ts >= f.ts) AS next_at
  FROM events f WHERE f.event_type = 'signup')
SELECT user_id, epoch_us(first_at) AS first_us, CASE WHEN next_at < first_at + INTERVAL '15 hours' THEN epoch_us(next_at) END AS then_us,
       CASE WHEN next_at < first_at + INTERVAL '15 hours' THEN 'payed successfully' ELSE 'order timeout' END AS outcome FROM p
""")
def order_pay_pattern(spark, sf_dir):
    r = rules.followed_by(events(spark, sf_dir), ["user_id"], "ts", F.col("event_type") == "signup", F.col("event_type") == "purchase", 54000.0)
    return r.select("user_id", epoch("first_at").alias("first_us"), epoch("then_at").alias("then_us"), "outcome")


_OUTCOMES = """
WITH o AS (SELECT {key} AS order_id, min(CASE WHEN event_type = 'signup' THEN ts END) AS c, min(CASE WHEN event_type = 'purchase' THEN ts END) AS p FROM events GROUP BY ALL)
SELECT order_id, CASE WHEN c IS NULL THEN 'already payed but not found created log' WHEN p IS NULL THEN 'order timeout'
  WHEN p < c + INTERVAL '15 hours' THEN 'payed successfully' ELSE 'payed but already timeout' END AS outcome
FROM o WHERE c IS NOT NULL OR p IS NOT NULL
"""
_ORDER = "user_id * 1000 + CAST(json_extract_string(props, '$.k') AS INT)"


def _orders(spark, sf_dir) -> DataFrame:
    return rules.order_outcomes(events(spark, sf_dir).withColumn("order_id", F.col("user_id") * 1000 + F.col("item")), "order_id", "ts", F.col("event_type") == "signup", F.col("event_type") == "purchase", 54000.0)


@query(_OUTCOMES.format(key=_ORDER))
def order_match_outcomes(spark, sf_dir):
    return _orders(spark, sf_dir)


@query(f"SELECT * FROM ({_OUTCOMES.format(key=_ORDER)}) WHERE outcome = 'order timeout'")
def order_timeout(spark, sf_dir):
    return _orders(spark, sf_dir).where("outcome = 'order timeout'")


@query(f"""
SELECT event_id, user_id, {ITEM} % 10 AS ad_id, CASE WHEN n <= 2 THEN 'pass' WHEN n = 3 THEN 'warn' ELSE 'drop' END AS verdict
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, {ITEM} % 10, date_trunc('day', ts) ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('click', 'view'))
""")
def ad_blacklist(spark, sf_dir):
    e = events(spark, sf_dir).where("event_type in ('click', 'view')").withColumn("ad_id", F.col("item") % 10)
    return rules.blacklist(e, ["user_id", "ad_id"], "ts", ["ts", "event_id"], 2).select("event_id", "user_id", "ad_id", "verdict")


@query(f"""
WITH v AS (SELECT *, row_number() OVER (PARTITION BY user_id, {ITEM} % 10, date_trunc('day', ts) ORDER BY ts, event_id) AS nth FROM events WHERE event_type IN ('click', 'view')),
b AS (SELECT time_bucket(INTERVAL '10 minutes', ts) AS b, coalesce(n_name, '') AS province, count(*) AS c
  FROM v LEFT JOIN customer ON user_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE nth <= 2 GROUP BY ALL)
SELECT b + INTERVAL '10 minutes' * i AS window_end, province, CAST(sum(c) AS BIGINT) AS n FROM b, range(1, 7) AS t(i) GROUP BY ALL
""")
def ad_click_by_region(spark, sf_dir):
    """Clicks that the blacklist lets pass, by province."""
    e = events(spark, sf_dir).where("event_type in ('click', 'view')").withColumn("ad_id", F.col("item") % 10)
    e = rules.blacklist(e, ["user_id", "ad_id"], "ts", ["ts", "event_id"], 2).where("verdict = 'pass'")
    places = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("province"))
    e = joins.enrich(e, places, ["user_id"], ["c_custkey"], ["province"])
    return windows.hopping_count(e, "ts", "1 hour", "10 minutes", ["province"]).drop("window_start")


# Joins


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    pay = events(spark, sf_dir, "purchase").select(F.col("event_id").alias("pay_id"), F.col("user_id").alias("pay_user"), F.col("ts").alias("pay_ts"))
    receipt = events(spark, sf_dir, "signup").select(F.col("event_id").alias("receipt_id"), F.col("user_id").alias("receipt_user"), F.col("ts").alias("receipt_ts"))
    return pay, receipt


_PAY = "(SELECT event_id AS pay_id, user_id AS pay_user, ts AS pay_ts FROM events WHERE event_type = 'purchase')"
_RECEIPT = "(SELECT event_id AS receipt_id, user_id AS receipt_user, ts AS receipt_ts FROM events WHERE event_type = 'signup')"
_INTERVAL = f"SELECT pay_id, receipt_id, pay_user FROM {_PAY} JOIN {_RECEIPT} ON pay_user = receipt_user AND receipt_ts BETWEEN pay_ts - INTERVAL '15 hours' AND pay_ts + INTERVAL '20 hours'"


@query(_INTERVAL)
def interval_join(spark, sf_dir):
    pay, receipt = _sides(spark, sf_dir)
    return joins.interval_join(pay, receipt, "pay_user", "receipt_user", "pay_ts", "receipt_ts", "-15 hours", "20 hours").select("pay_id", "receipt_id", "pay_user")


@query(_INTERVAL)
def interval_join_bucketed(spark, sf_dir):
    pay, receipt = _sides(spark, sf_dir)
    return joins.bucketed_interval_join(pay, receipt, "pay_user", "receipt_user", "pay_ts", "receipt_ts", "-15 hours", "20 hours").select("pay_id", "receipt_id", "pay_user")


@query(f"SELECT pay_id, receipt_id FROM {_PAY} p, {_RECEIPT} r WHERE p.pay_user = r.receipt_user AND r.receipt_ts BETWEEN p.pay_ts - INTERVAL '10 hours' AND p.pay_ts + INTERVAL '5 hours'")
def interval_join_sql(spark, sf_dir):
    pay, receipt = _sides(spark, sf_dir)
    pay.createOrReplaceTempView("tidemark_pay")
    receipt.createOrReplaceTempView("tidemark_receipt")
    return spark.sql("SELECT pay_id, receipt_id FROM tidemark_pay p, tidemark_receipt r WHERE p.pay_user = r.receipt_user AND r.receipt_ts BETWEEN p.pay_ts - INTERVAL 10 HOUR AND p.pay_ts + INTERVAL 5 HOUR")


@query(f"SELECT time_bucket(INTERVAL '1 day', pay_ts) AS window_start, pay_user AS user_id, pay_id, receipt_id FROM {_PAY} JOIN {_RECEIPT} ON pay_user = receipt_user AND time_bucket(INTERVAL '1 day', pay_ts) = time_bucket(INTERVAL '1 day', receipt_ts)")
def window_join(spark, sf_dir):
    pay, receipt = _sides(spark, sf_dir)
    j = joins.window_join(pay.withColumnRenamed("pay_user", "user_id"), receipt.withColumnRenamed("receipt_user", "user_id"), "user_id", "pay_ts", "receipt_ts", "1 day")
    return j.select(F.col("window.start").alias("window_start"), "user_id", "pay_id", "receipt_id")


@query(f"""
SELECT pay_id, receipt_id, CASE WHEN pay_id IS NULL THEN 'right_only' WHEN receipt_id IS NULL THEN 'left_only' ELSE 'matched' END AS outcome
FROM {_PAY} FULL JOIN {_RECEIPT} ON pay_user = receipt_user AND receipt_ts >= pay_ts - INTERVAL '3 hours' AND receipt_ts <= pay_ts + INTERVAL '5 hours'
""")
def tx_match_outer(spark, sf_dir):
    pay, receipt = _sides(spark, sf_dir)
    return joins.match_two_streams(pay, receipt, "pay_user", "receipt_user", "pay_ts", "receipt_ts", "5 hours", "3 hours").select("pay_id", "receipt_id", "outcome")


@query("""
WITH o AS (SELECT event_id AS order_id, user_id AS product_id, ts AS order_time FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id AS product_id, ts AS update_time, min(value) AS price FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT o.order_id, o.product_id, v.price, v.update_time FROM o ASOF LEFT JOIN v ON o.product_id = v.product_id AND o.order_time >= v.update_time
""")
def asof_version_join(spark, sf_dir):
    """Each order with the price version of its time."""
    orders = events(spark, sf_dir, "purchase").select(F.col("event_id").alias("order_id"), F.col("user_id").alias("product_id"), F.col("ts").alias("order_time"))
    versions = events(spark, sf_dir, "view").groupBy(F.col("user_id").alias("product_id"), F.col("ts").alias("update_time")).agg(F.min("value").alias("price"))
    return joins.as_of_join(orders, versions, "product_id", "order_time", "update_time", ["price"]).select("order_id", "product_id", "price", "update_time")


@query(f"""
SELECT time_bucket(INTERVAL '1 day', pay_ts) AS window_start, pay_user AS user_id, pay_id, coalesce(receipt_id::VARCHAR, '') AS receipt_id
FROM {_PAY} LEFT JOIN {_RECEIPT} ON pay_user = receipt_user AND time_bucket(INTERVAL '1 day', pay_ts) = time_bucket(INTERVAL '1 day', receipt_ts)
""")
def cogroup_left(spark, sf_dir):
    pay, receipt = _sides(spark, sf_dir)
    j = joins.co_group_left(pay.withColumnRenamed("pay_user", "user_id"), receipt.withColumnRenamed("receipt_user", "user_id"), ["user_id"], "pay_ts", "receipt_ts", "1 day", ["receipt_id"])
    return j.select(F.col("window.start").alias("window_start"), "user_id", "pay_id", "receipt_id")


@query("""
SELECT c_custkey, c_name, coalesce(n_name, '') AS n_name, coalesce(r_name, '') AS r_name
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) n ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
""")
def dim_enrich(spark, sf_dir):
    """Lookups in two dimensions; a miss gives empty text."""
    nation = table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 0")
    c = joins.enrich(table(spark, sf_dir, "customer"), nation, ["c_nationkey"], ["n_nationkey"], ["n_name"])
    return joins.enrich(c, table(spark, sf_dir, "region"), ["n_regionkey"], ["r_regionkey"], ["r_name"]).select("c_custkey", "c_name", "n_name", "r_name")


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier LEFT JOIN (SELECT * FROM nation LEFT JOIN region ON n_regionkey = r_regionkey) ON s_nationkey = n_nationkey")
def dim_left_join(spark, sf_dir):
    dim = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return table(spark, sf_dir, "supplier").join(dim, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "s_name", "n_name", "r_name")


@query("SELECT p_partkey, word, CAST(length(word) AS INT) AS length FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)")
def split_lateral(spark, sf_dir):
    return joins.lateral_split(table(spark, sf_dir, "part"), "p_name", " ").select("p_partkey", "word", "length")


@query("""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS name FROM part)
SELECT p_partkey, word, CAST(length(word) AS INT) AS length FROM (SELECT p_partkey, unnest(string_split(name, ' ')) AS word FROM p WHERE name IS NOT NULL)
UNION ALL SELECT p_partkey, NULL, NULL FROM p WHERE name IS NULL
""")
def split_lateral_outer(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("name", F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")))
    return joins.lateral_split(p, "name", " ", outer=True).select("p_partkey", "word", "length")


_CHANGES = "(SELECT user_id AS id, event_id AS seq, CASE WHEN event_type = 'error' THEN 'D' WHEN event_type = 'signup' THEN 'I' ELSE 'U' END AS op, {cols} FROM events WHERE event_id % 2 = {side})"


@query(f"""
WITH a AS (SELECT id, arg_max(op, seq) AS op, arg_max(activity_id, seq) AS activity_id FROM {_CHANGES.format(cols=ITEM + " AS activity_id", side=0)} GROUP BY id),
b AS (SELECT id, arg_max(op, seq) AS op, arg_max(sku_id, seq) AS sku_id FROM {_CHANGES.format(cols=ITEM + " AS sku_id", side=1)} GROUP BY id)
SELECT a.id, a.activity_id, b.sku_id FROM (SELECT * FROM a WHERE op <> 'D') a LEFT JOIN (SELECT * FROM b WHERE op <> 'D') b ON a.id = b.id
""")
def cdc_latest_left_join(spark, sf_dir):
    """Left join of two tables known by their change logs, as they stand after all changes."""
    op = F.when(F.col("event_type") == "error", "D").when(F.col("event_type") == "signup", "I").otherwise("U")
    e = events(spark, sf_dir).select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), op.alias("op"), "item")
    a = e.where("seq % 2 = 0").withColumnRenamed("item", "activity_id")
    b = e.where("seq % 2 = 1").withColumnRenamed("item", "sku_id").withColumnRenamed("id", "id_2")
    return joins.latest_left_join(a, b, ["id"], ["id_2"], "seq", F.col("id") == F.col("id_2")).select("id", "activity_id", "sku_id")


@query("""
WITH a AS (SELECT user_id AS id, arg_max(event_type, event_id) AS kind, arg_max(ts, event_id) AS a_ts FROM events WHERE event_id % 2 = 0 GROUP BY user_id),
b AS (SELECT user_id AS id, arg_max(event_type, event_id) AS kind, arg_max(ts, event_id) AS b_ts FROM events WHERE event_id % 2 = 1 GROUP BY user_id)
SELECT a.id, epoch_us(a_ts) AS a_us, epoch_us(b_ts) AS b_us FROM a JOIN b ON a.id = b.id AND b_ts >= a_ts - INTERVAL '4 hours' AND b_ts <= a_ts WHERE a.kind <> 'error' AND b.kind <> 'error'
""")
def cdc_interval_join(spark, sf_dir):
    """Interval join, four hours back, of two tables as they stand after their change logs."""
    op = F.when(F.col("event_type") == "error", "D").otherwise("U").alias("op")
    side = lambda rest, key, ts: table(spark, sf_dir, "events").where(f"event_id % 2 = {rest}").select(F.col("user_id").alias(key), F.col("event_id").alias("seq"), op, F.col("ts").alias(ts))
    a, b = (joins.latest(side(*s), [s[1]], "seq").drop("op", "seq") for s in ((0, "id", "a_ts"), (1, "b_id", "b_ts")))
    return joins.interval_join(a, b, "id", "b_id", "a_ts", "b_ts", "-4 hours", "0 hours").select("id", epoch("a_ts").alias("a_us"), epoch("b_ts").alias("b_us"))


@query("SELECT e.event_id, e.user_id FROM events e WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND date_trunc('day', x.ts) = date_trunc('day', e.ts))")
def semi_join(spark, sf_dir):
    day = lambda df: df.withColumn("day", F.date_trunc("day", "ts"))
    return day(events(spark, sf_dir, "view")).join(day(events(spark, sf_dir, "purchase")), ["user_id", "day"], "left_semi").select("event_id", "user_id")


# Composition, routing, scalar functions


@query("""
WITH h AS (SELECT event_id, 'high' AS tag FROM events WHERE value > 30), l AS (SELECT event_id, 'low' AS tag FROM events WHERE value <= 30)
SELECT * FROM h UNION ALL SELECT * FROM l UNION ALL SELECT * FROM h UNION ALL SELECT * FROM l
""")
def union_all_tagged(spark, sf_dir):
    """Split by value, then union of both parts and the whole: each row twice."""
    tagged = events(spark, sf_dir).select("event_id", F.when(F.col("value") > 30, "high").otherwise("low").alias("tag"))
    high, low = tagged.where("tag = 'high'"), tagged.where("tag = 'low'")
    return high.unionByName(low).unionByName(tagged)


@query("SELECT user_id, count(*) FILTER (value > 30) AS high, count(*) FILTER (value <= 30) AS low FROM events GROUP BY user_id")
def split_high_low(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("value") > 30).alias("high"), F.count_if(F.col("value") <= 30).alias("low"))


@query("""
SELECT event_id AS id, value AS number, 'warning' AS text FROM events WHERE value > 30
UNION ALL SELECT o_orderkey, NULL, o_orderstatus FROM orders
""")
def comap(spark, sf_dir):
    """Two inputs of different types, mapped to one shape."""
    a = events(spark, sf_dir).where("value > 30").select(F.col("event_id").alias("id"), F.col("value").alias("number"), F.lit("warning").alias("text"))
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("text"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""
SELECT event_id, event_type FROM events
WHERE (event_type = 'view' OR value > 400) AND event_type <> 'error' AND NOT (value < 5) AND starts_with(event_type, 'v') IS NOT FALSE AND value BETWEEN 5 AND 480 AND ts >= TIMESTAMP '2024-01-05'
""")
def filters(spark, sf_dir):
    e = events(spark, sf_dir)
    kept = e.where(((F.col("event_type") == "view") | (F.col("value") > 400)) & (F.col("event_type") != "error") & ~(F.col("value") < 5) & F.col("event_type").startswith("v"))
    return kept.where(F.col("value").between(5, 480) & (F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz"))).select("event_id", "event_type")


@query("""
WITH m AS (SELECT event_id, event_type AS topic, CASE WHEN event_id % 9 = 0 THEN 'broken {' || event_id ELSE props END AS value FROM events)
SELECT event_id, CASE WHEN topic IN ('view', 'click') THEN 'dwd' || topic WHEN topic = 'signup' THEN 'dimension' ELSE 'main' END AS route FROM m WHERE NOT starts_with(value, 'broken')
""")
def json_route(spark, sf_dir):
    """Valid JSON only, routed by topic."""
    m = events(spark, sf_dir).select("event_id", F.col("event_type").alias("topic"), F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("broken {"), "event_id")).otherwise(F.col("props")).alias("value"))
    m = m.where(schemas.is_json_object(F.col("value")))
    routed = rules.route(m, "route", fact=F.col("topic").isin("view", "click"), dimension=F.col("topic") == "signup")
    return routed.select("event_id", F.when(F.col("route") == "fact", F.concat(F.lit("dwd"), "topic")).otherwise(F.col("route")).alias("route"))


@query(f"SELECT event_id, {ITEM} AS k, '{{\"id\":' || event_id || ',\"k\":' || {ITEM} || '}}' AS document FROM events")
def json_extract(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", F.from_json("props", "k int").alias("p"))
    return e.select("event_id", F.col("p.k").alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("p.k").alias("k"))).alias("document"))


@query("SELECT c_custkey, substr(md5(c_custkey::VARCHAR), 1, 5) || c_custkey || c_mktsegment AS row_key, md5(c_name) AS name_md5 FROM customer")
def md5_rowkey(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalar.row_key(F.col("c_custkey"), F.col("c_mktsegment")).alias("row_key"), scalar.md5_hex(F.col("c_name")).alias("name_md5"))


@query("""
WITH h AS (SELECT c_custkey, list_reduce(list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (h * 31 + c) & 4294967295, 0::BIGINT) AS u FROM customer),
s AS (SELECT c_custkey, CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS h FROM h),
f AS (SELECT c_custkey, (h * 10) & 4294967295 AS u FROM s)
SELECT c_custkey, CAST(CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS INT) AS hash FROM f
""")
def udf_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalar.hash_code(F.col("c_name"), 10).alias("hash"))


@query("""
WITH h AS (SELECT c_custkey, list_reduce(list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (h * 31 + c) & 4294967295, 0::BIGINT) AS u FROM customer),
s AS (SELECT c_custkey, CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS h FROM h),
f AS (SELECT c_custkey, (h * 7) & 4294967295 AS u FROM s)
SELECT c_custkey, CAST(CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS INT) AS hash FROM f
""")
def udf_hash_sql(spark, sf_dir):
    """The registered function in SQL."""
    scalar.register(spark)
    table(spark, sf_dir, "customer").createOrReplaceTempView("tidemark_customer")
    return spark.sql("SELECT c_custkey, hash_code(c_name, 7) AS hash FROM tidemark_customer")


@query("""
SELECT user_id AS id, arg_max(value, (ts, event_id)) AS temperature, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id
""")
def upsert_latest(spark, sf_dir):
    """What an upsert by id leaves: the newest row of each key."""
    e = events(spark, sf_dir).select(F.col("user_id").alias("id"), F.col("value").alias("temperature"), "event_type", "ts", "event_id")
    return writers.last_per_key(e, ["id"], ["ts", "event_id"]).select("id", "temperature", "event_type")


@query("""
WITH b AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY ALL), a AS (SELECT user_id, count(*) AS n FROM events GROUP BY ALL)
SELECT false AS is_add, * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT true, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
""")
def retract_changelog(spark, sf_dir):
    """Withdrawals and additions between two states of a grouped count."""
    count = lambda df: df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    e = events(spark, sf_dir)
    return routing.retractions(count(e.where("event_id % 3 <> 0")), count(e), ["user_id"])


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS ts_date, strftime(ts, '%H') AS ts_hour, strftime(ts, '%M') AS ts_minute FROM events")
def partition_format(spark, sf_dir):
    return writers.time_partitioned(table(spark, sf_dir, "events"), "ts").select("event_id", "ts_date", "ts_hour", "ts_minute")


@query("""
SELECT event_id, CAST(epoch(date_trunc('day', ts) + INTERVAL '1 day') AS BIGINT) AS midnight, (epoch_ms(ts) // 86400000 + 1) * 86400000 AS midnight_ms,
       upper(event_type) AS upper_type, length(event_type) AS chars, trim('  ' || event_type || ' ') AS trimmed, substr(event_type, 1, 3) AS head,
       CAST(user_id // 7 AS BIGINT) AS whole, user_id / 7 AS part, abs(user_id - 50) AS distance, strftime(ts, '%d/%m/%Y:%H:%M:%S') AS log_time,
       CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS parsed
FROM events
""")
def scalar_functions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    log_time = F.date_format("ts", "dd/MM/yyyy:HH:mm:ss")
    return e.select(
        "event_id", F.unix_timestamp(scalar.next_midnight(F.col("ts")).cast("timestamp")).alias("midnight"), scalar.next_midnight_ms(F.unix_millis(F.col("ts").cast("timestamp"))).alias("midnight_ms"),
        F.upper("event_type").alias("upper_type"), F.length("event_type").cast("long").alias("chars"), F.trim(F.concat(F.lit("  "), "event_type", F.lit(" "))).alias("trimmed"), F.substring("event_type", 1, 3).alias("head"),
        F.expr("user_id div 7").alias("whole"), (F.col("user_id") / 7).alias("part"), F.abs(F.col("user_id") - 50).alias("distance"), log_time.alias("log_time"),
        F.unix_timestamp(F.to_timestamp(log_time, "dd/MM/yyyy:HH:mm:ss")).alias("parsed"),
    )


@query("SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, value AS temperature, event_id % 11 = 0 AS malformed FROM events")
def parse_csv_line(spark, sf_dir):
    """Lines "id, seconds, temperature", every eleventh with a field too many."""
    e = table(spark, sf_dir, "events")
    line = F.concat(F.col("event_id").cast("string"), F.lit(", "), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string"), F.lit(", "), F.col("value").cast("string"), F.when(F.col("event_id") % 11 == 0, ",x").otherwise(""))
    p = schemas.parse_delimited(e.select(line.alias("value")), schemas.SENSOR)
    return p.select(F.col("id").cast("long").alias("id"), "timestamp", "temperature", "malformed")


@query("""
SELECT '10.0.0.' || (user_id % 250) AS ip, user_id::VARCHAR AS user_id, CAST(floor(epoch(ts)) AS BIGINT) AS event_second, '/item/' || CAST(json_extract_string(props, '$.k') AS INT) AS url
FROM events WHERE event_type <> 'error' AND event_id % 5 <> 0
""")
def parse_access_log(spark, sf_dir):
    """Access log lines; GET requests of pages that are no static files."""
    e = events(spark, sf_dir)
    suffix = F.when(F.col("event_id") % 5 == 0, ".css").otherwise("")
    line = F.concat_ws(" ", F.concat(F.lit("10.0.0."), F.col("user_id") % 250), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "dd/MM/yyyy:HH:mm:ss"), F.lit("+0000"), F.when(F.col("event_type") == "error", "POST").otherwise("GET"), F.concat(F.lit("/item/"), "item", suffix))
    p = schemas.parse_access_log(e.select(line.alias("value")))
    return p.where((F.col("method") == "GET") & scalar.not_static(F.col("url"))).select("ip", "user_id", F.unix_timestamp("event_time").alias("event_second"), "url")


@query("""
SELECT o_orderkey AS meeting_id, 'code' || o_orderkey AS meeting_code, c_nationkey AS meetingroom_id, n_name AS meetingroom_name, r_name AS location_name
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 0) ON c_nationkey = n_nationkey
WHERE o_orderkey % 3 = 0
""")
def binlog_etl(spark, sf_dir):
    """Inserted meetings from change messages, left-joined to their rooms."""
    from .jobs import meetings

    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    value = {0: F.col("o_orderkey").cast("string"), 1: F.concat(F.lit("code"), "o_orderkey"), 7: F.col("c_nationkey").cast("string")}
    data = F.struct(*[value.get(i, F.lit("x")).alias(f"f{i:02d}") for i in range(16)])
    kind = F.when(F.col("o_orderkey") % 3 == 0, "INSERT").otherwise("UPDATE")
    messages = o.select(F.to_json(F.struct(F.lit("false").alias("isDdl"), F.lit("t_meeting_info").alias("table"), kind.alias("type"), F.array(data).alias("data"))).alias("value"))
    rooms = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey % 5 <> 0")
    rooms = rooms.select(F.col("n_nationkey").alias("meetingroom_id"), F.col("n_name").alias("meetingroom_name"), F.col("n_regionkey").alias("location_id"), F.col("r_name").alias("location_name"), F.lit(None).cast("string").alias("city"))
    return meetings(messages, rooms).select(F.col("meeting_id").cast("long").alias("meeting_id"), "meeting_code", "meetingroom_id", "meetingroom_name", "location_name")


@query("""
WITH m AS (SELECT c_custkey AS uid, CAST(c_nationkey AS INT) AS ad_id, c_name AS fullname, 'web' || c_custkey % 3 AS dn, 600000 * (c_custkey % 4) AS at FROM customer),
r AS (SELECT c_custkey AS uid, 'web' || c_custkey % 3 AS dn, 600000 * (c_custkey % 4) AS at, c_mktsegment AS regsource FROM customer WHERE c_custkey % 5 <> 0),
p AS (SELECT o_custkey AS uid, 'web' || o_custkey % 3 AS dn, 600000 * (o_orderkey % 4) AS at, printf('%.2f', o_totalprice) AS paymoney, o_orderkey % 6 AS siteid, o_orderkey % 7 AS vip_id FROM orders),
w AS (SELECT m.*, coalesce(r.regsource, '') AS regsource, coalesce(p.paymoney, '') AS paymoney, coalesce(p.siteid::VARCHAR, '') AS siteid, coalesce(p.vip_id::VARCHAR, '') AS vip_id
  FROM m LEFT JOIN r ON m.uid = r.uid AND m.dn = r.dn AND m.at = r.at LEFT JOIN p ON m.uid = p.uid AND m.dn = p.dn AND m.at = p.at)
SELECT substr(md5(uid::VARCHAR), 1, 5) || uid || dn AS row_key, CAST(uid AS BIGINT) AS uid, ad_id, fullname, dn, regsource, paymoney, siteid, vip_id, coalesce(n_name, '') AS adname,
       coalesce(s.r_name, '') AS sitename, coalesce('level ' || v.r_regionkey, '') AS vip_level
FROM w LEFT JOIN nation ON ad_id = n_nationkey LEFT JOIN region s ON siteid = s.r_regionkey::VARCHAR LEFT JOIN region v ON vip_id = v.r_regionkey::VARCHAR
""")
def warehouse_dim_member(spark, sf_dir):
    """The layered warehouse over whole tables as topic records: customers are members and their registrations, orders
    payments, nations ads, regions sites and VIP levels."""
    from .jobs import dim_member, route_topics

    read = lambda name: table(spark, sf_dir, name)
    text = lambda c: F.expr(c).cast("string")
    start = 1_563_753_600_000

    def topic(name: str, rows: DataFrame, **columns: Column) -> DataFrame:
        return rows.select(F.lit(name).alias("topic"), F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()])).alias("value"))

    each = lambda name: read(name).withColumn("dn", F.explode(F.array(*[F.lit(f"web{i}") for i in range(3)])))
    web, ms = F.concat(F.lit("web"), F.expr("c_custkey % 3")), text(f"{start} + 600000 * (c_custkey % 4)")
    customer = read("customer")
    records = [
        topic("basead", each("nation"), adid=text("n_nationkey"), adname=F.col("n_name"), dn=F.col("dn")),
        topic("basewebsite", each("region"), siteid=text("r_regionkey"), sitename=F.col("r_name"), dn=F.col("dn")),
        topic("membervip", each("region"), vip_id=text("r_regionkey"), vip_level=F.concat(F.lit("level "), "r_regionkey"), dn=F.col("dn")),
        topic("member", customer, uid=text("c_custkey"), ad_id=text("c_nationkey"), fullname=F.col("c_name"), register=ms, dn=web),
        topic("memberregtype", customer.where("c_custkey % 5 <> 0"), uid=text("c_custkey"), regsource=F.col("c_mktsegment"), createtime=ms, dn=web),
        topic(
            "memberpaymoney", read("orders"), uid=text("o_custkey"), paymoney=F.format_string("%.2f", "o_totalprice"), siteid=text("o_orderkey % 6"), vip_id=text("o_orderkey % 7"),
            createtime=text(f"{start} + 600000 * (o_orderkey % 4)"), dn=F.concat(F.lit("web"), F.expr("o_custkey % 3")),
        ),
    ]
    wide = dim_member(route_topics(reduce(DataFrame.unionByName, records)))
    return wide.select("row_key", F.col("uid").cast("long").alias("uid"), "ad_id", "fullname", "dn", "regsource", "paymoney", "siteid", "vip_id", "adname", "sitename", "vip_level")
