"""Generators of sensor readings, marketing events and warehouse topics, all seeded and distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

CHANNELS = ("AppStore", "HuaweiStore", "XiaomiStore", "weibo", "wechat")
BEHAVIORS = ("CLICK", "DOWNLOAD", "UPDATE", "INSTALL", "UNINSTALL")


def _ticks(spark: SparkSession, n: int, rate: int | None) -> DataFrame:
    """Numbers 0..n-1, or an endless stream of ``rate`` a second."""
    if rate is None:
        return spark.range(n).select(F.col("id").alias("value"), F.timestamp_millis(F.lit(1_547_718_000_000) + F.col("id") * 500).alias("timestamp"))
    return spark.readStream.format("rate").option("rowsPerSecond", rate).load()


def sensors(spark: SparkSession, n: int = 100, sensors: int = 10, seed: int = 7, rate: int | None = None) -> DataFrame:
    """Readings of ten sensors: start 60 + 20 * N(0, 1), then a random walk with N(0, 1) steps.

    As a stream the walk can't be summed without state; readings are drawn around the start instead.
    """
    ticks = _ticks(spark, n, rate).crossJoin(F.broadcast(spark.range(1, sensors + 1).withColumnRenamed("id", "k")))  # ten rows
    start = 60 + 20 * F.randn(seed) if rate is None else 60 + 20 * F.sin(F.col("k") * 12.9898)
    d = ticks.select(F.concat(F.lit("sensor_"), "k").alias("id"), F.unix_timestamp("timestamp").alias("timestamp"), "value", F.when(F.col("value") == 0, start).otherwise(F.randn(seed + 1)).alias("step"))
    if rate is not None:
        return d.select("id", "timestamp", (60 + F.col("step")).alias("temperature"))
    walk = F.sum("step").over(W.partitionBy("id").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    return d.select("id", "timestamp", walk.alias("temperature"))


def marketing(spark: SparkSession, n: int = 1000, seed: int = 7, rate: int | None = None) -> DataFrame:
    """User, behavior, channel and milliseconds, behavior and channel uniform."""
    pick = lambda names, s: F.element_at(F.array(*[F.lit(x) for x in names]), (F.floor(F.rand(s) * len(names)) + 1).cast("int"))
    user = F.uuid() if rate is not None else F.md5(F.concat(F.lit(f"{seed}-"), F.col("value").cast("string")))
    return _ticks(spark, n, rate).select(user.alias("user_id"), pick(BEHAVIORS, seed).alias("behavior"), pick(CHANNELS, seed + 1).alias("channel"), F.unix_millis("timestamp").alias("timestamp"))


def random_date(first: str, last: str, seed: int):
    """Uniform timestamp between two dates."""
    a, b = F.unix_timestamp(F.lit(first).cast("timestamp")), F.unix_timestamp(F.lit(last).cast("timestamp"))
    return F.timestamp_seconds(a + F.floor(F.rand(seed) * (b - a)))


def warehouse_topics(spark: SparkSession, members: int = 1000, payments: int = 1400, ads: int = 10, vips: int = 5, sites: int = 5, seed: int = 7) -> DataFrame:
    """Records (topic, value) of all six topics; every field is text. Production sizes are 5,000,000 members
    and registrations and 7,000,000 payments."""
    domains = ("webA", "webB", "webC")
    dn = lambda s: F.element_at(F.array(*[F.lit(x) for x in domains]), (F.floor(F.rand(s) * 3) + 1).cast("int"))
    whole = lambda n, s: F.floor(F.rand(s) * n).cast("string")
    text = lambda c: F.col(c).cast("string")
    dt = F.lit("20190722")
    ms = (F.lit(1_563_753_600_000) + F.floor(F.rand(seed + 9) * 3_600_000)).cast("string")
    each_domain = F.explode(F.array(*[F.lit(x) for x in domains]))

    def topic(name: str, rows: DataFrame, *columns) -> DataFrame:
        return rows.select(F.lit(name).alias("topic"), F.to_json(F.struct(*columns)).alias("value"))

    ids = lambda n: spark.range(n)
    domains_of = lambda n: ids(n).select("id", each_domain.alias("dn"))
    out = topic("basead", domains_of(ads), text("id").alias("adid"), F.concat(F.lit("ad-"), "id").alias("adname"), "dn")
    out = out.union(topic("basewebsite", domains_of(sites), text("id").alias("siteid"), F.concat(F.lit("site-"), "id").alias("sitename"), F.concat(F.lit("www.site"), "id").alias("siteurl"), F.lit("0").alias("delete"), F.lit("2000-01-01").alias("createtime"), F.lit("admin").alias("creator"), "dn"))
    out = out.union(topic("membervip", domains_of(vips), text("id").alias("vip_id"), F.concat(F.lit("vip level "), "id").alias("vip_level"), F.lit("2015-01-01").alias("start_time"), F.lit("2016-01-01").alias("end_time"), F.lit("2015-01-01").alias("last_modify_time"), F.lit("0.0").alias("max_free"), F.lit("0.0").alias("min_free"), F.lit("none").alias("next_level"), F.lit("update").alias("operator"), "dn"))
    person = [text("id").alias("uid"), whole(ads, seed).alias("ad_id"), F.date_format(random_date("1960-01-01", "2000-01-01", seed + 1), "yyyy-MM-dd").alias("birthday"), F.concat(F.lit("user"), "id", F.lit("@example.org")).alias("email"), F.concat(F.lit("name"), "id").alias("fullname")]
    person += [F.lit("-").alias(c) for c in ("iconurl", "lastlogin", "mailaddr", "memberlevel", "password", "paymoney", "phone", "qq")]
    person += [ms.alias("register"), F.lit("-").alias("regupdatetime"), F.lit("-").alias("unitname"), F.lit("-").alias("userip"), F.lit("-").alias("zipcode"), dt.alias("dt"), dn(seed + 2).alias("dn")]
    out = out.union(topic("member", ids(members), *person))
    out = out.union(topic("memberpaymoney", ids(payments), whole(members, seed + 3).alias("uid"), F.format_string("%.2f", F.rand(seed + 4) * 600).alias("paymoney"), whole(sites, seed + 5).alias("siteid"), whole(vips, seed + 6).alias("vip_id"), ms.alias("createtime"), dt.alias("dt"), dn(seed + 7).alias("dn")))
    return out.union(topic("memberregtype", ids(members), text("id").alias("uid"), F.lit("-").alias("appkey"), F.lit("http://www.example.org").alias("appregurl"), F.md5(text("id")).alias("bdp_uuid"), ms.alias("createtime"), F.lit("-").alias("isranreg"), whole(4, seed + 8).alias("regsource"), F.lit("0").alias("websiteid"), dt.alias("dt"), dn(seed + 2).alias("dn")))
