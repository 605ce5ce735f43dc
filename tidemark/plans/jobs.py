"""Whole jobs: the layered warehouse and the change-message ETL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import schemas
from ..functions.scalar import row_key
from ..operators.joins import co_group_left, enrich
from ..operators.rules import route

FACTS = ("member", "memberpaymoney", "memberregtype")
DIMENSIONS = ("basead", "basewebsite", "membervip")


def route_topics(records: DataFrame) -> DataFrame:
    """First layer: records (topic, value) that are valid JSON, with ``route`` fact, dimension or main."""
    valid = records.where(schemas.is_json_object(F.col("value")))
    return route(valid, "route", fact=F.col("topic").isin(*FACTS), dimension=F.col("topic").isin(*DIMENSIONS))


def _topic(records: DataFrame, topic: str, schema: str) -> DataFrame:
    return schemas.parse_json(records.where(F.col("topic") == topic), schema)


def dimension_rows(records: DataFrame) -> dict[str, tuple[DataFrame, list[str]]]:
    """Second layer: the dimensions with their keys, to be upserted by (id, dn)."""
    kinds = {"basead": (schemas.BASE_AD, "adid"), "basewebsite": (schemas.BASE_WEBSITE, "siteid"), "membervip": (schemas.MEMBER_VIP, "vip_id")}
    return {t: (_topic(records, t, schema), [key, "dn"]) for t, (schema, key) in kinds.items()}


def dim_member(records: DataFrame, size: str = "10 minutes") -> DataFrame:
    """Third layer: members, left-joined in windows of their time to registrations and payments, and looked
    up in the three dimensions. A member without a partner keeps empty fields and comes once."""
    ms = lambda c: F.timestamp_millis(F.col(c).try_cast("long"))
    member = _topic(records, "member", schemas.MEMBER).drop("paymoney").withColumn("member_ts", ms("register"))
    regtype = _topic(records, "memberregtype", schemas.MEMBER_REGTYPE).withColumn("reg_ts", ms("createtime")).withColumnRenamed("createtime", "regtype_createtime").drop("dt")
    pay = _topic(records, "memberpaymoney", schemas.MEMBER_PAY).withColumn("pay_ts", ms("createtime")).drop("createtime", "dt")
    reg_fields = ["appkey", "appregurl", "bdp_uuid", "regtype_createtime", "isranreg", "regsource", "websiteid"]
    first = co_group_left(member.withColumn("again_ts", F.col("member_ts")), regtype, ["uid", "dn"], "member_ts", "reg_ts", size, reg_fields).drop("window")
    wide = co_group_left(first, pay, ["uid", "dn"], "again_ts", "pay_ts", size, ["paymoney", "siteid", "vip_id"]).drop("window")
    dims = {t: rows for t, (rows, _) in dimension_rows(records).items()}
    renamed = lambda df, **names: df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])
    site = renamed(dims["basewebsite"].select("siteid", "dn", "sitename", "siteurl", "createtime"), createtime="site_createtime")
    vip = renamed(dims["membervip"], start_time="vip_start_time", end_time="vip_end_time")
    wide = enrich(wide, dims["basead"], ["ad_id", "dn"], ["adid", "dn"], ["adname"])
    wide = enrich(wide, site, ["siteid", "dn"], ["siteid", "dn"], ["sitename", "siteurl", "site_createtime"])
    wide = enrich(wide, vip, ["vip_id", "dn"], ["vip_id", "dn"], ["vip_level", "vip_start_time", "vip_end_time", "last_modify_time", "max_free", "min_free", "next_level", "operator"])
    return wide.select(row_key(F.col("uid"), F.col("dn")).alias("row_key"), *schemas.DIM_MEMBER)


def meetings(messages: DataFrame, rooms: DataFrame) -> DataFrame:
    """Inserted meetings from change messages, left-joined to the room dimension."""
    info = schemas.parse_binlog(messages)
    return info.join(rooms, info["address_id"] == rooms["meetingroom_id"], "left").select("meeting_id", "meeting_code", F.coalesce("address_id", "meetingroom_id").alias("meetingroom_id"), "meetingroom_name", "location_name", "city")
