"""Row shapes of the inputs, and parsers from text lines to them.

A parser returns the parsed columns and ``malformed`` for lines that don't fit; ``accepted`` and
``rejected`` split on it, so bad lines are never lost silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SENSOR = "id string, timestamp bigint, temperature double"
ORDER_EVENT = "order_id bigint, event_type string, tx_id string, event_time bigint"
RECEIPT_EVENT = "tx_id string, pay_channel string, event_time bigint"
LOGIN_EVENT = "user_id bigint, ip string, status string, event_time bigint"
AD_CLICK = "user_id bigint, ad_id bigint, province string, city string, timestamp bigint"
USER_BEHAVIOR = "user_id bigint, item_id bigint, category_id int, behavior string, timestamp bigint"
MARKETING = "user_id string, behavior string, channel string, timestamp bigint"
USER_WINDOW = "window_start timestamp, window_end timestamp, label string, detail string, size bigint"
USER_RANK = "window_end timestamp, size bigint"
MEETING_INFO = "meeting_id int, meeting_code string, address_id int, mstart_date string, mend_date string"
MEETING_ADDRESS = "meetingroom_id int, meetingroom_name string, location_id int, location_name string, city string"
MEETING = "meeting_id int, meeting_code string, meetingroom_id int, meetingroom_name string, location_name string, city string"
ACTIVITY_SKU = "id int, activity_id int, sku_id int"
TEMP_ORDER = "product_id string, order_id string, order_time timestamp"
TEMP_PRODUCT = "product_id string, product_name string, price decimal(10,2), update_time timestamp"
ACCESS_LOG = "ts bigint, userId bigint, eventType string, fromType string, columnType string, siteId bigint, grouponId bigint, partnerId bigint, merchandiseId bigint"
ENVELOPE = "topic string, value string"
# Warehouse topics: facts and dimensions, as their readers see them.
BASE_AD = "adid int, adname string, dn string"
BASE_WEBSITE = "siteid int, sitename string, siteurl string, delete string, createtime string, creator string, dn string"
MEMBER_VIP = "vip_id int, vip_level string, start_time string, end_time string, last_modify_time string, max_free string, min_free string, next_level string, operator string, dn string"
MEMBER = (
    "uid int, ad_id int, birthday string, email string, fullname string, iconurl string, lastlogin string, mailaddr string, memberlevel string, "
    "password string, paymoney string, phone string, qq string, register string, regupdatetime string, unitname string, userip string, zipcode string, dt string, dn string"
)
MEMBER_PAY = "uid int, paymoney string, siteid int, vip_id int, createtime string, dt string, dn string"
MEMBER_REGTYPE = "uid int, appkey string, appregurl string, bdp_uuid string, createtime string, isranreg string, regsource string, websiteid string, dt string, dn string"
DIM_MEMBER = (
    "uid ad_id birthday email fullname iconurl lastlogin mailaddr memberlevel password phone qq register regupdatetime unitname userip zipcode "
    "appkey appregurl bdp_uuid regtype_createtime isranreg regsource websiteid adname siteid sitename siteurl site_createtime paymoney vip_id "
    "vip_level vip_start_time vip_end_time last_modify_time max_free min_free next_level operator dn dt"
).split()


def fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(f.strip().split(" ", 1)) for f in schema.replace("decimal(10,2)", "decimal(10;2)").split(",")]


def parse_delimited(lines: DataFrame, schema: str, separator: str = ",", value: str = "value") -> DataFrame:
    """Lines split on ``separator``, trimmed and cast; a wrong number of fields or a failed cast is malformed."""
    parts = F.split(F.col(value), separator, -1)
    shape = [(name, kind.replace(";", ",")) for name, kind in fields(schema)]
    columns = [F.trim(F.get(parts, F.lit(i))).try_cast(kind).alias(name) for i, (name, kind) in enumerate(shape)]
    parsed = lines.select(F.col(value).alias("line"), (F.size(parts) != len(shape)).alias("bad_size"), *columns)
    bad = F.col("bad_size") | F.col("line").isNull()
    for name, kind in shape:
        if kind != "string":
            bad = bad | F.col(f"`{name}`").isNull()
    return parsed.withColumn("malformed", F.coalesce(bad, F.lit(True))).drop("bad_size")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where("not malformed").drop("malformed", "line")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where("malformed").select("line")


def parse_access_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """Space-separated access log: ip, user, event time, method and url are fields 0, 1, 3, 5 and 6."""
    p = F.split(F.col(value), " ")
    field = lambda i: F.get(p, F.lit(i))
    when = F.try_to_timestamp(field(3), F.lit("dd/MM/yyyy:HH:mm:ss"))
    return lines.select(field(0).alias("ip"), field(1).alias("user_id"), when.alias("event_time"), field(5).alias("method"), field(6).alias("url"))


def is_json_object(value: Column) -> Column:
    """Valid JSON whose top is an object."""
    return F.coalesce(F.try_parse_json(value).isNotNull() & F.trim(value).startswith("{"), F.lit(False))


def parse_json(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """JSON records to columns; what can't be parsed, and missing fields, are null. Values may be written as text."""
    shape = [(name, kind.replace(";", ",")) for name, kind in fields(schema)]
    record = F.from_json(F.col(value), ", ".join(f"`{name}` string" for name, _ in shape))
    return lines.select(record.alias("r")).select(*[F.col(f"r.`{name}`").try_cast(kind).alias(name) for name, kind in shape])


def parse_binlog(lines: DataFrame, table: str = "t_meeting_info", value: str = "value") -> DataFrame:
    """Inserted rows of one table from change messages: the ordered values 0, 1, 7, 13 and 14 of the first data object."""
    message = F.from_json(F.col(value), "isDdl string, table string, type string, data array<map<string,string>>")  # one pass
    wanted = lines.select(message.alias("m")).where((F.col("m.isDdl") == "false") & (F.col("m.table") == table) & (F.col("m.type") == "INSERT"))
    rows = wanted.select(F.map_values(F.get("m.data", F.lit(0))).alias("v"))
    item = lambda i: F.get("v", F.lit(i))
    return rows.select(
        item(0).try_cast("int").alias("meeting_id"), item(1).alias("meeting_code"), item(7).try_cast("int").alias("address_id"), item(13).alias("mstart_date"), item(14).alias("mend_date")
    )
