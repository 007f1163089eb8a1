"""Keyed updates, sources, campaigns, grounding and page checks."""

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closetlake.functions.taxonomy import with_taxonomy
from closetlake.functions.text import admin_flag, clean, clean_list, coverage_text, local_asset, pretty, strip, web_url
from closetlake.functions.values import whitelisted
from closetlake.operators import accounts, campaigns, grounding, looks, page_checks, platform, quests, writes
from closetlake.operators.garments import purchase_usable
from closetlake.schemas import schema
from closetlake.sources.collections import read_collection
from closetlake.sources import text_index
from closetlake.sources.wire import decode_documents
from verification.queries_admin import NAME
from verification.queries_garments import category_sql, slot_sql
from verification.registry import AS_OF, NOW, query
from verification.views import TABLES

D = "DATE '1998-06-30'"
N = "TIMESTAMP '2024-01-30 12:00:00'"
WORN_REQUESTS = "SELECT user_id + CASE WHEN outfit_id % 5 = 0 THEN 1 ELSE 0 END AS user_id, record_id FROM {v_wear} WHERE outfit_id % 2 = 0"


@query("collection_scan", "A1,A2", " UNION ALL ".join(f"SELECT '{n}' AS label, count(*) AS n FROM {{{n}}}" for n in TABLES)
       + " UNION ALL SELECT 'festival_campaigns', 0")
def _(t):
    frames = {
        n: read_collection(t.spark, f"{t.sf_dir}/{n}.parquet", getattr(t, n).schema) for n in TABLES
    }
    frames["festival_campaigns"] = read_collection(t.spark, f"{t.sf_dir}/festival_campaigns.parquet", schema("app_config"))
    return platform.labelled_counts(frames)


@query("wire_mixed_tags", "A6", """
SELECT CAST(item_id AS VARCHAR) AS id, CAST(times_worn AS VARCHAR) AS label,
  CASE item_id % 4 WHEN 0 THEN NULL ELSE CAST(times_worn AS DOUBLE) END AS paid,
  TIMESTAMP '1970-01-01 00:00:00' + INTERVAL 1 SECOND * times_worn AS seen, DATE '1998-03-04' AS bought,
  CASE item_id % 4 WHEN 0 THEN 'paid' ELSE '' END AS unread
FROM {v_items} WHERE times_worn IS NOT NULL""")
def _(t):
    """Columns whose values come under another type tag in every row, some of which cannot be read."""
    from pyspark.sql.types import StructType

    n, kind = F.col("times_worn"), F.col("item_id") % 4
    text = n.cast("string")
    moment = F.date_format(F.timestamp_seconds(n), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def tagged(**tags):
        return F.struct(*[v.alias(k) for k, v in tags.items()])

    fields = F.struct(
        tagged(stringValue=F.when(kind < 2, text), integerValue=F.when(kind >= 2, text)).alias("label"),
        tagged(stringValue=F.when(kind == 0, F.lit("much")).when(kind == 1, text), integerValue=F.when(kind == 2, text),
               doubleValue=F.when(kind == 3, n.cast("double"))).alias("paid"),
        tagged(stringValue=F.when(kind == 0, moment), integerValue=F.when(kind == 1, (n * 1000).cast("string")),
               timestampValue=F.when(kind >= 2, moment)).alias("seen"),
        tagged(stringValue=F.when(kind < 2, F.lit("1998-03-04")), timestampValue=F.when(kind >= 2, F.lit("1998-03-04T05:06:07Z"))).alias("bought"),
    )
    rows = t.v_items.filter("times_worn IS NOT NULL")
    raw = rows.select(F.to_json(F.struct(F.concat(F.lit("d/"), F.col("item_id").cast("string")).alias("name"), fields.alias("fields"))).alias("value"))
    wanted = StructType.fromDDL("label string, paid double, seen timestamp, bought date")
    return decode_documents(raw, wanted, rejects="unread").withColumn("unread", F.array_join("unread", ","))


@query("wire_documents", "A6", """
SELECT CAST(item_id AS VARCHAR) AS id, user_id, title, pattern, times_worn, purchase_price, favorite, created_at,
       array_to_string(string_split(title, ' '), '|') AS tags, brand AS maker, purchase_price AS paid
FROM {v_items}""")
def _(t):
    """Garments turned into wire documents and decoded again."""

    def value(name, c):
        return F.struct(c.alias(name))

    tags = F.transform(F.split("title", " "), lambda x: F.struct(x.alias("stringValue")))
    fields = F.struct(
        value("integerValue", F.col("user_id").cast("string")).alias("user_id"),
        value("stringValue", F.col("title")).alias("title"), value("stringValue", F.col("pattern")).alias("pattern"),
        value("integerValue", F.col("times_worn").cast("string")).alias("times_worn"),
        value("doubleValue", F.col("purchase_price")).alias("purchase_price"),
        value("booleanValue", F.col("favorite")).alias("favorite"),
        value("timestampValue", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("created_at"),
        value("arrayValue", F.struct(tags.alias("values"))).alias("tags"),
        value("mapValue", F.struct(F.struct(
            value("stringValue", F.col("brand")).alias("maker"),
            value("doubleValue", F.col("purchase_price")).alias("paid"),
        ).alias("fields"))).alias("origin"),
    )
    name = F.concat(F.lit("projects/p/databases/d/documents/wardrobe/"), F.col("item_id").cast("string"))
    raw = t.v_items.select(F.to_json(F.struct(name.alias("name"), fields.alias("fields"))).alias("value"))
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(
        "user_id bigint, title string, pattern string, times_worn bigint, purchase_price double, favorite boolean, "
        "created_at timestamp, tags array<string>, origin struct<maker string, paid double>"
    )
    rows = decode_documents(raw, wanted)
    return rows.withColumns({"tags": F.array_join("tags", "|"), "maker": F.col("origin.maker"), "paid": F.col("origin.paid")}).drop("origin")


@query("wire_nested", "A6", """
SELECT CAST(item_id AS VARCHAR) AS id,
  CASE item_id % 3 WHEN 0 THEN NULL WHEN 1 THEN CAST(times_worn AS VARCHAR) ELSE CAST(times_worn + 1 AS VARCHAR) END AS worn,
  CASE WHEN item_id % 5 = 0 THEN NULL ELSE '3|' || CASE WHEN item_id % 2 = 0 THEN '-' ELSE '4' END END AS sizes,
  CASE WHEN item_id % 7 = 0 THEN NULL ELSE title END AS label,
  array_to_string(list_filter([
    CASE WHEN item_id % 3 = 0 THEN 'use.worn' END, CASE WHEN item_id % 5 = 0 THEN 'sizes' WHEN item_id % 2 = 0 THEN 'sizes[1]' END,
    CASE WHEN item_id % 7 = 0 THEN 'label' END], lambda x: x IS NOT NULL), ',') AS unread,
  CASE WHEN item_id % 4 = 0 THEN '{{"brand":{{"stringValue":"' || brand || '"}},"use.note":{{"integerValue":"' || item_id || '"}}}}' ELSE '' END AS rest
FROM {v_items} WHERE times_worn IS NOT NULL""")
def _(t):
    """Garments whose records and lists hold values of other types, and fields nobody declared, in one garment of four."""
    from pyspark.sql.types import StructType

    n, i = F.col("times_worn"), F.col("item_id")

    def tagged(**tags):
        return F.struct(*[F.when(when, v).alias(k) if when is not None else v.alias(k) for k, (when, v) in tags.items()])

    worn = tagged(stringValue=(i % 3 == 0, F.lit("often")), integerValue=(i % 3 == 1, n.cast("string")), doubleValue=(i % 3 == 2, n + F.lit(1.0)))
    note = F.when(i % 4 == 0, tagged(integerValue=(None, i.cast("string"))))
    entries = F.array(tagged(integerValue=(None, F.lit("3")), stringValue=(F.lit(False), F.lit(""))), tagged(integerValue=(i % 2 == 1, F.lit("4")), stringValue=(i % 2 == 0, F.lit("L"))))
    fields = F.struct(
        F.struct(F.struct(F.struct(worn.alias("worn"), note.alias("note")).alias("fields")).alias("mapValue")).alias("use"),
        tagged(arrayValue=(i % 5 != 0, F.struct(entries.alias("values"))), stringValue=(i % 5 == 0, F.lit("3, 4"))).alias("sizes"),
        tagged(stringValue=(i % 7 != 0, F.col("title")), mapValue=(i % 7 == 0, F.struct(F.lit(1).alias("fields")))).alias("label"),
        F.when(i % 4 == 0, tagged(stringValue=(None, F.col("brand")))).alias("brand"),
    )
    raw = t.v_items.filter("times_worn IS NOT NULL").select(
        F.to_json(F.struct(F.concat(F.lit("d/"), i.cast("string")).alias("name"), fields.alias("fields"))).alias("value"))
    wanted = StructType.fromDDL("use struct<worn int>, sizes array<int>, label string")
    rows = decode_documents(raw, wanted, rejects="unread", rescue="rest")
    sizes = F.array_join(F.transform("sizes", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), "|")
    return rows.select(
        "id", F.col("use.worn").cast("string").alias("worn"), sizes.alias("sizes"), "label", F.array_join("unread", ",").alias("unread"),
        F.coalesce(F.to_json("rest"), F.lit("")).alias("rest"))


@query("plan_inserts", "A9", """
SELECT DISTINCT 'web_' || r.user_id || '_' || r.wear_date || '_' || r.look_id AS record_id, r.user_id, r.look_id AS outfit_id,
  r.wear_date, 'planned' AS status, 'General' AS occasion, 'web_planner' AS source, TIMESTAMP '2024-01-30 12:00:00' AS created_at
FROM {v_plan_requests} r JOIN {v_looks} l ON r.user_id = l.user_id AND r.look_id = l.look_id
WHERE EXISTS (SELECT 1 FROM {v_look_items} i WHERE i.user_id = r.user_id AND i.look_id = r.look_id)
  AND NOT EXISTS (SELECT 1 FROM {v_plans} p WHERE p.record_id = 'web_' || r.user_id || '_' || r.wear_date || '_' || r.look_id)""")
def _(t):
    return writes.new_plans(t.v_plan_requests, t.v_looks, t.v_look_items, t.v_plans, NOW)


@query("plan_insert_pieces", "A9", """
SELECT r.user_id, 'web_' || r.user_id || '_' || r.wear_date || '_' || r.look_id AS record_id, i.pos, i.item_id
FROM (SELECT DISTINCT user_id, look_id, wear_date FROM {v_plan_requests}) r JOIN {v_looks} l ON r.user_id = l.user_id AND r.look_id = l.look_id
JOIN {v_look_items} i ON i.user_id = r.user_id AND i.look_id = r.look_id
WHERE NOT EXISTS (SELECT 1 FROM {v_plans} p WHERE p.record_id = 'web_' || r.user_id || '_' || r.wear_date || '_' || r.look_id)""")
def _(t):
    plans = writes.new_plans(t.v_plan_requests, t.v_looks, t.v_look_items, t.v_plans, NOW)
    return writes.new_plan_items(plans, t.v_look_items)


@query("marked_worn", "A10", f"""
SELECT w.user_id, w.record_id, CASE WHEN r.record_id IS NOT NULL AND w.wear_date <= {D} THEN 'worn' ELSE w.status END AS status,
  CASE WHEN r.record_id IS NOT NULL AND w.wear_date <= {D} THEN {N} END AS worn_at
FROM {{v_wear}} w LEFT JOIN ({WORN_REQUESTS}) r ON w.user_id = r.user_id AND w.record_id = r.record_id""")
def _(t):
    asked = t.sql(WORN_REQUESTS)
    return writes.marked_worn(t.v_wear, asked, AS_OF, NOW).select("user_id", "record_id", "status", "worn_at")


@query("plans_after_removal", "A11", f"""
SELECT w.user_id, w.record_id FROM {{v_wear}} w
WHERE NOT EXISTS (SELECT 1 FROM ({WORN_REQUESTS}) r WHERE w.user_id = r.user_id AND w.record_id = r.record_id)""")
def _(t):
    return writes.without_plans(t.v_wear, t.sql(WORN_REQUESTS)).select("user_id", "record_id")


@query("looks_after_removal", "A11", """
SELECT user_id, look_id FROM {v_looks} WHERE NOT (look_id % 2 = 0 AND lookbook AND coalesce(source, '') = 'user_created')""")
def _(t):
    asked = t.sql("SELECT user_id, look_id FROM {v_looks} WHERE look_id % 2 = 0")
    return writes.without_looks(t.v_looks, asked).select("user_id", "look_id")


@query("look_inserts", "A12", """
SELECT user_id, look_id, 2 AS pieces, CASE WHEN look_id % 3 = 0 THEN 'Look ' || look_id ELSE 'My Lookbook outfit' END AS title,
  coalesce(source, 'Any occasion') AS occasion, 100 AS score, true AS lookbook, 'user_created' AS source
FROM {v_looks} WHERE look_id % 4 <> 0""")
def _(t):
    ids = F.when(F.expr("look_id % 4 = 0"), F.array("look_id")).otherwise(F.array("look_id", "user_id"))
    title = F.when(F.expr("look_id % 3 = 0"), F.concat(F.lit(" Look "), F.col("look_id").cast("string"))).otherwise(" ")
    asked = t.v_looks.select("user_id", "look_id", ids.alias("item_ids"), title.alias("title"), F.col("source").alias("occasion"))
    made = writes.new_looks(asked, NOW)
    return made.withColumn("pieces", F.size("item_ids")).drop("item_ids", "created_at")


COUPON_REQUESTS = """
SELECT c_custkey AS request_id,
  CASE WHEN c_custkey % 6 = 0 THEN 'a-!' WHEN c_custkey % 5 = 0 THEN 'supplier#' || lpad(CAST(c_custkey AS STRING), 9, '0')
       ELSE ' save ' || CAST(c_custkey % 400 AS STRING) || 'x!' END AS code,
  CASE c_custkey % 4 WHEN 0 THEN 'yearly' WHEN 1 THEN 'weekly' WHEN 2 THEN 'custom' END AS plan,
  CASE c_custkey % 7 WHEN 0 THEN 0.0 WHEN 1 THEN 2.5 WHEN 2 THEN 3651.0 ELSE CAST(c_custkey % 30 + 1 AS DOUBLE) END AS days,
  CASE WHEN c_custkey % 3 = 0 THEN 50.0 WHEN c_custkey % 3 = 1 THEN -1.0 ELSE 3000000000.0 END AS max_redemptions,
  CASE WHEN c_custkey % 22 = 0 THEN 3000000000.0 WHEN c_custkey % 2 = 0 THEN 10.0 WHEN c_custkey % 2 = 1 THEN 1.5 END AS expires_in_days,
  CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE c_mktsegment END AS campaign_label
FROM {customer}"""


@query("coupon_creation", "A13", f"""
WITH shaped AS (
  SELECT request_id, regexp_replace(upper(trim(code)), '[^A-Z0-9-]', '', 'g') AS code,
    CASE WHEN plan IN ('monthly', 'yearly', 'custom') THEN plan ELSE 'monthly' END AS plan, days,
    CASE WHEN max_redemptions > 0 THEN CAST(max_redemptions AS BIGINT) END AS max_redemptions,
    CASE WHEN expires_in_days = 10 THEN {N} + INTERVAL 10 DAY END AS expires_at, nullif(trim(campaign_label), '') AS campaign_label, expires_in_days
  FROM ({COUPON_REQUESTS})),
reasoned AS (SELECT *, CASE WHEN length(code) < 4 THEN 'code too short'
  WHEN NOT (days = floor(days) AND days BETWEEN 1 AND 3650) THEN 'days out of range' WHEN expires_in_days > 90000000 THEN 'expiry out of range' END AS bad FROM shaped)
SELECT request_id, code, plan, days, max_redemptions, expires_at, campaign_label, true AS active, CAST(0 AS BIGINT) AS redeemed_count, {N} AS created_at,
  CASE WHEN bad IS NOT NULL THEN bad
       WHEN code IN (SELECT regexp_replace(upper(code), '[^A-Z0-9-]', '', 'g') FROM {{v_coupons}})
         OR row_number() OVER (PARTITION BY code, bad ORDER BY request_id) > 1 THEN 'code exists' END AS reject_reason
FROM reasoned""")
def _(t):
    return writes.checked_coupons(t.sql(COUPON_REQUESTS), t.v_coupons, NOW)


COUPON_ACTIONS = """
SELECT code, 'toggle' AS action FROM {v_coupons} WHERE redeemed_count % 2 = 0
UNION ALL SELECT code, 'toggle' FROM {v_coupons} WHERE redeemed_count % 4 = 0
UNION ALL SELECT code, 'delete' FROM {v_coupons} WHERE redeemed_count % 5 = 0"""


@query("coupon_updates", "A14", """
SELECT code, CASE WHEN redeemed_count % 2 = 0 AND redeemed_count % 4 <> 0 THEN NOT active ELSE active END AS active
FROM {v_coupons} WHERE redeemed_count % 5 <> 0""")
def _(t):
    return writes.updated_coupons(t.v_coupons, t.sql(COUPON_ACTIONS)).select("code", "active")


@query("coupon_status", "B15,F13", f"""
SELECT code, CASE WHEN NOT active THEN 'Disabled' WHEN expires_at < {N} THEN 'Expired'
  WHEN max_redemptions > 0 AND redeemed_count >= max_redemptions THEN 'Used up' ELSE 'Active' END AS status FROM {{v_coupons}}""")
def _(t):
    return t.v_coupons.select("code", writes.coupon_status(NOW).alias("status")).orderBy("code")


CONFIG = "SELECT 'region' || CAST(r_regionkey AS STRING) AS id, false AS kill_switch, 7 AS default_daily_limit, r_name AS message, r_name AS note FROM {region}"
CONFIG_UPDATES = """
SELECT 'region' || CAST(n_regionkey + n_nationkey % 2 AS STRING) AS id, n_nationkey AS seq, n_nationkey % 3 = 0 AS kill_switch,
  CAST(n_nationkey * 700 AS DOUBLE) - 1000 + 0.5 AS default_daily_limit, CASE WHEN n_nationkey % 4 = 0 THEN ' ' ELSE n_name END AS message
FROM {nation}"""


@query("config_upserts", "A15", f"""
WITH valid AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM ({CONFIG_UPDATES})
  WHERE floor(default_daily_limit) BETWEEN 0 AND 10000)
SELECT coalesce(c.id, u.id) AS id, coalesce(u.kill_switch, c.kill_switch) AS kill_switch,
  CAST(coalesce(floor(u.default_daily_limit), c.default_daily_limit) AS INT) AS default_daily_limit,
  coalesce(CASE WHEN u.message = ' ' THEN 'AI features are temporarily unavailable. Please try again later.' ELSE u.message END, c.message) AS message, c.note
FROM ({CONFIG}) c FULL JOIN (SELECT * FROM valid WHERE rn = 1) u ON c.id = u.id""")
def _(t):
    return writes.merged_config(t.sql(CONFIG), t.sql(CONFIG_UPDATES))


SECURITY = """
SELECT user_id, user_id % 5 AS seq, user_id % 2 = 0 AS login_blocked,
  CASE user_id % 4 WHEN 0 THEN '' WHEN 1 THEN '12.7' WHEN 2 THEN 'many' ELSE '10001' END AS raw_limit FROM {v_users}
UNION ALL SELECT user_id, 9, user_id % 3 = 0, ' 4 ' FROM {v_users} WHERE user_id % 6 = 0"""


@query("user_security_updates", "A15", """
SELECT user_id, CASE WHEN user_id % 6 = 0 THEN true WHEN user_id % 4 IN (0, 1) THEN user_id % 2 = 0 ELSE login_blocked END AS login_blocked,
  CASE WHEN user_id % 6 = 0 THEN 4 WHEN user_id % 4 = 0 THEN NULL WHEN user_id % 4 = 1 THEN 12 ELSE CAST(ai_daily_limit AS INT) END AS ai_daily_limit
FROM {v_users}""")
def _(t):
    users = t.v_users.withColumn("ai_daily_limit", F.col("ai_daily_limit").cast("int"))
    return writes.secured_users(users, t.sql(SECURITY)).select("user_id", "login_blocked", "ai_daily_limit")


CALLS = """
SELECT log_id, user_id, feature, 'google' AS provider, model, CASE WHEN status = 'failure' THEN ' <b>no</b> ' || type || ' ' END AS error,
  ts AS started_at, ts + INTERVAL 2 SECOND AS finished_at FROM {v_api_logs}"""


@query("call_log_rows", "A16", """
SELECT log_id, user_id, feature, 'web_ai' AS type, CASE WHEN status IS DISTINCT FROM 'failure' THEN 'google' END AS provider,
  CASE WHEN status IS DISTINCT FROM 'failure' THEN model END AS model,
  CASE WHEN status IS DISTINCT FROM 'failure' THEN 'success' ELSE 'failure' END AS status, 2000 AS response_time,
  CASE WHEN status = 'failure' THEN 'bno/b ' || type END AS error_message, ts + INTERVAL 2 SECOND AS ts,
  CAST(ts + INTERVAL 2 SECOND AS DATE) AS log_date FROM {v_api_logs}""")
def _(t):
    return writes.call_log_rows(t.sql(CALLS))


OWNER_TABLES = {
    "v_users": "user_id", "v_items": "item_id", "v_looks": "look_id", "v_look_items": "item_id", "v_wear": "record_id", "v_quest": "submission_id", "v_api_logs": "log_id"}


@query("deletion_cascade", "A17", " UNION ALL ".join(
    f"SELECT '{n}' AS label, user_id, CAST({key} AS VARCHAR) AS row_key FROM {{{n}}} "
    "WHERE user_id NOT IN (SELECT user_id FROM {v_deletions} WHERE status = 'approved')"
    for n, key in OWNER_TABLES.items()))
def _(t):
    """The rows left in each table."""
    kept = writes.without_deleted_users({n: getattr(t, n) for n in OWNER_TABLES}, t.v_deletions)
    rows = [df.select(F.lit(n).alias("label"), "user_id", F.col(OWNER_TABLES[n]).cast("string").alias("row_key")) for n, df in kept.items()]
    return reduce(DataFrame.unionByName, rows)


REVIEWS = """
SELECT user_id, requested_day AS seq, CASE WHEN user_id % 4 = 0 THEN 'approve' WHEN user_id % 4 = 1 THEN 'later' ELSE 'reject' END AS action,
  user_id % 8 = 0 AS uploads_deleted FROM {v_deletions}
UNION ALL SELECT user_id, requested_day + 1, CASE WHEN user_id % 3 = 0 THEN 'approve' ELSE 'reject' END, true FROM {v_deletions}"""


@query("deletion_reviews", "A17,B12", f"""
WITH valid AS (SELECT user_id, CASE WHEN action = 'approve' THEN 'approved' ELSE 'rejected' END AS decided,
    row_number() OVER (PARTITION BY user_id ORDER BY seq) AS rn
  FROM ({REVIEWS}) WHERE action = 'reject' OR (action = 'approve' AND uploads_deleted))
SELECT d.user_id, CASE WHEN d.status = 'pending' AND v.decided IS NOT NULL THEN v.decided ELSE d.status END AS status, d.requested_day,
  CASE WHEN d.status = 'pending' AND v.decided IS NOT NULL THEN {N} END AS reviewed_at
FROM {{v_deletions}} d LEFT JOIN valid v ON v.user_id = d.user_id AND v.rn = 1""")
def _(t):
    return writes.reviewed_deletions(t.v_deletions, t.sql(REVIEWS), NOW)


CAMPAIGN_REQUESTS = """
SELECT doc_id AS request_id, text AS title, CASE WHEN doc_id % 12 = 0 THEN ' ' ELSE text END AS body,
  CASE doc_id % 4 WHEN 0 THEN 'HTTPS://img.example/' || CAST(doc_id AS STRING) WHEN 1 THEN 'http://img.example' WHEN 2 THEN ' ' END AS image_url,
  source AS channel, CASE doc_id % 5 WHEN 0 THEN 'specific' WHEN 1 THEN 'inactive' WHEN 2 THEN 'small_wardrobe' ELSE 'all' END AS audience,
  CASE WHEN doc_id % 2 = 0 THEN ' u' || CAST(doc_id AS STRING) END AS specific_uid, 'OutfitCalendar' AS destination,
  CASE WHEN doc_id % 3 = 0 THEN 'fest' || lang END AS festival_id, CASE WHEN doc_id % 9 = 0 THEN 'Feast' END AS festival_name,
  '' AS festival_mode, CASE WHEN doc_id % 6 = 0 THEN 'personal_outfit' ELSE 'notification' END AS delivery,
  CASE WHEN doc_id % 7 = 0 THEN TIMESTAMP '2024-02-01 09:00:00' END AS scheduled_for, doc_id % 11 = 0 AS bypass_frequency_cap,
  doc_id % 13 = 0 AS test, 'admin1' AS created_by
FROM {documents}"""
TRIM = r"regexp_replace({x}, '^[\s\x0b\xa0]+|[\s\x0b\xa0]+$', '', 'g')"


@query("campaign_rows", "B24", f"""
SELECT *, CASE WHEN title = '' OR body = '' THEN 'title and body required' WHEN image_url LIKE 'http:%' THEN 'image must be https'
  WHEN audience = 'specific' AND specific_uid IS NULL THEN 'user id required' END AS reject_reason
FROM (SELECT request_id, {TRIM.format(x='title')}[1:55] AS title, {TRIM.format(x='body')}[1:140] AS body, nullif(trim(image_url), '') AS image_url, channel,
  CASE WHEN festival_id IS NULL THEN destination WHEN delivery = 'personal_outfit' THEN 'AIStylist' ELSE 'Main' END AS route,
  CASE WHEN festival_id IS NULL THEN 'general' ELSE 'festival' END AS campaign_kind,
  CASE WHEN festival_id IS NOT NULL AND delivery = 'personal_outfit' THEN 'Create a ' || coalesce(festival_name, festival_id) || ' default outfit using only my wardrobe.' END AS preset_prompt,
  CASE WHEN test THEN 'specific' ELSE audience END AS audience, CASE WHEN audience = 'inactive' THEN 30 END AS inactive_days,
  CASE WHEN audience = 'small_wardrobe' THEN 10 END AS garment_threshold,
  CASE WHEN test THEN created_by WHEN audience = 'specific' THEN trim(specific_uid) END AS specific_uid,
  CASE WHEN NOT test THEN scheduled_for END AS scheduled_for, test OR bypass_frequency_cap AS bypass_frequency_cap,
  CASE WHEN NOT test AND scheduled_for IS NOT NULL THEN 'scheduled' ELSE 'queued' END AS status
  FROM ({CAMPAIGN_REQUESTS}))""")
def _(t):
    return campaigns.campaign_rows(t.sql(CAMPAIGN_REQUESTS))


BRIEFS = """
SELECT doc_id AS request_id, CASE WHEN doc_id % 8 = 0 THEN '  short ' ELSE text END AS brief,
  CASE doc_id % 4 WHEN 0 THEN 'Hindi' WHEN 1 THEN 'Hinglish' WHEN 2 THEN lang END AS language,
  CASE WHEN doc_id % 3 = 0 THEN true END AS include_image, CASE WHEN doc_id % 2 = 0 THEN 'free' ELSE source END AS audience,
  text AS channel, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS destination, text AS occasion
FROM {documents}"""


@query("campaign_briefs", "B23,B25", f"""
SELECT request_id, {TRIM.format(x='brief')}[1:1200] AS brief, CASE WHEN language IN ('English', 'Hinglish', 'Hindi') THEN language ELSE 'English' END AS language,
  coalesce(include_image, false) AS include_image, CASE WHEN audience = 'free' THEN 'free' ELSE 'all' END AS audience,
  coalesce(nullif(channel, ''), 'announcements')[1:60] AS channel, coalesce(nullif(destination, ''), 'Main')[1:80] AS destination,
  {TRIM.format(x='occasion')}[1:120] AS occasion,
  CASE WHEN length({TRIM.format(x='brief')}) < 8 THEN 'brief too short' END AS reject_reason FROM ({BRIEFS})""")
def _(t):
    return campaigns.checked_briefs(t.sql(BRIEFS))


STORED = """
SELECT event_id AS id, event_type AS title, CASE WHEN event_id % 2 = 0 THEN 'Sale' ELSE '' END AS p_title, props AS body,
  CASE WHEN event_id % 3 = 0 THEN 'text' END AS p_body, CASE WHEN event_id % 5 = 0 THEN 'https://a' END AS image_url,
  CASE event_id % 3 WHEN 0 THEN 'AIStylist' WHEN 1 THEN 'TripPacking' END AS p_route, CASE WHEN event_id % 4 = 0 THEN 'daily_outfit' END AS channel,
  CASE WHEN event_id % 2 = 0 THEN 'inactive' END AS f_type, CASE WHEN event_id % 3 = 0 THEN 'free' END AS audience,
  CASE WHEN event_id % 7 = 0 THEN 'OutfitCalendar' END AS destination, CASE WHEN event_id % 6 = 0 THEN 'diwali' END AS festival_campaign_id,
  CASE WHEN event_id % 4 = 1 THEN 'holi' END AS f_campaign, CASE WHEN event_id % 8 = 1 THEN 'personal_outfit' END AS f_delivery,
  CASE WHEN event_id % 3 <> 1 THEN 'sent' END AS status, event_id % 50 AS unique_targeted_users, event_id % 4 AS device_targets,
  event_id % 9 AS targeted_devices, event_id % 10 AS sent, CASE WHEN event_id % 2 = 0 THEN event_id % 3 END AS failed FROM {events}"""


def stored(t):
    return t.sql(STORED).select(
        "id", "title", "body", "image_url", "channel", "audience", "destination", "festival_campaign_id", "status",
        "unique_targeted_users", "device_targets", "targeted_devices", "sent", "failed",
        F.struct(F.col("p_title").alias("title"), F.col("p_body").alias("body"), F.lit(None).cast("string").alias("image_url"),
                 F.lit(None).cast("string").alias("channel"), F.col("p_route").alias("route")).alias("payload"),
        F.struct(F.col("f_type").alias("type")).alias("audience_filter"),
        F.struct(F.col("f_campaign").alias("campaign_id"), F.lit(None).cast("string").alias("festival_name"),
                 F.lit("").alias("mode_id"), F.col("f_delivery").alias("delivery")).alias("festival"),
    )


@query("campaign_copies", "B26", f"""
SELECT id, coalesce(nullif(p_title, ''), title) AS title, coalesce(p_body, body) AS body, coalesce(image_url, '') AS image_url,
  coalesce(channel, 'announcements') AS channel, coalesce(f_type, audience, 'all') AS audience,
  CASE WHEN p_route = 'AIStylist' THEN 'Main' ELSE coalesce(p_route, destination, 'Main') END AS destination,
  coalesce(f_campaign, festival_campaign_id, '') AS festival_id, '' AS festival_name, '' AS festival_mode,
  coalesce(f_delivery, 'notification') AS delivery, CAST(NULL AS TIMESTAMP) AS scheduled_for, false AS bypass_frequency_cap FROM ({STORED})""")
def _(t):
    return campaigns.campaign_copies(stored(t))


@query("campaign_counters", "D28,F13", f"""
SELECT id, title, coalesce(status, 'queued') AS status, unique_targeted_users AS users,
  CASE WHEN device_targets <> 0 THEN device_targets ELSE targeted_devices END AS devices, sent, coalesce(failed, 0) AS failed, 0 AS opened
FROM ({STORED})""")
def _(t):
    return campaigns.campaign_counters(stored(t))


MODEL_ROWS = "SELECT user_id, look_id AS result_id, min(item_id) AS a, max(item_id) AS b FROM {v_look_items} GROUP BY user_id, look_id"


def parsed(t):
    """Model output written from the looks, with fences, unknown ids and broken JSON."""
    a, b = F.col("a").cast("string"), F.col("b").cast("string")

    def match(item, score, reason):
        return F.struct(item.alias("wardrobeItemId"), score.cast("string").alias("score"), F.lit(reason).alias("reason"))

    def example(explanation, *ids):
        return F.struct(F.array(*ids).alias("itemIds"), F.lit(explanation).cast("string").alias("explanation"))

    body = F.to_json(F.struct(
        F.when(F.expr("result_id % 3 = 0"), "strong_buy").otherwise("maybe").alias("verdict"),
        F.concat(F.lit(" <i>sum</i> "), a).alias("summary"),
        F.array(match(a, F.expr("result_id % 130"), "<same>"), match(b, F.lit(80), "near"),
                match(F.concat(F.lit("x"), a), F.lit(99), "unknown")).alias("similarityMatches"),
        F.array(example(" <first> ", a, b, a), example("alone", a), example(None, b, F.lit("nope"), a)).alias("outfitExamples"),
        F.array(F.lit(" one "), F.lit("<>"), F.lit("two"), F.lit("3"), F.lit("4"), F.lit("5"), F.lit("6")).alias("reasons"),
    ))
    raw = F.when(F.expr("result_id % 11 = 0"), "no json").when(
        F.expr("result_id % 2 = 0"), F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    ).otherwise(body)
    return grounding.parsed_results(t.sql(MODEL_ROWS).select("user_id", "result_id", raw.alias("raw")))


def shown(t):
    """The garments a purchase check shows to the model."""
    return t.v_items.filter(purchase_usable())


MATCHES = f"""res AS ({MODEL_ROWS}),
own AS (SELECT user_id, item_id FROM {{v_items}} WHERE NOT coalesce(hidden_from_ai, false) AND coalesce(laundry_status, '') <> 'Laundry'),
m AS (SELECT user_id, result_id, 0 AS pos, a AS item_id, CAST(least(result_id % 130, 100) AS DOUBLE) AS score, 'same' AS reason FROM res
  UNION ALL SELECT user_id, result_id, 1, b, 80.0, 'near' FROM res),
good AS (SELECT m.* FROM m JOIN own USING (user_id, item_id) WHERE score >= 65 AND result_id % 11 <> 0)"""


@query("parsed_model_results", "H23", f"SELECT user_id, result_id, result_id % 11 <> 0 AS parsed FROM ({MODEL_ROWS})")
def _(t):
    return parsed(t).select("user_id", "result_id", "parsed")


@query("grounded_matches", "C15", f"""
WITH {MATCHES} SELECT user_id, result_id, CAST(item_id AS VARCHAR) AS item_id, score, reason,
  row_number() OVER (PARTITION BY user_id, result_id ORDER BY pos) AS rank FROM good""")
def _(t):
    return grounding.grounded_matches(parsed(t), shown(t))


WHOLE = f"""{MATCHES},
whole AS (SELECT r.user_id, r.result_id, r.a, r.b FROM res r JOIN own x ON x.user_id = r.user_id AND x.item_id = r.a
  JOIN own y ON y.user_id = r.user_id AND y.item_id = r.b WHERE r.a <> r.b AND r.result_id % 11 <> 0)"""


@query("grounded_examples", "C15", f"""
WITH {WHOLE}
SELECT user_id, result_id, 1 AS example_no, 'first' AS explanation, 0 AS pos, CAST(a AS VARCHAR) AS item_id FROM whole
UNION ALL SELECT user_id, result_id, 1, 'first', 1, CAST(b AS VARCHAR) FROM whole
UNION ALL SELECT user_id, result_id, 2, '', 0, CAST(b AS VARCHAR) FROM whole
UNION ALL SELECT user_id, result_id, 2, '', 2, CAST(a AS VARCHAR) FROM whole""")
def _(t):
    return grounding.grounded_examples(parsed(t), shown(t))


@query("sanitized_results", "C15", f"""
WITH {WHOLE}
SELECT r.user_id, r.result_id, CASE WHEN r.result_id % 3 = 0 THEN 'strong_buy' ELSE 'consider' END AS verdict,
  'isum/i ' || r.a AS summary, 'one|two|3|4|5' AS reasons, CASE WHEN w.a IS NULL THEN 0 ELSE 2 END AS possible_outfits,
  CASE WHEN w.a IS NULL THEN 0 ELSE 2 END AS compatible_pieces
FROM res r LEFT JOIN whole w USING (user_id, result_id) WHERE r.result_id % 11 <> 0""")
def _(t):
    return grounding.checked_results(parsed(t), shown(t)).withColumn("reasons", F.array_join("reasons", "|"))


@query("sanitized_results_of_examples", "C15", f"""
WITH {WHOLE}
SELECT r.user_id, r.result_id, CASE WHEN w.a IS NULL THEN 0 ELSE 2 END AS possible_outfits,
  CASE WHEN w.a IS NULL THEN 0 ELSE 2 END AS compatible_pieces
FROM res r LEFT JOIN whole w USING (user_id, result_id) WHERE r.result_id % 11 <> 0""")
def _(t):
    """Counts from examples that were grounded before."""
    p = parsed(t)
    rows = grounding.sanitized_results(p, grounding.grounded_examples(p, shown(t)))
    return rows.select("user_id", "result_id", "possible_outfits", "compatible_pieces")


def outfits(t):
    """Outfits of the model written from the looks: with unknown ids, only unknown ids, and broken JSON."""
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    ids = F.when(F.expr("result_id % 5 = 0"), F.array(F.lit("nope"))).otherwise(F.array(b, F.lit("nope"), a, b))
    body = F.to_json(F.struct(F.lit("Look").alias("title"), ids.alias("wardrobeItemIds")))
    raw = F.when(F.expr("result_id % 11 = 0"), F.lit('{"wardrobeItemIds": [')).otherwise(F.concat(F.lit("```json\n"), body, F.lit("```")))
    anchor = F.expr("CASE result_id % 3 WHEN 0 THEN CAST(a AS STRING) WHEN 1 THEN 'gone' ELSE '' END")
    return grounding.parsed_outfits(t.sql(MODEL_ROWS).select("user_id", "result_id", anchor.alias("anchor_item_id"), raw.alias("raw")))


OUTFITS = f"""res AS ({MODEL_ROWS}),
kept AS (SELECT r.user_id, r.result_id, r.b AS item_id, 0 AS pos, r.a = r.b AS first FROM res r WHERE r.result_id % 5 <> 0 AND r.result_id % 11 <> 0
  UNION ALL SELECT r.user_id, r.result_id, r.a, 2, true FROM res r WHERE r.result_id % 5 <> 0 AND r.result_id % 11 <> 0 AND r.a <> r.b),
good AS (SELECT k.* FROM kept k JOIN {{v_items}} i ON i.user_id = k.user_id AND i.item_id = k.item_id)"""


@query("grounded_outfits", "C14,H23", f"""
WITH {OUTFITS} SELECT user_id, result_id, pos, CAST(item_id AS VARCHAR) AS item_id, first AND result_id % 3 = 0 AS is_anchor FROM good""")
def _(t):
    return grounding.outfit_pieces(outfits(t), t.v_items)


@query("outfit_verdicts", "C14,H23", f"""
WITH {OUTFITS}
SELECT r.user_id, r.result_id, coalesce(g.n, 0) AS pieces, CASE WHEN r.result_id % 11 = 0 THEN 'not JSON'
  WHEN coalesce(g.n, 0) = 0 THEN 'no usable garments' WHEN r.result_id % 3 = 1 OR (r.result_id % 3 = 0 AND NOT g.has_first) THEN 'selected garment not kept' END AS reject_reason
FROM res r LEFT JOIN (SELECT user_id, result_id, count(*) AS n, bool_or(first) AS has_first FROM good GROUP BY ALL) g USING (user_id, result_id)""")
def _(t):
    rows = outfits(t)
    return grounding.outfit_verdicts(rows, grounding.outfit_pieces(rows, t.v_items))


@query("sanitized_garments", "H17,H18,H19", """
SELECT user_id, CAST(item_id AS VARCHAR) AS item_id, title, category_role, layer_role, standalone_outfit, favorite, tags,
  sub_category, fit FROM (
  SELECT user_id, item_id, title, coalesce(category_role, '') AS category_role, coalesce(layer_role, '') AS layer_role,
    standalone_outfit, favorite, coalesce(array_to_string(tags, '|'), '') AS tags, coalesce(sub_category, '') AS sub_category, '' AS fit
  FROM {v_garments} WHERE NOT hidden_from_ai)""")
def _(t):
    marked = t.v_garments.withColumns({
        "title": F.concat(F.lit(" <"), F.col("title"), F.lit("> ")),
        "tags": F.transform("tags", lambda x: F.concat(F.lit("<"), x, F.lit(" >"))),
    })
    rows = grounding.sanitized_garments(marked)
    return rows.select(
        "user_id", "item_id", "title", "category_role", "layer_role", "standalone_outfit", "favorite",
        F.array_join("tags", "|").alias("tags"), "sub_category", "fit",
    )


@query("sanitized_purchase_garments", "H19,B6", """
SELECT user_id, CAST(item_id AS VARCHAR) AS item_id, title, coalesce(category, '') AS category, coalesce(sub_category, '') AS sub_category,
  primary_color, coalesce(pattern, '') AS pattern, material, coalesce(array_to_string(tags, '|'), '') AS tags, laundry_status
FROM {v_garments} WHERE NOT hidden_from_ai AND laundry_status <> 'Laundry'""")
def _(t):
    return grounding.purchase_garments(t.v_garments).withColumn("tags", F.array_join("tags", "|"))


@query("sanitized_candidates", "H19", """
SELECT user_id, candidate_id, title, category, sub_category, primary_color, coalesce(pattern, '') AS pattern, material, '' AS brand
FROM {v_candidates}""")
def _(t):
    return grounding.sanitized_candidates(t.v_candidates)


@query("sanitized_profiles", "H19", """
SELECT user_id, coalesce(gender, '') AS gender, coalesce(profession, '') AS profession, '' AS body_type, '' AS style_lean FROM {v_accounts}""")
def _(t):
    rows = grounding.sanitized_profiles(t.v_accounts)
    return rows.select("user_id", "gender", "profession", "body_type", F.array_join("style_lean", "|").alias("style_lean"))


@query("preference_texts", "B18,H14,H15,H16", """
SELECT user_id, CASE WHEN city IS NULL THEN 'Not specified' ELSE city || ', Slim Fit' END AS style,
  CASE WHEN login_blocked THEN 'Sleeveless allowed' ELSE 'No sleeveless' END || ', '
  || CASE WHEN account_blocked THEN 'Shorts allowed' ELSE 'No shorts' END || ', No fitted' AS coverage,
  coalesce('Plan ' || upper(plan[1]) || plan[2:], 'Not specified') AS fit FROM {v_accounts}""")
def _(t):
    text = F.lit(None).cast("string")
    none = F.lit(None).cast("array<string>")
    style = F.when(F.col("city").isNotNull(), F.array(F.col("city"), F.lit("slim_fit")))
    users = t.v_accounts.withColumn("preferences", F.struct(
        style.alias("style_lean"), none.alias("favorite_colors"), none.alias("avoid_colors"), none.alias("hard_exclusions"),
        F.concat(F.lit("plan_"), F.col("plan")).alias("fit_preference"), text.alias("styling_priority"),
        text.alias("temp_sensitivity"), text.alias("environment"), text.alias("commute"), text.alias("footwear_comfort"),
        F.struct(F.col("login_blocked").alias("sleeveless_allowed"), F.col("account_blocked").alias("shorts_allowed"),
                 F.lit(None).cast("boolean").alias("fitted_allowed")).alias("coverage_rules"),
    ))
    names = {"Style direction": "style", "Coverage": "coverage", "Fit": "fit"}
    # Largest texts are found by sorting: the rows of the three labels are dealt by user before that, not sorted where they are made.
    rows = accounts.profile_rows(users).filter(F.col("label").isin(*names)).repartition("user_id")
    return rows.groupBy("user_id").agg(*[
        F.max(F.when(F.col("label") == label, F.col("value"))).alias(name) for label, name in names.items()
    ])


@query("cleaned_documents", "H17", rf"""
SELECT doc_id, {TRIM.format(x="regexp_replace(text, '[<>]', '', 'g')")}[1:160] AS short, {TRIM.format(x='text')} AS whole FROM {{documents}}""")
def _(t):
    return t.documents.select("doc_id", clean("text").alias("short"), strip("text").alias("whole"))


@query("safe_links", "H22,H24,B23", """
SELECT page_id, CASE page_id % 4 WHEN 3 THEN '' WHEN 2 THEN '' WHEN 1 THEN url
    ELSE regexp_replace(url, '^https?://([^/]*)', CASE WHEN page_id % 3 = 0 THEN 'http://Me:Pw@\\1' WHEN page_id % 3 = 1 THEN 'http://\\1/a' ELSE 'http://\\1:8080' END) END AS link,
  CASE page_id % 3 WHEN 0 THEN './assets/' || page_id || '.PNG' ELSE '' END AS asset, page_id % 5 = 0 AS admin,
  CASE WHEN page_id % 2 = 0 THEN 'yearly' ELSE 'monthly' END AS plan FROM {pages}""")
def _(t):
    key = F.col("page_id").cast("string")
    rows = t.pages.select(
        # Names kept in their case, steps to resolve, own and other ports.
        "page_id", F.expr(r"""CASE page_id % 4 WHEN 3 THEN 'javascript:x' WHEN 2 THEN 'not a url' WHEN 1 THEN url
          ELSE regexp_replace(url, '^https?://([^/]*)', CASE WHEN page_id % 3 = 0 THEN 'HTTP://Me:Pw@$1:80' WHEN page_id % 3 = 1 THEN 'HTTP://$1/a/x/.././b/%2E%2e' ELSE 'HTTP://$1:08080' END) END""").alias("link"),
        F.when(F.expr("page_id % 3 = 0"), F.concat(F.lit("./assets/"), key, F.lit(".PNG")))
        .otherwise(F.concat(F.lit("./assets/../"), key)).alias("asset"),
        F.expr("""CASE page_id % 5 WHEN 0 THEN '{"admin": true}' WHEN 1 THEN '{"admin": "true"}' WHEN 2 THEN '{bad'
                  WHEN 3 THEN '{"admin": false}' END""").alias("attributes"),
        F.when(F.expr("page_id % 2 = 0"), "yearly").otherwise("weekly").alias("plan"),
    )
    return rows.select(
        "page_id", web_url("link").alias("link"), local_asset("asset").alias("asset"), admin_flag("attributes").alias("admin"),
        whitelisted("plan", ["monthly", "yearly", "custom"], "monthly").alias("plan"),
    )


@query("page_head_checks", "K1,K2,K3,K4", """
SELECT page_id, html LIKE '%<link rel="canonical" href="' || url || '"%' AS canonical_ok,
  regexp_matches(html, '<meta name="robots" content="index,follow[^"\\n]*"') AS robots_ok,
  html LIKE '%property="og:image" content="https://img.example/social.png"%' AS og_image_ok,
  html LIKE '%name="twitter:image" content="https://img.example/social.png"%' AS twitter_image_ok,
  len(regexp_extract_all(html, '<h1\\b')) = 1 AS one_heading, page_id % 7 <> 0 AS json_ld_ok
FROM {v_pages}""")
def _(t):
    return page_checks.head_checks(t.v_pages, "url", "https://img.example/social.png")


@query("pages_with_forbidden_wording", "K5", """
SELECT page_id FROM {pages} WHERE regexp_matches(html, '(?i)(Cloudflare|Firestore|Firebase|API key|server function|custom claim|account UID|prompt hash|share)')""")
def _(t):
    return page_checks.forbidden_wording(t.pages, [*page_checks.FORBIDDEN, "share"])


FAQ_PAGES = """
SELECT page_id, html || '<details class="faq-item"><summary>Why <b>' || url || '</b>?</summary>a</details>'
  || CASE WHEN page_id % 3 <> 0 THEN '<details class="faq-item"><summary>How?</summary>b</details>' ELSE '' END
  || '<script type="application/ld+json">{{"@graph":[{{"@type":"WebPage"}},{{"@type":"FAQPage","mainEntity":[{{"name":"Why","acceptedAnswer":{{"text":"a"}}}},{{"name":"'
  || CASE WHEN page_id % 4 = 0 THEN 'Why' ELSE 'How' END || '","acceptedAnswer":{{"text":"' || CASE WHEN page_id % 5 = 0 THEN '' ELSE 'b' END
  || '"}}}}]}}]}}</script>' AS html
FROM {pages}"""


@query("faq_question_checks", "K6", """
SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 2 ELSE 1 END AS visible_questions, 2 AS listed_questions,
  page_id % 3 <> 0 AND page_id % 4 <> 0 AND page_id % 5 <> 0 AS questions_ok FROM {pages}""")
def _(t):
    return page_checks.question_checks(t.sql(FAQ_PAGES))


@query("pages_missing_from_sitemap", "K7", "SELECT page_id, url FROM {pages} WHERE url NOT IN (SELECT loc FROM {v_sitemap})")
def _(t):
    return page_checks.missing_from_sitemap(t.pages, t.v_sitemap)


@query("document_search", "B22", "SELECT doc_id, source AS \"group\", lower(text) LIKE '%the an%' AS visible FROM {documents}")
def _(t):
    return page_checks.document_search(t.documents, " The an ")


@query("document_search_groups", "B22", """
SELECT source AS "group", bool_or(lower(text) LIKE '%the an%') AS visible, count(*) FILTER (lower(text) LIKE '%the an%') AS shown
FROM {documents} GROUP BY source""")
def _(t):
    return page_checks.visible_groups(page_checks.document_search(t.documents, "the an"))


@query("document_search_empty", "B22", "SELECT NOT bool_or(lower(text) LIKE '%zzqqzz%') AS empty FROM {documents}")
def _(t):
    return page_checks.search_is_empty(page_checks.document_search(t.documents, "zzqqzz"))


@query("missing_look_garments", "M4", """
SELECT l.user_id, l.look_id, l.pos, l.item_id FROM {v_look_items} l
WHERE NOT EXISTS (SELECT 1 FROM {v_items} i WHERE i.user_id = l.user_id AND i.item_id = l.item_id)""")
def _(t):
    return looks.unknown_ids(t.v_look_items, t.v_items).select("user_id", "look_id", "pos", "item_id")


CHALLENGES = """
SELECT look_id AS challenge_id, CASE WHEN look_id % 3 = 0 THEN 'draft' ELSE 'published' END AS status,
  CAST(created_at AS DATE) AS start_date, CAST(created_at AS DATE) + 10 AS end_date FROM {v_looks}"""


@query("active_challenges", "M7", f"SELECT challenge_id FROM ({CHALLENGES}) WHERE status = 'published' AND {D} BETWEEN start_date AND end_date")
def _(t):
    return quests.active_challenges(t.sql(CHALLENGES), AS_OF).select("challenge_id")


@query("outfit_completeness", "M8", f"""
WITH tax AS (
  SELECT user_id, item_id, item_id % 2 = 0 AS needs, {slot_sql('words', zone="''", role="''", alone='false')} AS slot FROM (
    SELECT *, {category_sql()} AS norm_category, lower(concat_ws(' ', category, sub_category, title)) AS words FROM {{v_items}})),
facts AS (
  SELECT l.user_id, l.look_id, coalesce(bool_or(t.slot = 'bottom'), false) AS bottom, coalesce(bool_or(t.slot = 'hero'), false) AS hero,
    coalesce(bool_or(t.slot = 'top'), false) AS top, coalesce(bool_or(t.slot = 'layer' AND t.needs), false) AS base,
    count(*) > count(DISTINCT l.item_id) AS has_duplicate, count(*) > count(t.item_id) AS has_unknown
  FROM {{v_look_items}} l LEFT JOIN tax t ON l.user_id = t.user_id AND l.item_id = t.item_id GROUP BY l.user_id, l.look_id)
SELECT user_id, look_id, NOT hero AND NOT bottom AS missing_bottom, base AND NOT hero AND NOT top AS missing_base, has_duplicate, has_unknown,
  NOT (NOT hero AND NOT bottom) AND NOT (base AND NOT hero AND NOT top) AND NOT has_duplicate AND NOT has_unknown AS complete FROM facts""")
def _(t):
    items = with_taxonomy(t.v_items).withColumn("requires_base_layer", F.expr("item_id % 2 = 0"))
    return grounding.outfit_check(t.v_look_items, items)


@query("document_search_of_index", "B22", """
SELECT 'the an' AS query, doc_id FROM {documents} WHERE lower(text) LIKE '%the an%' UNION ALL
SELECT 'é', doc_id FROM {documents} WHERE lower(text) LIKE '%é%'""")
def _(t):
    """Candidates from postings; a query too short for them."""
    index = text_index.postings(t.documents, "doc_id", "text", t.documents.count())
    found = [text_index.search(t.documents, index, "doc_id", "text", q).select(F.lit(q.strip().lower()).alias("query"), "doc_id") for q in (" The AN ", "É")]
    return found[0].unionByName(found[1])


@query("user_search_of_index", "B11", f"""
SELECT user_id FROM {{v_accounts}} WHERE lower(concat_ws(' ', {NAME.format(d="'Unnamed user'")}, coalesce(email, ''),
  CAST(user_id AS VARCHAR))) LIKE '%machinery1%'""")
def _(t):
    users = t.v_accounts.withColumn("hay", accounts.search_haystack())
    index = text_index.postings(users, "user_id", "hay", users.count())
    return text_index.search(users, index, "user_id", "hay", "  MACHINERY1 ").select("user_id")
