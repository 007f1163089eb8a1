"""Keyed table updates.

Each takes a table and a table of requests and returns the rows to append or
the next state of the table; the caller writes the result. Requests that change
nothing are harmless, so a job that is run again gives the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closetlake.functions.text import clean, coupon_code, strip
from closetlake.functions.values import as_date, as_instant, first_text, is_true, number, whitelisted
from closetlake.operators.common import flag_first

# Fixed values of the service.
COUPON_PLANS = ["monthly", "yearly", "custom"]
MAX_COUPON_DAYS = 3650
# Instants end near the year 290,000.
MAX_EXPIRY_DAYS = 90_000_000
MAX_DAILY_LIMIT = 10_000
DEFAULT_MESSAGE = "AI features are temporarily unavailable. Please try again later."


def plan_key(user_id, wear_date, look_id) -> Column:
    return F.concat_ws("_", F.lit("web"), *[F.col(c).cast("string") for c in (user_id, wear_date, look_id)])


def new_plans(requests: DataFrame, looks: DataFrame, look_items: DataFrame, wear: DataFrame, now) -> DataFrame:
    """Plans to add: own looks with pieces, each key once, none that exists."""
    usable = look_items.select("user_id", "look_id")
    occasion = first_text("occasion") if "occasion" in looks.columns else F.lit(None).cast("string")
    known = looks.join(usable, ["user_id", "look_id"], "left_semi").select(
        "user_id", "look_id", F.coalesce(occasion, F.lit("General")).alias("occasion")
    )
    # Everything in a row follows from its key, so any of several equal requests will do.
    wanted = requests.select("user_id", "look_id", "wear_date").distinct().join(known, ["user_id", "look_id"])
    rows = wanted.select(
        plan_key("user_id", "wear_date", "look_id").alias("record_id"), "user_id",
        F.col("look_id").alias("outfit_id"), "wear_date", F.lit("planned").alias("status"), "occasion",
        F.lit("web_planner").alias("source"), as_instant(now).alias("created_at"),
    )
    return rows.join(wear.select("record_id"), "record_id", "left_anti")


def new_plan_items(plans: DataFrame, look_items: DataFrame) -> DataFrame:
    """The pieces of new plans, for the long table of worn pieces: those of the look, in its order."""
    pieces = look_items.select("user_id", F.col("look_id").alias("outfit_id"), "pos", "item_id")
    return plans.select("user_id", "record_id", "outfit_id").join(pieces, ["user_id", "outfit_id"]).select(
        "user_id", "record_id", "pos", "item_id")


def marked_worn(wear: DataFrame, requests: DataFrame, as_of, now) -> DataFrame:
    """Wear records with the requested ones set to worn.

    A request counts when it comes from the owner and the date is not ahead.
    """
    asked = requests.select("user_id", "record_id").distinct().withColumn("_asked", F.lit(True))
    joined = wear.join(asked, ["user_id", "record_id"], "left")
    ahead = F.coalesce(F.col("wear_date") > as_date(as_of), F.lit(False))
    change = is_true("_asked") & ~ahead
    before = F.col("worn_at") if "worn_at" in wear.columns else F.lit(None).cast("timestamp")
    return (
        joined.withColumn("status", F.when(change, "worn").otherwise(F.col("status")))
        .withColumn("worn_at", F.when(change, as_instant(now)).otherwise(before))
        .drop("_asked")
    )


def without_plans(wear: DataFrame, requests: DataFrame) -> DataFrame:
    """Wear records left after owners removed some of theirs."""
    return wear.join(requests.select("user_id", "record_id"), ["user_id", "record_id"], "left_anti")


def without_looks(looks: DataFrame, requests: DataFrame) -> DataFrame:
    """Looks left after removal; only own lookbook looks can be removed."""
    removable = is_true("lookbook") & (F.coalesce("source", F.lit("")) == "user_created")
    asked = requests.select("user_id", "look_id").distinct().withColumn("_asked", F.lit(True))
    joined = looks.join(asked, ["user_id", "look_id"], "left")
    return joined.filter(~(is_true("_asked") & removable)).drop("_asked")


def new_looks(requests: DataFrame, now) -> DataFrame:
    """Looks to add; a request needs at least two pieces."""
    def named(name: str, default: str) -> Column:
        return F.coalesce(F.nullif(strip(name), F.lit("")), F.lit(default))

    return requests.filter(F.size("item_ids") >= 2).select(
        "user_id", "look_id", "item_ids", named("title", "My Lookbook outfit").alias("title"),
        named("occasion", "Any occasion").alias("occasion"), F.lit(100).alias("score"),
        F.lit(True).alias("lookbook"), F.lit("user_created").alias("source"), as_instant(now).alias("created_at"),
    )


def _whole(name: str) -> Column:
    return F.col(name) == F.floor(name)


def checked_coupons(requests: DataFrame, coupons: DataFrame, now) -> DataFrame:
    """All coupon requests with the coupon they make or the reason they do not.

    Of several valid requests for one code the first (by ``request_id``) wins.
    """
    cap, days_left = F.col("max_redemptions"), F.col("expires_in_days")
    shaped = requests.select(
        "request_id", coupon_code("code").alias("code"),
        F.coalesce(whitelisted("plan", COUPON_PLANS, "monthly")).alias("plan"), F.col("days"),
        F.when(_whole("max_redemptions") & (cap > 0), cap.try_cast("bigint")).alias("max_redemptions"),
        F.when(
            _whole("expires_in_days") & days_left.between(1, MAX_EXPIRY_DAYS),
            as_instant(now) + F.make_dt_interval(days_left.try_cast("int")),
        ).alias("expires_at"),
        F.nullif(strip("campaign_label"), F.lit("")).alias("campaign_label"),
        F.lit(True).alias("active"), F.lit(0).cast("bigint").alias("redeemed_count"), as_instant(now).alias("created_at"),
        F.coalesce(days_left > MAX_EXPIRY_DAYS, F.lit(False)).alias("_too_far"),
    )
    good_days = _whole("days") & F.col("days").between(1, MAX_COUPON_DAYS)
    reasoned = shaped.withColumn(
        "reject_reason",
        F.when(F.length("code") < 4, "code too short").when(~F.coalesce(good_days, F.lit(False)), "days out of range")
        .when(F.col("_too_far"), "expiry out of range"),
    ).drop("_too_far")
    taken = coupons.select(coupon_code("code").alias("code")).distinct().withColumn("_taken", F.lit(True))
    open_, closed = reasoned.filter("reject_reason IS NULL"), reasoned.filter("reject_reason IS NOT NULL")
    ordered = flag_first(open_, "code", ["request_id"], "_first").join(taken, "code", "left")
    decided = ordered.withColumn(
        "reject_reason", F.when(is_true("_taken") | ~F.col("_first"), "code exists")
    ).drop("_first", "_taken")
    return decided.unionByName(closed)


def updated_coupons(coupons: DataFrame, requests: DataFrame) -> DataFrame:
    """Coupons after toggles and deletions; a missing flag counts as active."""
    asked = requests.groupBy("code").agg(
        F.count_if(F.col("action") == "toggle").alias("_toggles"), F.max(F.col("action") == "delete").alias("_delete")
    )
    joined = coupons.join(asked, "code", "left").filter(~is_true("_delete"))
    flipped = F.coalesce(F.col("_toggles") % 2 == 1, F.lit(False))
    now_active = F.coalesce("active", F.lit(True))
    return joined.withColumn("active", F.when(flipped, ~now_active).otherwise(F.col("active"))).drop("_toggles", "_delete")


def coupon_status(now) -> Column:
    expired = F.col("expires_at").cast("timestamp") < as_instant(now)
    cap, used = F.coalesce("max_redemptions", F.lit(0)), F.coalesce("redeemed_count", F.lit(0))
    return (
        F.when(~F.coalesce("active", F.lit(True)), "Disabled").when(expired, "Expired")
        .when((cap > 0) & (used >= cap), "Used up").otherwise("Active")
    )


def valid_limit(limit) -> Column:
    """Whole daily limit from 0 to 10000, else null."""
    whole = F.floor(limit)
    return F.when(whole.between(0, MAX_DAILY_LIMIT), whole.cast("int"))


def _latest(updates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    last = updates.groupBy(key).agg(F.max(F.struct("seq", *fields)).alias("u"))
    return last.select(key, *[F.col(f"u.{f}").alias(f"new_{f}") for f in fields], F.lit(True).alias("_new"))


def merged_config(config: DataFrame, updates: DataFrame) -> DataFrame:
    """Config after the last valid update of each entry; other fields stay."""
    valid = updates.withColumn("default_daily_limit", valid_limit(F.col("default_daily_limit"))).filter(
        F.col("default_daily_limit").isNotNull()
    ).withColumn("message", F.coalesce(F.nullif(strip("message"), F.lit("")), F.lit(DEFAULT_MESSAGE)))
    fields = ["kill_switch", "default_daily_limit", "message"]
    joined = config.join(_latest(valid, "id", fields), "id", "full")
    return joined.withColumns({f: F.coalesce(f"new_{f}", f) for f in fields}).drop(
        "_new", *[f"new_{f}" for f in fields]
    )


def secured_users(users: DataFrame, updates: DataFrame) -> DataFrame:
    """Users after the last valid change of login block and daily limit.

    A blank limit clears the user's own limit; a bad one voids the change.
    """
    raw = strip(F.coalesce("raw_limit", F.lit("")))
    limit = valid_limit(number("raw_limit"))
    valid = updates.withColumn("ai_daily_limit", F.when(raw != "", limit)).filter(
        (raw == "") | F.col("ai_daily_limit").isNotNull()
    )
    joined = users.join(_latest(valid, "user_id", ["login_blocked", "ai_daily_limit"]), "user_id", "left")
    changed = is_true("_new")
    return (
        joined.withColumn("login_blocked", F.when(changed, F.col("new_login_blocked")).otherwise(F.col("login_blocked")))
        .withColumn("ai_daily_limit", F.when(changed, F.col("new_ai_daily_limit")).otherwise(F.col("ai_daily_limit")))
        .drop("_new", "new_login_blocked", "new_ai_daily_limit")
    )


def call_log_rows(calls: DataFrame) -> DataFrame:
    """Log rows of finished calls: success keeps the model, failure the message."""
    ok = F.col("error").isNull()
    return calls.select(
        "log_id", "user_id", "feature", F.lit("web_ai").alias("type"),
        F.when(ok, F.col("provider")).alias("provider"), F.when(ok, F.col("model")).alias("model"),
        F.when(ok, "success").otherwise("failure").alias("status"),
        (F.unix_millis(F.col("finished_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))).alias("response_time"),
        F.when(~ok, clean("error", 180)).alias("error_message"),
        F.col("finished_at").alias("ts"), F.to_date("finished_at").alias("log_date"),
    )


def reviewed_deletions(requests: DataFrame, reviews: DataFrame, now) -> DataFrame:
    """Deletion requests after review (``user_id``, ``seq``, ``action``, ``uploads_deleted``).

    The first review that can take effect decides a pending request; decided ones
    stay. Approval takes effect only when the user's uploads are gone.
    """
    approved = (F.col("action") == "approve") & is_true("uploads_deleted")
    decided = F.when(approved, "approved").when(F.col("action") == "reject", "rejected")
    valid = reviews.withColumn("_decided", decided).filter(F.col("_decided").isNotNull())
    first = valid.groupBy("user_id").agg(F.min(F.struct("seq", "_decided")).alias("_first"))
    joined = requests.join(first, "user_id", "left")
    change = (F.col("status") == "pending") & F.col("_first").isNotNull()
    before = F.col("reviewed_at") if "reviewed_at" in requests.columns else F.lit(None).cast("timestamp")
    return (
        joined.withColumn("reviewed_at", F.when(change, as_instant(now)).otherwise(before))
        .withColumn("status", F.when(change, F.col("_first._decided")).otherwise(F.col("status"))).drop("_first")
    )


#: Deleted users that are broadcast, 8 to 40 bytes each; beyond, a filter of their hashes is, of so many 64-bit words.
MOST_BROADCAST, FILTER_WORDS = 1_000_000, 1 << 17


def _filter_bits(user_id) -> tuple[Column, Column]:
    """The word of a user in the filter, and the two bits of it that the user sets."""
    h = F.xxhash64(F.col(user_id).cast("string"))
    one = F.lit(1).cast("bigint")
    bit = lambda by: F.call_function("shiftleft", one, F.shiftrightunsigned(h, by).bitwiseAND(63).cast("int"))
    return F.shiftrightunsigned(h, 12).bitwiseAND(FILTER_WORDS - 1).cast("int"), bit(0).bitwiseOR(bit(6))


def user_filter(users: DataFrame) -> DataFrame:
    """One row, ``_filter``: a Bloom filter of the users in ``FILTER_WORDS`` words (1 MB)."""
    word, bits = _filter_bits("user_id")
    words = users.select(word.alias("word"), bits.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    every = users.sparkSession.range(0, FILTER_WORDS, 1, 1).select(F.col("id").cast("int").alias("word")).join(words, "word", "left")
    held = every.agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")))).alias("held"))
    return held.select(F.col("held.bits").alias("_filter"))


def without_deleted_users(tables: dict[str, DataFrame], requests: DataFrame) -> dict[str, DataFrame]:
    """Every owner table without the rows of users whose deletion was approved; rows without user stay.

    The approved users are counted here. A set of bounded size is broadcast and nothing is shuffled. Of a larger one a Bloom filter
    is: rows that it says stay, nearly all, are passed on as they are, and only the others are shuffled to meet the exact set.
    """
    gone = requests.filter(F.col("status") == "approved").select("user_id").distinct()
    if gone.count() <= MOST_BROADCAST:
        return {name: df.join(F.broadcast(gone), "user_id", "left_anti") for name, df in tables.items()}
    bits = F.broadcast(user_filter(gone))
    word, wanted = _filter_bits("user_id")
    maybe = F.coalesce(F.get("_filter", word).bitwiseAND(wanted) == wanted, F.lit(False))
    out = {}
    for name, df in tables.items():
        tagged = df.crossJoin(bits)  # one row
        stay, check = tagged.filter(~maybe).drop("_filter"), tagged.filter(maybe).drop("_filter")
        out[name] = stay.unionByName(check.join(gone, "user_id", "left_anti"))
    return out
