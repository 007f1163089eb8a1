"""User accounts: names, limits, rollup, listings, profile rows and segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closetlake.functions.text import coverage_text, list_text, pretty, strip
from closetlake.functions.values import as_instant, first_text, is_true, text
from closetlake.operators.common import left_all, newest_first, zero_filled
from closetlake.operators.paging import bucket_counts, page
from closetlake.operators.garments import labelled_rows
from closetlake.schemas import conform

USERS_PER_PAGE = 20
DEFAULT_DAILY_LIMIT = 5
INACTIVE_DAYS = 30
SMALL_WARDROBE = 10


def flat_users(users: DataFrame) -> DataFrame:
    """User documents with the subscription fields as columns."""
    u = conform(users, "users")
    return u.select(
        *[c for c in u.columns if c != "subscription"],
        F.col("subscription.plan").alias("plan"), F.col("subscription.last_coupon").alias("last_coupon"),
        F.col("subscription.premium_until").alias("premium_until"),
    )


def display_name(default: str) -> Column:
    return F.coalesce(first_text("full_name", "display_name"), F.lit(default))


def profile_line() -> Column:
    """The first two known of gender, city and profession."""
    known = F.filter(F.array("gender", "city", "profession"), lambda x: x != "")
    line = F.array_join(F.slice(known, 1, 2), " · ")
    return F.coalesce(F.nullif(line, F.lit("")), F.lit("Profile incomplete"))


def restricted() -> Column:
    return is_true("login_blocked") | is_true("account_blocked")


def premium(now) -> Column:
    running = F.col("premium_until") > as_instant(now)
    return F.coalesce((F.col("plan") == "premium") & running, F.lit(False))


def effective_limit(user_limit, global_limit) -> Column:
    """The user's own daily limit, else the global one (5 unless set, never below 0)."""
    shared = F.floor(F.coalesce(global_limit, F.lit(DEFAULT_DAILY_LIMIT)))
    return F.coalesce(F.col(user_limit), F.greatest(F.lit(0), shared)).cast("bigint")


def search_haystack() -> Column:
    """Name, e-mail and id as one text; what an index of users is built on."""
    return F.concat_ws(" ", display_name("Unnamed user"), text("email"), F.col("user_id").cast("string"))


def name_search(query: str) -> Column:
    """Case-insensitive text search over name, e-mail and id."""
    return F.contains(F.lower(search_haystack()), F.lower(strip(F.lit(query))))


def _instants(df: DataFrame, names: list[str]) -> DataFrame:
    known = [F.col(n).cast("timestamp") for n in names if n in df.columns]
    return df.select("user_id", F.coalesce(*known).alias("ts"))


# The first of these a row has tells when it was active.
ACTIVITY_CHAIN = ["ts", "created_at", "updated_at", "worn_at", "date"]


def user_activity(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per user of each named table and the latest instant over all, in one grouping."""
    parts = [_instants(t, ACTIVITY_CHAIN).withColumn("kind", F.lit(name)) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("user_id").agg(
        *[F.count_if(F.col("kind") == name).alias(name) for name in tables], F.max("ts").alias("seen"))


def user_rollup(users, items, looks, history, wear, quests, responses, logs) -> DataFrame:
    """Users with counts of what they own and did, and their last activity."""
    base = users.withColumn("own", F.coalesce(*[
        F.col(n).cast("timestamp") for n in ACTIVITY_CHAIN if n in users.columns
    ]))
    done = user_activity({
        "garments": items, "outfits": looks, "responses": responses, "analyses": history, "worn": wear, "quested": quests, "called": logs,
    })
    filled = zero_filled(base.join(done, "user_id", "left"), ["garments", "outfits", "responses", "analyses"])
    return (
        filled.withColumn("name", display_name("Unnamed user"))
        .withColumn("ai_actions", F.col("responses") + F.col("analyses"))
        .withColumn("last_activity", F.greatest("seen", "own"))
        .drop("responses", "analyses", "worn", "quested", "called", "seen", "own")
    )


def user_counts(users: DataFrame) -> DataFrame:
    """Users per day of joining; what the pages of the user list are found by, from users or their rollup."""
    return bucket_counts(users, newest_first("created_at"))


def users_page(rollup: DataFrame, number: int, counts: DataFrame | None = None) -> DataFrame:
    """One page of the user list, newest first, with the ``user_counts`` that are kept or counted now."""
    return page(rollup, [newest_first("created_at"), F.col("user_id")], number, USERS_PER_PAGE, counts)


def iso_day(c) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def export_rows(rollup: DataFrame) -> DataFrame:
    """The fourteen columns of the user export."""
    return rollup.select(
        F.col("user_id").cast("string").alias("UID"), F.col("name").alias("Name"), F.col("email").alias("Email"),
        F.col("gender").alias("Gender"), F.col("city").alias("City"), F.col("profession").alias("Profession"),
        F.coalesce(first_text("plan"), F.lit("free")).alias("Plan"), text("last_coupon").alias("Coupon used"),
        iso_day("premium_until").alias("Premium until"), iso_day("created_at").alias("Joined"),
        iso_day("last_activity").alias("Last activity"), F.col("garments").alias("Garments"),
        F.col("outfits").alias("Saved outfits"), F.col("ai_actions").alias("AI actions"),
    )


def _amount(name: str, unit: str) -> Column:
    shown = F.regexp_replace(F.col(name).cast("string"), r"\.0$", "")
    return F.when(F.col(name) != 0, F.concat(shown, F.lit(unit)))


def profile_rows(users: DataFrame) -> DataFrame:
    """Eleven profile and eleven preference attributes per user."""
    u = conform(users, "users")
    pref = "preferences."

    def shown(pairs, default):
        return [(n, F.coalesce(F.nullif(v, F.lit("")), F.lit(default))) for n, v in pairs]

    profile = [
        ("Name", first_text("full_name", "display_name")), ("Gender", F.col("gender")),
        ("Date of birth", F.col("date_of_birth")), ("Height", _amount("height", " cm")),
        ("Weight", _amount("weight", " kg")), ("Profession", F.col("profession")), ("City", F.col("city")),
        ("Body type", first_text("body_type_self_reported", "ai_analysis.body_type")),
        ("Skin tone", F.col("ai_analysis.skin_tone")), ("Hair color", F.col("ai_analysis.hair_color")),
        ("Profile completion", F.concat(F.col("profile_completion").cast("string"), F.lit("%"))),
    ]
    rules = F.col(pref + "coverage_rules")
    coverage = F.when(rules.isNotNull(), coverage_text(
        rules["sleeveless_allowed"], rules["shorts_allowed"], rules["fitted_allowed"]
    ))
    preferences = [
        ("Style direction", list_text(pref + "style_lean")), ("Favorite colors", list_text(pref + "favorite_colors")),
        ("Colors to avoid", list_text(pref + "avoid_colors")), ("Fit", pretty(pref + "fit_preference")),
        ("Priority", pretty(pref + "styling_priority")), ("Temperature", pretty(pref + "temp_sensitivity")),
        ("Environment", pretty(pref + "environment")), ("Commute", pretty(pref + "commute")),
        ("Footwear", pretty(pref + "footwear_comfort")), ("Hard exclusions", list_text(pref + "hard_exclusions")),
        ("Coverage", coverage),
    ]
    return labelled_rows(u, ["user_id"], shown(profile, "Not provided") + shown(preferences, "Not specified"))


def admin_rows(rollup: DataFrame) -> DataFrame:
    """Fourteen attributes of a user as an administrator sees them.

    Expects flat subscription columns.
    """
    u = rollup
    for name, kind in (
        ("height", "double"), ("body_type", "string"), ("skin_tone", "string"),
        ("ai_analysis", "struct<body_type string, skin_tone string, hair_color string>"),
    ):
        if name not in u.columns:
            u = u.withColumn(name, F.lit(None).cast(kind))
    pairs = [
        ("Gender", F.col("gender")), ("City", F.col("city")), ("Profession", F.col("profession")),
        ("Height", _amount("height", " cm")), ("Body type", first_text("body_type", "ai_analysis.body_type")),
        ("Skin tone", first_text("skin_tone", "ai_analysis.skin_tone")), ("Hair color", F.col("ai_analysis.hair_color")),
        ("Plan", F.coalesce(first_text("plan"), F.lit("free"))),
        ("Coupon used", F.coalesce(first_text("last_coupon"), F.lit("No coupon"))),
        ("Premium until", iso_day("premium_until")),
        ("Login", F.when(is_true("login_blocked"), "Blocked").otherwise("Enabled")),
        ("AI daily limit", F.coalesce(F.col("ai_daily_limit").cast("string"), F.lit("Global default"))),
        ("Joined", iso_day("created_at")), ("Last activity", iso_day("last_activity")),
    ]
    filled = [(n, F.coalesce(F.nullif(v, F.lit("")), F.lit("—"))) for n, v in pairs]
    return labelled_rows(u, ["user_id"], filled)


def pending_deletions(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Pending requests with the user's name and e-mail, or what stands in for them."""
    known = users.select("user_id", F.lit(True).alias("found"), "full_name", "display_name", "email")
    return requests.filter(F.col("status") == "pending").join(known, "user_id", "left").select(
        "user_id", "requested_at", display_name("Unknown user").alias("name"),
        F.coalesce(first_text("email"), F.col("user_id").cast("string")).alias("contact"),
    )


def segments(rollup: DataFrame, now, specific: DataFrame | None = None) -> DataFrame:
    """The audience segments each user belongs to, one row per membership."""
    quiet = as_instant(now) - F.expr(f"INTERVAL {INACTIVE_DAYS} DAYS")
    tests = [
        ("all", F.lit(True)), ("subscribed", premium(now)), ("free", ~premium(now)),
        ("inactive", F.coalesce(F.col("last_activity") < quiet, F.lit(True))),
        ("small_wardrobe", F.col("garments") < SMALL_WARDROBE),
    ]
    named = F.array_compact(F.array(*[F.when(test, name) for name, test in tests]))
    rows = rollup.select(F.explode(named).alias("segment"), "user_id")
    if specific is not None:
        chosen = rollup.select("user_id").join(specific.select("user_id"), "user_id", "left_semi")
        rows = rows.unionByName(chosen.select(F.lit("specific").alias("segment"), "user_id"))
    return rows


def segment_reach(memberships: DataFrame) -> DataFrame:
    return memberships.groupBy("segment").agg(F.count(F.lit(1)).alias("users"))
