"""Push campaigns: row build with validation, reuse, counters, brief check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closetlake.functions.text import strip
from closetlake.functions.values import first_number, first_text, is_true, text, whitelisted
from closetlake.operators.accounts import INACTIVE_DAYS, SMALL_WARDROBE
from closetlake.schemas import conform

# Fixed values.
LANGUAGES = ["English", "Hinglish", "Hindi"]
AUDIENCES = ["all", "free", "subscribed", "inactive", "small_wardrobe", "daily_ready", "specific"]


def _filled(c) -> Column:
    return F.nullif(strip(text(c)), F.lit(""))


def campaign_rows(requests: DataFrame) -> DataFrame:
    """Campaigns as they would be stored, with the reason when one is refused."""
    festival = _filled("festival_id")
    personal = festival.isNotNull() & (F.col("delivery") == "personal_outfit")
    name = F.coalesce(_filled("festival_name"), festival)
    mode = F.coalesce(_filled("festival_mode"), F.lit("default"))
    audience = F.when(is_true("test"), "specific").otherwise(F.col("audience"))
    uid = F.when(is_true("test"), F.col("created_by")).when(F.col("audience") == "specific", _filled("specific_uid"))
    scheduled = F.when(~is_true("test"), F.col("scheduled_for"))
    rows = requests.select(
        "request_id", F.substring(strip(text("title")), 1, 55).alias("title"),
        F.substring(strip(text("body")), 1, 140).alias("body"), _filled("image_url").alias("image_url"),
        F.col("channel"),
        F.when(personal, "AIStylist").when(festival.isNotNull(), "Main").otherwise(F.col("destination")).alias("route"),
        F.when(festival.isNotNull(), "festival").otherwise("general").alias("campaign_kind"),
        F.when(personal, F.concat(F.lit("Create a "), name, F.lit(" "), mode, F.lit(" outfit using only my wardrobe."))).alias("preset_prompt"),
        audience.alias("audience"),
        F.when(F.col("audience") == "inactive", INACTIVE_DAYS).alias("inactive_days"),
        F.when(F.col("audience") == "small_wardrobe", SMALL_WARDROBE).alias("garment_threshold"),
        uid.alias("specific_uid"), scheduled.alias("scheduled_for"),
        (is_true("test") | is_true("bypass_frequency_cap")).alias("bypass_frequency_cap"),
        F.when(scheduled.isNotNull(), "scheduled").otherwise("queued").alias("status"),
    )
    reason = (
        F.when((F.col("title") == "") | (F.col("body") == ""), "title and body required")
        .when(~F.lower("image_url").startswith("https://"), "image must be https")
        .when((F.col("audience") == "specific") & F.col("specific_uid").isNull(), "user id required")
    )
    return rows.withColumn("reject_reason", reason)


def campaign_copies(campaigns: DataFrame) -> DataFrame:
    """Campaigns as forms to send again: schedule and cap bypass are cleared."""
    c = conform(campaigns, "campaigns")

    def chain(*names: str, default: str) -> Column:
        return F.coalesce(first_text(*names), F.lit(default))

    route = F.when(F.col("payload.route") == "AIStylist", "Main").otherwise(
        chain("payload.route", "destination", default="Main")
    )
    return c.select(
        "id", chain("payload.title", "title", default="").alias("title"),
        chain("payload.body", "body", default="").alias("body"),
        chain("payload.image_url", "image_url", default="").alias("image_url"),
        chain("payload.channel", "channel", default="announcements").alias("channel"),
        chain("audience_filter.type", "audience", default="all").alias("audience"), route.alias("destination"),
        chain("festival.campaign_id", "festival_campaign_id", default="").alias("festival_id"),
        chain("festival.festival_name", default="").alias("festival_name"),
        chain("festival.mode_id", default="").alias("festival_mode"),
        chain("festival.delivery", default="notification").alias("delivery"),
        F.lit(None).cast("timestamp").alias("scheduled_for"), F.lit(False).alias("bypass_frequency_cap"),
    )


def campaign_counters(campaigns: DataFrame) -> DataFrame:
    """Delivery counters with their fallbacks."""
    c = conform(campaigns, "campaigns")

    def number(*names: str) -> Column:
        return F.coalesce(first_number(*names), F.lit(0)).cast("bigint")

    return c.select(
        "id", F.coalesce(first_text("title", "payload.title"), F.lit("Untitled campaign")).alias("title"),
        F.coalesce(first_text("status"), F.lit("queued")).alias("status"),
        number("unique_targeted_users").alias("users"), number("device_targets", "targeted_devices").alias("devices"),
        number("sent").alias("sent"), number("failed").alias("failed"), number("opened").alias("opened"),
    )


def checked_briefs(requests: DataFrame) -> DataFrame:
    """Draft requests cleaned to what may be passed on, with a refusal reason."""
    brief = F.substring(strip(text("brief")), 1, 1200)

    def chosen(name: str, default: str) -> Column:
        return F.coalesce(first_text(name), F.lit(default))

    return requests.select(
        "request_id", brief.alias("brief"), whitelisted("language", LANGUAGES, "English").alias("language"),
        is_true("include_image").alias("include_image"), whitelisted("audience", AUDIENCES, "all").alias("audience"),
        F.substring(chosen("channel", "announcements"), 1, 60).alias("channel"),
        F.substring(chosen("destination", "Main"), 1, 80).alias("destination"),
        F.substring(strip(text("occasion")), 1, 120).alias("occasion"),
        F.when(F.length(brief) < 8, "brief too short").alias("reject_reason"),
    )
