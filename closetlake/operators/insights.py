"""Per-user dashboard figures and the outfit calendar."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closetlake.functions.calendar import leading_blanks, month_days, month_start
from closetlake.functions.values import as_date, exact_sum, first_text, is_true, optional, points
from closetlake.operators.common import first_per_key, left_all, maybe_among, top_k, zero_filled
from closetlake.operators.garments import in_lookbook
from closetlake.operators.looks import record_previews

HISTORY_LIMIT = 30
DAY_THUMBNAILS = 2
CARD_PIECES = 4
HOME_PIECES = 3


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("user_id").agg(F.count(F.lit(1)).alias(name))


def upcoming(as_of) -> Column:
    """Plans for today or later."""
    return (F.col("status") == "planned") & (F.col("wear_date") >= as_date(as_of))


def home_stats(users, items, looks, wear, quests, as_of) -> DataFrame:
    """The six figures of the home panel; lookbook counts garments and looks."""
    closet = items.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("garments"), F.count_if(is_true("favorite")).alias("favorites"),
        F.count_if(in_lookbook()).alias("lookbook_items"),
    )
    worn = wear.groupBy("user_id").agg(
        F.count_if(upcoming(as_of)).alias("planned"), F.count_if(F.col("status") == "worn").alias("wears")
    )
    earned = quests.groupBy("user_id").agg(F.sum(points("points_earned", "score_total")).alias("points"))
    joined = left_all(users.select("user_id"), [closet, _count(looks, "looks"), worn, earned])
    filled = zero_filled(joined, ["garments", "favorites", "lookbook_items", "looks", "planned", "wears", "points"])
    return filled.withColumn("lookbook", F.col("lookbook_items") + F.col("looks")).drop("lookbook_items", "looks")


def insight_summary(users, items, wear) -> DataFrame:
    """Tracked value, garment wears, worn outfits and planned looks."""
    price = F.col("purchase_price")
    closet = items.groupBy("user_id").agg(
        exact_sum(F.when(price > 0, price)).alias("tracked_value"),
        F.sum(F.coalesce("times_worn", F.lit(0))).alias("garment_wears"),
    )
    worn = wear.groupBy("user_id").agg(
        F.count_if(F.col("status") == "worn").alias("worn_outfits"),
        F.count_if(F.col("status") == "planned").alias("planned_looks"),
    )
    joined = left_all(users.select("user_id"), [closet, worn])
    return zero_filled(joined, ["tracked_value", "garment_wears", "worn_outfits", "planned_looks"])


def wear_value(items: DataFrame) -> DataFrame:
    """Average price per recorded wear over garments with both, and never-worn priced ones."""
    both = (F.col("purchase_price") > 0) & (F.col("times_worn") > 0)
    idle = (F.col("purchase_price") > 0) & (F.coalesce("times_worn", F.lit(0)) == 0)
    summed = items.groupBy("user_id").agg(
        exact_sum(F.when(both, F.col("purchase_price"))).alias("value"),
        F.sum(F.when(both, F.col("times_worn"))).alias("wears"),
        F.count_if(idle).alias("never_worn_priced"),
    )
    return summed.select(
        "user_id", (F.col("value") / F.col("wears")).alias("average_cost_per_wear"), "never_worn_priced"
    )


def wear_extremes(items: DataFrame, count: int) -> DataFrame:
    """The most and the least worn garments of each user."""
    worn = items.select("user_id", "item_id", F.coalesce("times_worn", F.lit(0)).alias("times_worn"))
    most = top_k(worn, ["user_id"], [F.col("times_worn").desc(), F.col("item_id")], count)
    least = top_k(worn, ["user_id"], [F.col("times_worn"), F.col("item_id")], count)
    return most.withColumn("list", F.lit("most_worn")).unionByName(least.withColumn("list", F.lit("least_worn")))


def home_cards(users, items, wear, history, as_of) -> DataFrame:
    """Underused and clean garments, saved analyses and the next planned look."""
    closet = items.groupBy("user_id").agg(
        F.count_if(F.coalesce("times_worn", F.lit(0)) == 0).alias("underused"),
        F.count_if(F.col("laundry_status") == "Clean").alias("clean"),
    )
    joined = left_all(
        users.select("user_id"), [closet, _count(history, "analyses"), next_plan(wear, as_of)]
    )
    return zero_filled(joined, ["underused", "clean", "analyses"])


def next_plan(wear: DataFrame, as_of) -> DataFrame:
    """The earliest upcoming plan of each user."""
    first = first_per_key(
        wear.filter(upcoming(as_of)), ["user_id"], [F.col("wear_date"), F.col("record_id")], ["record_id", "wear_date"]
    )
    return first.select("user_id", F.col("record_id").alias("next_record_id"), F.col("wear_date").alias("next_date"))


def wear_history(wear: DataFrame) -> DataFrame:
    """The latest thirty wear records of each user."""
    order = [F.col("wear_date").desc_nulls_last(), F.col("record_id")]
    return top_k(wear, ["user_id"], order, HISTORY_LIMIT).select("user_id", "rank", "record_id", "wear_date", "status")


def month_plan_count(wear: DataFrame) -> DataFrame:
    """Distinct planned dates per user and month."""
    return (
        wear.filter(F.col("status") == "planned")
        .groupBy("user_id", month_start("wear_date").alias("month"))
        .agg(F.count_distinct("wear_date").alias("planned_days"))
    )


def records_per_day(wear: DataFrame) -> DataFrame:
    return wear.groupBy("user_id", "wear_date").agg(F.count(F.lit(1)).alias("records"))


def calendar_grid(users: DataFrame, wear: DataFrame, month) -> DataFrame:
    """All days of a month for each user with grid cell and record count.

    Cell 0 is the Sunday of the first row; the blanks before day 1 have no row.
    """
    shown = as_date(month)
    days = users.select("user_id", F.explode(month_days(shown)).alias("wear_date"))
    inside = wear.filter(F.col("wear_date").between(month_start(shown), F.last_day(shown)))
    return (
        days.join(records_per_day(inside), ["user_id", "wear_date"], "left")
        .select(
            "user_id", F.col("wear_date").alias("day"),
            (leading_blanks(shown) + F.dayofmonth("wear_date") - 1).alias("cell"),
            F.coalesce("records", F.lit(0)).alias("records"),
        )
    )


def day_thumbnails(wear: DataFrame, wear_items: DataFrame, items: DataFrame, month) -> DataFrame:
    """Up to two garments per calendar day.

    The first two distinct ids of the day are taken before ownership is looked
    at, so a day can show fewer garments than its user owns.
    """
    shown = as_date(month)
    inside = wear.filter(F.col("wear_date").between(month_start(shown), F.last_day(shown)))
    pieces = inside.select("user_id", "record_id", "wear_date").join(wear_items, ["user_id", "record_id"])
    seen = pieces.groupBy("user_id", "wear_date", "item_id").agg(F.min(F.struct("record_id", "pos")).alias("first_seen"))
    two = top_k(seen, ["user_id", "wear_date"], [F.col("first_seen"), F.col("item_id")], DAY_THUMBNAILS, "thumb_no")
    return two.join(items.select("user_id", "item_id", "title"), ["user_id", "item_id"]).select(
        "user_id", F.col("wear_date").alias("day"), "thumb_no", "item_id", "title"
    )


def selected_day_cards(
    selected: DataFrame, wear: DataFrame, wear_items: DataFrame, look_items: DataFrame, items: DataFrame, as_of
) -> DataFrame:
    """A card for each wear record of the day its user has selected (``selected``: user_id, wear_date).

    ``preview`` holds the first four owned pieces, null when none is owned. The
    records of the selected days, some of all, are found once and kept on the
    executors' disks; a filter of their ids cuts the pieces before they are shuffled.
    """
    days = selected.select("user_id", "wear_date").distinct()
    used = ["user_id", "record_id", "outfit_id", "wear_date", "status", "outfit_title", "occasion", "notes"]
    records = wear.join(days, ["user_id", "wear_date"], "left_semi").select(*[c for c in used if c in wear.columns])
    records = records.localCheckpoint(storageLevel=StorageLevel.DISK_ONLY)
    status = F.coalesce(first_text("status"), F.lit("planned"))
    cards = records.select(
        "user_id", "record_id", "wear_date", status.alias("status"),
        F.coalesce(first_text(optional(wear, "outfit_title"), optional(wear, "occasion")), F.lit("Planned look")).alias("title"),
        F.coalesce(first_text(optional(wear, "occasion")), F.lit("General")).alias("occasion"),
        optional(wear, "notes").alias("notes"),
        ((status != "worn") & (F.col("wear_date") <= as_date(as_of))).alias("can_mark_worn"),
    )
    own = maybe_among(wear_items, "record_id", records, "record_id")
    saved = maybe_among(look_items, "look_id", records, "outfit_id")
    previews = record_previews(records, own, saved, items, CARD_PIECES)
    return cards.join(previews, ["user_id", "record_id"], "left")


def today_cards(users: DataFrame, today: DataFrame, today_items: DataFrame, look_items: DataFrame, items: DataFrame) -> DataFrame:
    """Title and first three owned pieces of each user's outfit of the day.

    ``today`` holds at most one row per user (user_id, outfit_id and titles) and
    ``today_items`` its own pieces (user_id, pos, item_id).
    """
    one = F.lit("today").alias("record_id")
    previews = record_previews(
        today.select("user_id", "outfit_id", one), today_items.select("user_id", "pos", "item_id", one), look_items, items,
        HOME_PIECES,
    ).drop("record_id")
    titled = today.select("user_id", first_text(optional(today, "outfit_title"), optional(today, "title")).alias("title"))
    joined = left_all(users.select("user_id"), [titled, previews])
    return joined.withColumn("title", F.coalesce("title", F.lit("No cached outfit for today")))
