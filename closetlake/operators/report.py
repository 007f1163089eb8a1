"""Weekly wardrobe report, for every user at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from closetlake.functions.values import as_date, cost_per_wear, is_true, rounded_percent
from closetlake.operators.common import first_per_key, left_all, newest_first, top_k, zero_filled

WINDOW_DAYS = 7
NEGLECT_DAYS = 45
NEGLECT_LIMIT = 6
COLOR_LIMIT = 4


def report_eligible() -> Column:
    """Garments the report counts: not lookbook entries, not hidden."""
    return ~F.coalesce(F.col("type") == "lookbook", F.lit(False)) & ~is_true("hidden_from_ai")


def worn_in_week(as_of) -> Column:
    today = as_date(as_of)
    return (F.col("status") == "worn") & F.col("wear_date").between(
        F.date_sub(today, WINDOW_DAYS - 1), today
    )


def neglected(as_of) -> Column:
    """Clean garments never worn or last worn over 45 days ago."""
    cutoff = F.date_sub(as_date(as_of), NEGLECT_DAYS)
    return (F.col("laundry_status") == "Clean") & (
        F.col("last_worn").isNull() | (F.col("last_worn") < cutoff)
    )


def weekly_worn_items(wear: DataFrame, wear_items: DataFrame, as_of) -> DataFrame:
    """One row per piece of each record worn in the week, with ``days_ago``."""
    recent = wear.filter(worn_in_week(as_of)).select(
        "user_id", "record_id", F.datediff(as_date(as_of), "wear_date").alias("days_ago")
    )
    return recent.join(wear_items, ["user_id", "record_id"])


def weekly_item_wears(worn: DataFrame) -> DataFrame:
    """Wears per item, and where the item first appears (newest record first)."""
    return worn.groupBy("user_id", "item_id").agg(
        F.count(F.lit(1)).alias("wears"),
        F.min(F.struct("days_ago", "record_id", "pos")).alias("first_seen"),
    )


def weekly_usage(users: DataFrame, items: DataFrame, wear: DataFrame, wear_items: DataFrame, as_of) -> DataFrame:
    """Distinct items worn, garments, outfit days and the share of the closet used.

    Worn ids need not be owned any more, so the share may pass 100.
    """
    totals = items.filter(report_eligible()).groupBy("user_id").agg(F.count(F.lit(1)).alias("total_items"))
    days = wear.filter(worn_in_week(as_of)).groupBy("user_id").agg(
        F.count_distinct("wear_date").alias("outfit_days")
    )
    worn = weekly_worn_items(wear, wear_items, as_of).groupBy("user_id").agg(
        F.count_distinct("item_id").alias("worn_items")
    )
    joined = left_all(users.select("user_id"), [totals, days, worn])
    return zero_filled(joined, ["total_items", "outfit_days", "worn_items"]).withColumn(
        "usage_percent", rounded_percent("worn_items", "total_items")
    )


def most_repeated(items: DataFrame, worn: DataFrame) -> DataFrame:
    """The item worn most in the week; no runner-up when it is not eligible."""
    top = first_per_key(
        weekly_item_wears(worn), ["user_id"], [-F.col("wears"), F.col("first_seen")], ["item_id", "wears"]
    )
    eligible = items.filter(report_eligible()).select("user_id", "item_id", F.col("title").alias("most_repeated"), F.lit(True).alias("_eligible"))
    return top.join(eligible, ["user_id", "item_id"], "left").select(
        "user_id",
        F.when(F.col("_eligible"), F.col("item_id")).alias("most_repeated_id"),
        "most_repeated",
    )


def best_value(items: DataFrame) -> DataFrame:
    """The eligible garment with the lowest price per wear."""
    priced = items.filter(report_eligible()).withColumn(
        "cost", cost_per_wear("purchase_price", "times_worn")
    ).filter(F.col("cost").isNotNull())
    best = first_per_key(
        priced, ["user_id"], [F.col("cost"), newest_first("created_at"), F.col("item_id")], ["item_id", "title", "cost"]
    )
    return best.select(
        "user_id", F.col("item_id").alias("best_value_id"), F.col("title").alias("best_value"),
        F.round("cost").cast("bigint").alias("best_value_cost"),
    )


def neglected_items(items: DataFrame, as_of) -> DataFrame:
    """Up to six neglected garments per user, least worn first."""
    found = items.filter(report_eligible() & neglected(as_of))
    order = [F.coalesce("times_worn", F.lit(0)), newest_first("created_at"), F.col("item_id")]
    return top_k(found, ["user_id"], order, NEGLECT_LIMIT).select("user_id", "rank", "item_id", "title")


def useful_colors(items: DataFrame, worn: DataFrame) -> DataFrame:
    """The four colors worn most in the week."""
    colored = items.filter(report_eligible() & (F.col("primary_color") != "")).select(
        "user_id", "item_id", "primary_color"
    )
    counts = (
        weekly_item_wears(worn).join(colored, ["user_id", "item_id"])
        .groupBy("user_id", "primary_color")
        .agg(F.sum("wears").alias("wears"), F.min("first_seen").alias("first_seen"))
    )
    return top_k(counts, ["user_id"], [F.col("wears").desc(), F.col("first_seen")], COLOR_LIMIT).select(
        "user_id", "rank", "primary_color", "wears"
    )


def looks_with_neglected(look_items: DataFrame, neglected_rows: DataFrame) -> DataFrame:
    """Looks that hold at least one neglected garment."""
    return look_items.join(
        neglected_rows.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi"
    ).select("user_id", "look_id").distinct()


def suggested_look(looks: DataFrame, look_items: DataFrame, items: DataFrame, as_of) -> DataFrame:
    """The newest look with a neglected garment, else the newest look."""
    hits = looks_with_neglected(look_items, neglected_items(items, as_of)).withColumn("hit", F.lit(True))
    flagged = looks.select("user_id", "look_id", "created_at").join(hits, ["user_id", "look_id"], "left")
    flagged = flagged.withColumn("has_neglected", F.coalesce("hit", F.lit(False)))
    first = first_per_key(
        flagged, ["user_id"],
        [~F.col("has_neglected"), newest_first("created_at"), F.col("look_id")],
        ["look_id", "has_neglected"],
    )
    return first.select("user_id", F.col("look_id").alias("suggested_look_id"), "has_neglected")


def _closet_facts(items: DataFrame, as_of) -> DataFrame:
    """Eligible and neglected garments and best value of each user in one pass over the wardrobe."""
    cost = cost_per_wear("purchase_price", "times_worn")
    packed = F.struct(
        cost.alias("cost"), newest_first("created_at").alias("newest"), F.col("item_id"), F.col("title")
    )
    facts = items.filter(report_eligible()).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_items"), F.min(F.when(cost.isNotNull(), packed)).alias("b"),
        F.count_if(neglected(as_of)).alias("idle"),
    )
    return facts.select(
        "user_id", "total_items", F.col("b.item_id").alias("best_value_id"), F.col("b.title").alias("best_value"),
        F.round("b.cost").cast("bigint").alias("best_value_cost"),
        F.least("idle", F.lit(NEGLECT_LIMIT).cast("bigint")).alias("neglected"),
    )


def _week_facts(items: DataFrame, worn: DataFrame) -> DataFrame:
    """Items worn, the most repeated one and the useful colors of each user in one pass.

    Rows are first grouped per user and color, so what is ranked per user holds a row for each
    color and no more; all steps after the first join keep a partitioning by user.
    """
    eligible = items.filter(report_eligible()).select(
        "user_id", "item_id", "title", F.nullif("primary_color", F.lit("")).alias("color"), F.lit(True).alias("eligible")
    )
    rows = weekly_item_wears(worn).join(eligible, ["user_id", "item_id"], "left")
    colors = rows.groupBy("user_id", "color").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(-F.col("wears"), "first_seen", "item_id", "eligible", "title")).alias("top"),
        F.sum("wears").alias("wears"), F.min("first_seen").alias("first_seen"),
    )
    best_first = Window.partitionBy("user_id").orderBy(F.col("color").isNull(), F.col("wears").desc(), "first_seen")
    useful = F.col("color").isNotNull() & (F.col("rank") <= COLOR_LIMIT)
    facts = colors.withColumn("rank", F.row_number().over(best_first)).groupBy("user_id").agg(
        F.sum("n").alias("worn_items"), F.min("top").alias("top"), F.sort_array(F.collect_list(F.when(useful, F.struct("rank", "color")))).alias("c"),
    )
    shown = F.when(F.size("c") > 0, F.array_join(F.transform("c", lambda x: x["color"]), ", "))
    return facts.select(
        "user_id", "worn_items", F.when(F.col("top.eligible"), F.col("top.item_id")).alias("most_repeated_id"),
        F.col("top.title").alias("most_repeated"), shown.alias("colors"),
    )


def weekly_report(users, items, wear, wear_items, looks, look_items, as_of) -> DataFrame:
    """All parts of the report, one row per user."""
    days = wear.filter(worn_in_week(as_of)).groupBy("user_id").agg(
        F.count_distinct("wear_date").alias("outfit_days")
    )
    joined = left_all(
        users.select("user_id"),
        [_closet_facts(items, as_of), days, _week_facts(items, weekly_worn_items(wear, wear_items, as_of)),
         suggested_look(looks, look_items, items, as_of)],
    )
    today = as_date(as_of)
    return (
        zero_filled(joined, ["total_items", "outfit_days", "worn_items", "neglected"])
        .withColumn("usage_percent", rounded_percent("worn_items", "total_items"))
        .withColumn("since", F.date_sub(today, WINDOW_DAYS - 1)).withColumn("until", today)
    )
