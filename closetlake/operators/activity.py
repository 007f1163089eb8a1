"""The activity feed over all tables, its summary, pages and per-user detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from closetlake.functions.calendar import day, within_days
from closetlake.functions.text import event_detail
from closetlake.functions.values import first_text
from closetlake.operators.accounts import ACTIVITY_CHAIN
from closetlake.operators.common import left_all, newest_first, zero_filled
from closetlake.operators.paging import DAY, page

EVENTS_PER_PAGE = 30


def _value(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _events(df: DataFrame, kind: str, table: str, key: str, label: Column, times: list[str]) -> DataFrame:
    known = [F.col(t).cast("timestamp") for t in times if t in df.columns]
    detail = event_detail(*[_value(df, n) for n in ("feature", "model", "provider", "status", "error_message")])
    return df.select(
        F.lit(kind).alias("type"), label.alias("label"), F.col("user_id").cast("string").alias("user_id"),
        F.coalesce(*known).alias("time"), detail.alias("detail"),
        F.concat(F.lit(f"{table}:"), F.col(key).cast("string")).alias("event_id"),
    )


def _named(df: DataFrame, prefix: str, names: list[str], default: str) -> Column:
    return F.concat(F.lit(prefix), F.coalesce(first_text(*[_value(df, n) for n in names]), F.lit(default)))


def activity_feed(users, items, looks, history, wear, quests, responses, logs) -> DataFrame:
    """Events of eight tables in one form; rows without a time are dropped."""
    call = F.concat(
        F.coalesce(first_text("type"), F.lit("API")), F.lit(" request "),
        F.coalesce(first_text("status"), F.lit("logged")),
    )
    parts = [
        _events(users, "account", "users", "user_id", F.lit("User joined"), ["created_at"]),
        _events(items.withColumn("event_key", F.concat_ws("/", "user_id", "item_id")), "wardrobe", "wardrobe",
                "event_key", _named(items, "Added ", ["title"], "a garment"), ["created_at"]),
        _events(looks, "outfit", "looks", "look_id", _named(looks, "Saved ", ["title", "occasion"], "an outfit"), ["created_at"]),
        _events(history, "ai", "history", "id", F.lit("Completed a style check"), ["created_at", "ts"]),
        _events(wear, "outfit", "wear", "record_id", F.lit("Logged an outfit wear"), ["created_at", "worn_at", "date"]),
        _events(quests, "outfit", "quests", "submission_id",
                _named(quests, "Completed ", ["challenge_title"], "a Closet Quest"), ["created_at"]),
        _events(responses, "ai", "responses", "id", _named(responses, "Generated ", ["feature", "type"], "an AI response"),
                ["created_at", "ts"]),
        _events(logs, "ai", "logs", "log_id", call, ["ts"]),
    ]
    return reduce(DataFrame.unionByName, parts).filter(F.col("time").isNotNull())


def with_actor(feed: DataFrame, users: DataFrame) -> DataFrame:
    """Add the user's name, else e-mail, else id, else System."""
    known = users.select(
        F.col("user_id").cast("string").alias("user_id"),
        first_text("full_name", "display_name", "email").alias("known_name"),
    )
    joined = feed.join(known, "user_id", "left")
    return joined.withColumn("actor", F.coalesce("known_name", first_text("user_id"), F.lit("System"))).drop("known_name")


def filter_feed(feed: DataFrame, kind: str = "all", start=None, end=None) -> DataFrame:
    """Events of one type within inclusive local days."""
    wanted = F.lit(True) if kind == "all" else F.col("type") == kind
    return feed.filter(wanted & within_days("time", start, end))


def registered_only(feed: DataFrame, users: DataFrame) -> DataFrame:
    return feed.join(users.select(F.col("user_id").cast("string").alias("user_id")), "user_id", "left_semi")


def feed_summary(feed: DataFrame, users: DataFrame) -> DataFrame:
    """Events, distinct registered users and distinct days, as one row.

    Events are first counted per user and day, so what is joined and made
    distinct no longer grows with the number of events.
    """
    daily = feed.groupBy("user_id", day("time").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    known = users.select(F.col("user_id").cast("string").alias("user_id"), F.lit(True).alias("known"))
    return daily.join(known, "user_id", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("events"),
        F.count_distinct(F.when(F.col("known"), F.col("user_id"))).alias("active_users"),
        F.count_distinct("day").alias("active_dates"),
    )


def events_per_day(feed: DataFrame) -> DataFrame:
    return feed.groupBy(day("time").alias("day")).agg(F.count(F.lit(1)).alias("events"))


def feed_counts(feed: DataFrame) -> DataFrame:
    """Events per day, as ``bucket``, ``n``, ``low``, ``high`` for paging and ``day`` in the local time zone.

    Holds few rows per day and may be stored; ``feed_page`` then reads the feed for the rows of a page only.
    """
    keyed = feed.select(newest_first("time").alias("key"), day("time").alias("day"))
    return keyed.groupBy(F.floor(F.col("key") / DAY).cast("bigint").alias("bucket"), "day").agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))


def feed_page(feed: DataFrame, number: int, counts: DataFrame | None = None) -> DataFrame:
    """One page, newest first; each day's first row on the page carries its count.

    ``counts`` are the feed's ``feed_counts`` if they are kept; without, they are counted here and held as rows.
    """
    if counts is None:
        counts = feed.sparkSession.createDataFrame(feed_counts(feed).toArrow())
    buckets = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    order = [newest_first("time"), F.col("event_id")]
    rows = page(feed, order, number, EVENTS_PER_PAGE, buckets).withColumn("day", day("time"))
    # At most one page of rows reaches this window.
    previous = F.lag("day").over(Window.orderBy("row_no"))
    rows = rows.withColumn("heading", F.coalesce(previous != F.col("day"), F.lit(True)))
    counted = rows.join(counts.groupBy("day").agg(F.sum("n").alias("events")), "day", "left")
    return counted.select(
        "row_no", "page", "page_count", "event_id", "label", *[c for c in ("actor", "user_id", "type", "detail", "time") if c in counted.columns],
        "day", "heading",
        F.when(F.col("heading"), F.col("events")).alias("day_events"),
    )


def user_detail(users, feed, items, looks, start=None, end=None) -> DataFrame:
    """Events, active days, garments, looks and AI actions per user in a range."""
    inside = filter_feed(feed, "all", start, end)
    events = inside.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct(day("time")).alias("active_days"),
        F.count_if(F.col("type") == "ai").alias("ai_actions"),
    )

    def added(df: DataFrame, name: str) -> DataFrame:
        known = F.coalesce(*[F.col(c).cast("timestamp") for c in ACTIVITY_CHAIN if c in df.columns])
        kept = df.withColumn("_at", known).filter(within_days("_at", start, end))
        return kept.groupBy(F.col("user_id").cast("string").alias("user_id")).agg(F.count(F.lit(1)).alias(name))

    base = users.select(F.col("user_id").cast("string").alias("user_id"))
    joined = left_all(base, [events, added(items, "closet_items"), added(looks, "outfits")])
    return zero_filled(joined, ["events", "active_days", "ai_actions", "closet_items", "outfits"])
