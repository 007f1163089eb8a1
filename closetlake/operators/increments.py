"""Summaries that grow with what arrived instead of being computed anew.

* **Month bitmaps.** The active days of a user in a month are the bits of one number. Bitmaps are
  merged by ``bit_or`` in any order, and a day that comes twice changes nothing. Active
  days, distinct days and streaks are exact figures of them, so yesterday's bitmaps and today's
  rows give what all rows give.
* **Activity state.** Counts per day and per user and month. A batch of events is freed from those that are
  known already by its ledger of event ids, of which only the days of the batch are
  read, and its counts are added. Late events fall into their own day.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closetlake.functions.calendar import day
from closetlake.functions.values import as_date


def _bit(date: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), F.dayofmonth(date) - 1)


def _month(date: Column) -> Column:
    return F.trunc(date, "month").cast("date")


def month_bitmaps(rows: DataFrame, date: str = "day", user: str = "user_id") -> DataFrame:
    """``user_id``, ``month`` and ``days``: bit k stands for day k + 1. Rows without a date are left out."""
    known = rows.select(F.col(user).alias("user_id"), F.col(date).cast("date").alias("date")).filter(F.col("date").isNotNull())
    return known.groupBy("user_id", _month(F.col("date")).alias("month")).agg(F.bit_or(_bit(F.col("date"))).alias("days"))


def merged_bitmaps(*parts: DataFrame) -> DataFrame:
    """Bitmaps of all parts together; parts may overlap and come in any order."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("user_id", "month").agg(F.bit_or("days").alias("days"))


def active_days(bitmaps: DataFrame, start=None, end=None) -> DataFrame:
    """Distinct active days of each user within inclusive days; users without any have no row."""
    first = F.lit(1) if start is None else F.datediff(as_date(start), "month") + 1
    last = F.lit(31) if end is None else F.datediff(as_date(end), "month") + 1
    low, high = F.least(F.greatest(first, F.lit(1)), F.lit(32)), F.greatest(F.least(last, F.lit(31)), F.lit(0))
    upto = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int")) - 1
    inside = F.col("days").cast("bigint").bitwiseAND(F.greatest(upto(high) - upto(low - 1), F.lit(0)))
    return bitmaps.groupBy("user_id").agg(F.sum(F.bit_count(inside)).alias("active_days")).filter("active_days > 0")


def run_summary(bitmaps: DataFrame) -> DataFrame:
    """Per user the ``last_day``, the run that ends there (``trailing``) and the longest run (``best``).

    A month's runs are read off its bits; months, in order, are joined where one ends and the next
    begins with an active day. A user's list holds one entry for each active month.
    """
    size = F.dayofmonth(F.last_day("month"))
    bits = F.reverse(F.lpad(F.bin("days"), 31, "0"))  # day 1 first
    shown = F.substring(bits, F.lit(1), size)
    longest = F.array_max(F.transform(F.split(shown, "0"), lambda x: F.length(x)))
    lead, tail = F.length(F.regexp_extract(shown, "^(1*)", 1)), F.length(F.regexp_extract(shown, "(1*)$", 1))
    last = F.length(F.rtrim(F.translate(shown, "0", " ")))
    to_last = F.length(F.regexp_extract(F.rtrim(F.translate(shown, "0", " ")), "(1*)$", 1))
    month = F.struct("month", size.alias("size"), longest.alias("longest"), lead.alias("lead"), tail.alias("tail"), last.alias("last"), to_last.alias("to_last"))
    start = F.struct(F.lit(None).cast("date").alias("month"), F.lit(0).alias("open"), F.lit(0).alias("best"), F.lit(0).alias("trailing"), F.lit(0).alias("last"))

    def step(done: Column, m: Column) -> Column:
        # The run that is open at the end of the month before goes on.
        carried = F.when(F.add_months(done["month"], 1) == m["month"], done["open"]).otherwise(0)
        whole = m["lead"] == m["size"]
        return F.struct(
            m["month"].alias("month"), F.when(whole, carried + m["size"]).otherwise(m["tail"]).alias("open"),
            F.greatest(done["best"], m["longest"], carried + m["lead"]).alias("best"),
            # The run up to the last active day reaches back to the month before if it fills all days until then.
            F.when(m["to_last"] == m["last"], carried + m["to_last"]).otherwise(m["to_last"]).alias("trailing"), m["last"].alias("last"))

    folded = bitmaps.filter("days <> 0").groupBy("user_id").agg(F.sort_array(F.collect_list(month)).alias("months"))
    rows = folded.select("user_id", F.aggregate("months", start, step).alias("r"))
    return rows.select("user_id", F.date_add("r.month", F.col("r.last") - 1).alias("last_day"), F.col("r.trailing").alias("trailing"), F.col("r.best").alias("best"))


def streaks_of(bitmaps: DataFrame, as_of) -> DataFrame:
    """Current and longest streak from bitmaps, as ``quests.streaks`` has them from all rows."""
    alive = F.datediff(as_date(as_of), "last_day") <= 1
    return run_summary(bitmaps).select(
        "user_id", F.when(alive, F.col("trailing")).otherwise(0).cast("bigint").alias("streak"), F.col("best").cast("bigint").alias("longest_streak"))


@dataclass
class ActivityState:
    """``ledger`` (event_id, day), ``days`` (day, events) and ``months`` (user_id, month, days, events)."""

    ledger: DataFrame
    days: DataFrame
    months: DataFrame


def empty_state(spark) -> ActivityState:
    return ActivityState(
        spark.createDataFrame([], "event_id string, day date"), spark.createDataFrame([], "day date, events bigint"),
        spark.createDataFrame([], "user_id string, month date, days int, events bigint"))


def arrived_after(feed: DataFrame, arrived: str, mark) -> DataFrame:
    """Events that arrived after the high-water mark, which is the largest ``arrived`` of earlier batches (None: all)."""
    return feed if mark is None else feed.filter(F.col(arrived) > F.lit(mark))


def new_events(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """``event_id``, ``user_id``, ``day`` of the events of a batch that the ledger lacks, each once.

    A repeated event has its first time; only the ledger's partitions of the batch's days are met.
    """
    keyed = batch.select("event_id", "user_id", day("time").alias("day"))
    once = keyed.groupBy("event_id", "day").agg(F.min("user_id").alias("user_id"))
    return once.join(ledger.select("event_id", "day"), ["event_id", "day"], "left_anti")


def advanced(state: ActivityState, batch: DataFrame) -> ActivityState:
    """The state after a batch. A caller stores its tables, the ledger by appending to the days of the batch.

    The new events are found here and kept on the executors' disks: all three tables, and those of
    the batches that follow, are made of them.
    """
    fresh = new_events(batch, state.ledger).localCheckpoint(storageLevel=StorageLevel.DISK_ONLY)
    days = fresh.groupBy("day").agg(F.count(F.lit(1)).alias("events"))
    months = fresh.groupBy("user_id", _month(F.col("day")).alias("month")).agg(F.bit_or(_bit(F.col("day"))).alias("days"), F.count(F.lit(1)).alias("events"))
    return ActivityState(
        state.ledger.unionByName(fresh.select("event_id", "day")),
        state.days.unionByName(days).groupBy("day").agg(F.sum("events").alias("events")),
        state.months.unionByName(months).groupBy("user_id", "month").agg(F.bit_or("days").alias("days"), F.sum("events").alias("events")))


def summary_of(state: ActivityState, users: DataFrame) -> DataFrame:
    """Events, distinct registered users and distinct days of a state, as one row (``activity.feed_summary`` of all events)."""
    known = users.select(F.col("user_id").cast("string").alias("user_id"))
    active = state.months.select("user_id").distinct().join(known, "user_id", "left_semi").agg(F.count(F.lit(1)).alias("active_users"))
    months = state.months.groupBy("month").agg(F.bit_or("days").alias("days"), F.sum("events").alias("events"))
    figures = months.agg(F.coalesce(F.sum("events"), F.lit(0)).alias("events"), F.coalesce(F.sum(F.bit_count("days")), F.lit(0)).alias("active_dates"))
    return figures.crossJoin(active).select("events", "active_users", "active_dates")  # two single rows
