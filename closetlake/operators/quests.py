"""Quest streaks, points and badges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from closetlake.functions.values import as_date, first_text, optional, points, text
from closetlake.operators.common import left_all, zero_filled
from closetlake.operators.looks import record_previews

# Badge, figure it looks at, goal.
BADGES = [
    ("First Quest", "quests", 1),
    ("Style Spark", "points", 250),
    ("On Fire", "streak", 3),
    ("Perfect Week", "streak", 7),
    ("Style Master", "best_score", 90),
    ("Quest Legend", "quests", 25),
]
ELIGIBLE_GARMENTS = 10
HISTORY_PIECES = 4


def _islands(quests: DataFrame) -> DataFrame:
    """Runs of consecutive days per user. Days are made distinct first, so a
    user's window holds at most one row per calendar day."""
    days = quests.filter(F.col("challenge_date").isNotNull()).select("user_id", "challenge_date").distinct()
    w = Window.partitionBy("user_id").orderBy("challenge_date")
    run = F.date_sub("challenge_date", F.row_number().over(w))
    return days.withColumn("run", run).groupBy("user_id", "run").agg(
        F.count(F.lit(1)).alias("length"), F.max("challenge_date").alias("ends")
    )


def streaks(quests: DataFrame, as_of) -> DataFrame:
    """Current and longest streak.

    The current one ends on the newest day and is 0 when that day lies more than
    one day back; a newest day in the future still counts.
    """
    runs = _islands(quests).groupBy("user_id").agg(
        F.max(F.struct("ends", "length")).alias("last"), F.max("length").alias("longest_streak")
    )
    alive = F.datediff(as_date(as_of), F.col("last.ends")) <= 1
    return runs.select(
        "user_id", F.when(alive, F.col("last.length")).otherwise(0).alias("streak"), "longest_streak"
    )


def quest_summary(users: DataFrame, quests: DataFrame, as_of) -> DataFrame:
    figures = quests.groupBy("user_id").agg(
        F.sum(points("points_earned", "score_total")).alias("points"),
        F.count(F.lit(1)).alias("quests"),
        F.greatest(F.lit(0), F.max(F.coalesce("score_total", F.lit(0)))).alias("best_score"),
    )
    current = streaks(quests, as_of).select("user_id", "streak")
    return zero_filled(
        left_all(users.select("user_id"), [figures, current]), ["points", "quests", "best_score", "streak"]
    )


def badges(summary: DataFrame) -> DataFrame:
    """Six badges per user, with progress capped at the goal."""
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("badge"), F.lit(goal).alias("goal"),
            (F.col(figure) >= goal).alias("earned"),
            F.least(F.col(figure).cast("bigint"), F.lit(goal)).alias("progress"),
        )
        for name, figure, goal in BADGES
    ])
    return summary.select("user_id", F.inline(rows))


def quest_history(quests: DataFrame, quest_items: DataFrame, look_items: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each quest done, with title, occasion, score, points and its first four owned pieces.

    ``created_at`` and ``submission_id`` order a user's rows, newest first; a user
    may have any number, so they are not numbered here.
    """
    title = F.coalesce(first_text(optional(quests, "challenge_title"), optional(quests, "snapshot_title")), F.lit("Closet Quest"))
    rows = quests.select(
        "user_id", "submission_id", "created_at", "challenge_date", title.alias("title"),
        text(optional(quests, "snapshot_occasion")).alias("occasion"), F.coalesce("score_total", F.lit(0)).alias("score"),
        F.coalesce("points_earned", F.lit(0)).alias("points"),
    )
    records = quests.select("user_id", F.col("submission_id").alias("record_id"), "outfit_id")
    pieces = quest_items.withColumnRenamed("submission_id", "record_id")
    previews = record_previews(records, pieces, look_items, items, HISTORY_PIECES).withColumnRenamed("record_id", "submission_id")
    return rows.join(previews, ["user_id", "submission_id"], "left")


def week_activity(quests: DataFrame, as_of) -> DataFrame:
    """The last seven days of each player and whether a quest was done."""
    today = as_date(as_of)
    shown = quests.select("user_id").distinct().select(
        "user_id", F.explode(F.sequence(F.date_sub(today, 6), today)).alias("challenge_date")
    )
    done = quests.select("user_id", "challenge_date", F.lit(True).alias("done")).distinct()
    return shown.join(done, ["user_id", "challenge_date"], "left").withColumn("done", F.coalesce("done", F.lit(False)))


def quest_eligible(items: DataFrame) -> DataFrame:
    """Users with at least ten garments."""
    counted = items.groupBy("user_id").agg(F.count(F.lit(1)).alias("garments"))
    return counted.filter(F.col("garments") >= ELIGIBLE_GARMENTS)


def active_challenges(challenges: DataFrame, as_of) -> DataFrame:
    """Published challenges whose dates include the day."""
    return challenges.filter(
        (F.col("status") == "published") & as_date(as_of).between(F.col("start_date"), F.col("end_date"))
    )
