"""Platform totals, API health, model performance, sharing and limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from closetlake.functions.text import pretty_label
from closetlake.functions.values import as_date, as_instant, exact_sum, first_number, first_text, rounded_percent
from closetlake.operators.accounts import effective_limit
from closetlake.operators.common import flag_first, top_k

# Models listed even when no call used them.
CONFIGURED_MODELS = [
    "primary-gemini/gemini-3.1-flash-lite",
    "groq/openai/gpt-oss-20b",
    "groq/qwen/qwen3.6-27b",
    "groq/openai/gpt-oss-120b",
    "secondary-gemini/gemini-3.1-flash-lite",
]
FEATURES_SHOWN = 3


def _field(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def labelled_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each table under its label."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("label"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def platform_totals(users, items, looks, responses, history, now) -> DataFrame:
    """Users, users of the last 7 x 24 hours, garments, outfits and AI actions."""
    since = as_instant(now) - F.expr("INTERVAL 7 DAYS")
    counts = labelled_counts({
        "users": users, "new_users": users.filter(F.col("created_at") >= since), "garments": items,
        "outfits": looks, "responses": responses, "history": history,
    })

    def total(*labels: str) -> Column:
        return F.sum(F.when(F.col("label").isin(*labels), F.col("n")).otherwise(0))

    return counts.agg(
        total("users").alias("users"), total("new_users").alias("new_users"), total("garments").alias("garments"),
        total("outfits").alias("outfits"), total("responses", "history").alias("ai_actions"),
    )


def bar_widths(counts: DataFrame) -> DataFrame:
    """Width of each bar in percent of the largest; at least 4 unless it is 0."""
    largest = counts.agg(F.greatest(F.lit(1), F.max("n")).alias("largest"))  # one row
    width = F.greatest(F.when(F.col("n") != 0, 4).otherwise(0), F.col("n") / F.col("largest") * 100)
    return counts.crossJoin(F.broadcast(largest)).withColumn("width", width).drop("largest")


def _latency(c: Column) -> Column:
    """Mean latency rounded to whole milliseconds, null when none was measured."""
    return F.round(exact_sum(c) / F.nullif(F.count(c), F.lit(0))).cast("bigint")


def api_health(logs: DataFrame, now) -> DataFrame:
    """Success rate (100 before any result), calls today, mean latency, failures."""
    good, bad = F.count_if(F.col("status") == "success"), F.count_if(F.col("status") == "failure")
    midnight = as_date(now).cast("timestamp")
    measured = logs.agg(
        good.alias("good"), bad.alias("failures"), F.count_if(F.col("ts") >= midnight).alias("calls_today"),
        _latency(F.col("response_time")).alias("average_ms"),
    )
    return measured.select(
        rounded_percent("good", F.col("good") + F.col("failures"), 100).alias("success_percent"),
        "calls_today", "average_ms", "failures",
    )


def model_performance(logs: DataFrame) -> DataFrame:
    """Calls, success rate, latency, features and last use of each model.

    Configured models are listed even without a call. Only the first three
    features of a model are gathered into its text.
    """
    keyed = logs.select(
        F.concat_ws(
            "/", F.coalesce(first_text("provider", "type"), F.lit("AI service")),
            F.coalesce(first_text("model"), F.lit("Unspecified model")),
        ).alias("model_key"),
        "status", "ts", "log_id",
        F.coalesce(*[_field(logs, n, "double") for n in ("response_time", "duration_ms", "latency_ms")]).alias("ms"),
        first_text(*[_field(logs, n) for n in ("feature", "operation", "endpoint", "type")]).alias("used_for"),
    )
    figures = keyed.groupBy("model_key").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") == "success").alias("good"),
        F.count_if(F.col("status") == "failure").alias("failures"), _latency(F.col("ms")).alias("average_ms"),
        F.max("ts").alias("last_used"),
    )
    first_use = keyed.filter(F.col("used_for").isNotNull()).groupBy("model_key", "used_for").agg(
        F.min(F.struct("ts", "log_id")).alias("first_use")
    )
    named = top_k(first_use, ["model_key"], [F.col("first_use")], FEATURES_SHOWN).groupBy("model_key").agg(
        F.sort_array(F.collect_list(F.struct("rank", "used_for"))).alias("f")
    ).select("model_key", F.array_join(F.transform("f", lambda x: x["used_for"]), ", ").alias("features"))
    spark = logs.sparkSession
    joined = configured_models(spark).join(figures, "model_key", "full").join(named, "model_key", "left")
    return joined.select(
        "model_key", F.coalesce("calls", F.lit(0)).alias("calls"),
        rounded_percent("good", F.col("good") + F.col("failures"), None).alias("success_percent"),
        F.coalesce("failures", F.lit(0)).alias("failures"), "average_ms",
        F.coalesce("features", F.lit("General AI")).alias("features"), "last_used",
    )


def configured_models(spark: SparkSession) -> DataFrame:
    names = F.array(*[F.lit(m) for m in CONFIGURED_MODELS])
    return spark.range(1).select(F.explode(names).alias("model_key"))


def provider_counts(logs: DataFrame) -> DataFrame:
    key = F.coalesce(first_text("provider", "type"), F.lit("unknown"))
    return logs.groupBy(key.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def feature_counts(responses: DataFrame) -> DataFrame:
    key = pretty_label(F.coalesce(first_text("feature", "type"), F.lit("Other AI response")))
    return responses.groupBy(key.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def share_metrics(links: DataFrame, attribution: DataFrame) -> DataFrame:
    """Cards, clicks, activated installs and click rate (may pass 100)."""
    left = links.agg(
        F.count(F.lit(1)).alias("cards"),
        F.coalesce(F.sum(F.coalesce(first_number("click_count", "clicks"), F.lit(0))), F.lit(0)).alias("clicks"),
    )
    active = (F.col("activated") == F.lit(True)) | (_field(attribution, "event") == "activated_install")
    right = attribution.agg(F.count_if(active).alias("installs"))
    # Two single rows.
    return left.crossJoin(F.broadcast(right)).withColumn("click_percent", rounded_percent("clicks", "cards"))


def daily_limit_use(logs: DataFrame, users: DataFrame, global_limit: Column) -> DataFrame:
    """AI calls per user and day against the user's effective limit."""
    daily = logs.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("calls"))
    own = users.select("user_id", "ai_daily_limit")
    # Accounts without a user row have the limit of all.
    limited = daily.join(own, "user_id", "left").withColumn("daily_limit", effective_limit("ai_daily_limit", global_limit))
    return limited.drop("ai_daily_limit").withColumn("over_limit", F.col("calls") > F.col("daily_limit"))


def first_recommendations(logs: DataFrame) -> DataFrame:
    """Successful calls, each marked as the account's first or as one to refuse."""
    good = logs.filter(F.col("status") == "success").select("user_id", "log_id", "ts")
    return flag_first(good, "user_id", ["ts", "log_id"], "first").withColumn("would_refuse", ~F.col("first"))


def user_extras(wear: DataFrame, quests: DataFrame, logs: DataFrame, users: DataFrame) -> DataFrame:
    """Planned and worn outfits, quests with points, and successful AI calls per user."""
    from closetlake.functions.values import points
    from closetlake.operators.common import left_all, zero_filled

    worn = wear.groupBy("user_id").agg(
        F.count_if(F.col("status") == "planned").alias("planned"), F.count_if(F.col("status") == "worn").alias("worn")
    )
    done = quests.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("quests"), F.sum(points("points_earned", "score_total")).alias("points")
    )
    calls = logs.groupBy("user_id").agg(F.count_if(F.col("status") == "success").alias("good_calls"))
    return zero_filled(
        left_all(users.select("user_id"), [worn, done, calls]), ["planned", "worn", "quests", "points", "good_calls"]
    )
