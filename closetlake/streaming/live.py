"""Call-log figures kept up to date from a stream.

On input that has been read to its end each equals its batch operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closetlake.functions.values import exact_sum, rounded_percent


def _timed(logs: DataFrame, delay: str) -> DataFrame:
    return logs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def health_by_window(logs: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Success rate, calls, failures and latency per tumbling window.

    State is one row per window, dropped once the watermark passes it.
    """
    good, bad = F.count_if(F.col("status") == "success"), F.count_if(F.col("status") == "failure")
    figures = _timed(logs, delay).groupBy(F.window("ts", width)).agg(
        F.count(F.lit(1)).alias("calls"), good.alias("good"), bad.alias("failures"),
        exact_sum("response_time").alias("total_ms"), F.count("response_time").alias("measured"),
    )
    average = F.round(F.col("total_ms") / F.nullif(F.col("measured"), F.lit(0))).cast("bigint")
    return figures.select(
        F.col("window.start").alias("start"), "calls",
        rounded_percent("good", F.col("good") + F.col("failures"), 100).alias("success_percent"),
        "failures", average.alias("average_ms"),
    )


def calls_per_day(logs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events per calendar day."""
    return _timed(logs, delay).groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("events")).select(
        F.to_date("window.start").alias("day"), "events"
    )


def first_success(logs: DataFrame) -> DataFrame:
    """First successful call of each account, whatever the order of arrival.

    For update or complete output; state is one row per account.
    """
    good = logs.filter(F.col("status") == "success")
    first = good.groupBy("user_id").agg(F.min(F.struct("ts", "log_id")).alias("first"))
    return first.select("user_id", "first.ts", "first.log_id")
