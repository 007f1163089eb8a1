"""Spark settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Keys are owners, and one owner may hold a large part of all rows: adaptive
# execution splits the partitions of such an owner in joins, also when that
# costs one more shuffle. Group sizes before that are kept small by the plans.
# Text expressions and JSON cost far more per byte than the default smallest
# partition (1 MB) assumes, so a small shuffle may spread over more cores; large
# shuffles never get near this bound.
# Partitions are joined up to 8 MB (64 MB is the default): rows that a task sorts or
# groups take some fifty times their compressed size.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8MB",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def apply(spark: SparkSession) -> SparkSession:
    """Set them on a session; the time zone decides where days begin and is left alone."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
