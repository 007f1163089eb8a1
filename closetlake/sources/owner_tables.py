"""Tables stored by owner.

A table that is written with its rows bucketed by ``user_id``, and sorted by it within a bucket, is
read with that partitioning: what joins or groups by owner, or by owner and
more, then needs no shuffle of the table. All tables that are joined get the same number of
buckets. A bucket is one task's work, so there must be enough of them
for the largest to fit a task; a large owner's rows stay together in this form, which
the unbucketed tables with skew joins avoid. ``bucket_sizes`` shows whether an owner stands out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OWNER = "user_id"
#: Bytes of a bucket that the number of buckets aims at.
BUCKET_BYTES = 256 * 1024 * 1024


def buckets_for(total_bytes: int, least: int = 1) -> int:
    """A power of two, so that tables bucketed at different times still divide each other."""
    wanted = max(least, -(-total_bytes // BUCKET_BYTES))
    return 1 << max(0, wanted - 1).bit_length()


def store_by_owner(df: DataFrame, name: str, buckets: int, owner: str = OWNER) -> DataFrame:
    """Write ``df`` as the table ``name`` with one file per bucket and return it as stored.

    Rows of an owner are dealt once here by the hash that buckets are numbered by. Rows without owner share a bucket.
    """
    spark = df.sparkSession
    dealt = df.repartition(buckets, owner)
    dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, owner).sortBy(owner).saveAsTable(name)
    return spark.table(name)


def co_located(spark: SparkSession) -> SparkSession:
    """Let joins by owner and more (an item, a record) use a partitioning by owner alone, as these tables have it."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "true")
    return spark


def stored_by_owner(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def bucket_sizes(df: DataFrame, buckets: int, owner: str = OWNER) -> DataFrame:
    """Rows of each bucket and of its largest owner: a bucket that one owner fills cannot be split by more buckets."""
    per_owner = df.groupBy(owner).agg(F.count(F.lit(1)).alias("n"))
    number = F.pmod(F.hash(owner), F.lit(buckets))
    return per_owner.groupBy(number.alias("bucket")).agg(F.sum("n").alias("rows"), F.max("n").alias("largest_owner"))
