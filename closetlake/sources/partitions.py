"""Keyed updates of stored tables that rewrite only the partitions they change.

A table is a folder of Parquet files partitioned by one column. The keys of the requests name
the partitions that an update can change; only these are read, their next state is
compared with the present one by counts and sums of row hashes, and only those that differ are
overwritten. A second run of the same update therefore writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Partitions of a table that is spread by a key.
SPREAD = 64


def spread_by(key: str, partitions: int = SPREAD) -> Column:
    """A partition number that follows from a key, for tables without a natural partition such as a month."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(partitions)).cast("int")


def store_partitioned(df: DataFrame, path: str, partition: str) -> DataFrame:
    """Write a table, each partition gathered from as many files as it has tasks, and return it as stored."""
    df.write.mode("overwrite").partitionBy(partition).parquet(path)
    return read_partitioned(df.sparkSession, path, df.schema)


def read_partitioned(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table with its columns in the order of ``schema``."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def _marks(rows: DataFrame, partition: str, columns: list[str]) -> DataFrame:
    """Rows and their hashes added up, by partition; the order of rows does not matter."""
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in columns]).cast("decimal(38,0)")
    return rows.groupBy(partition).agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("hash"))


def update_partitions(
    spark: SparkSession, path: str, schema, requests: DataFrame, keys: list[str], update: Callable[[DataFrame], DataFrame], partition: str,
) -> list:
    """Replace the partitions of the table at ``path`` that ``update`` changes, and return their values.

    ``update`` gets the rows of the partitions that hold a key of ``requests`` and returns their next state, with the
    same columns; it must not move rows to other partitions nor change rows whose keys are not asked for. A partition that loses all rows is removed.
    The values of touched partitions are the only rows that reach the driver.
    """
    table = read_partitioned(spark, path, schema)
    asked = requests.select(*keys).distinct()
    touched = [r[0] for r in table.join(asked, keys, "left_semi").select(partition).distinct().collect()]
    if not touched:
        return []
    same = F.col(partition).isin([x for x in touched if x is not None])
    before = table.filter(same | F.col(partition).isNull() if None in touched else same)
    columns = table.columns
    after = update(before).select(*columns)
    old, new = _marks(before, partition, columns), _marks(after, partition, columns)
    met = old.withColumnsRenamed({"n": "old_n", "hash": "old_hash"}).join(new.withColumnRenamed(partition, "_p"), F.col(partition).eqNullSafe(F.col("_p")), "left")
    differ = met.filter(~(F.col("n").eqNullSafe(F.col("old_n")) & F.col("hash").eqNullSafe(F.col("old_hash")))).select(partition, "n").collect()
    changed = [r[0] for r in differ if r[1] is not None]
    if changed:
        kept = F.col(partition).isin([x for x in changed if x is not None])
        rows = after.filter(kept | F.col(partition).isNull() if None in changed else kept)
        # Dynamic: Spark writes beside the table and replaces whole partitions when all tasks are done.
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    files = spark._jvm.org.apache.hadoop.fs
    for value in (r[0] for r in differ if r[1] is None):
        name = "__HIVE_DEFAULT_PARTITION__" if value is None else str(value)
        gone = files.Path(f"{path}/{partition}={name}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return sorted((r[0] for r in differ), key=str)
