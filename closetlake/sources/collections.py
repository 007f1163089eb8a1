"""Reading collections and static content."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_collection(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """A collection with a declared schema; one that does not exist is empty."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def owned_by(df: DataFrame, user_id) -> DataFrame:
    """Rows of one owner; the test reaches the scan."""
    return df.filter(F.col("user_id") == F.lit(user_id))


CONTENT_SCHEMA = "occasions array<string>, demoGarments array<struct<title string, category string, image string>>"


def occasions(spark: SparkSession, path: str) -> DataFrame:
    """Occasions of the static content file, in file order."""
    content = spark.read.schema(CONTENT_SCHEMA).option("multiLine", True).json(path)
    return content.select(F.posexplode("occasions").alias("position", "occasion"))


def demo_garments(spark: SparkSession, path: str) -> DataFrame:
    content = spark.read.schema(CONTENT_SCHEMA).option("multiLine", True).json(path)
    return content.select(F.inline("demoGarments"))


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """Addresses of a sitemap file."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path).select("loc")
