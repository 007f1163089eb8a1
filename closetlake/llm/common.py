"""What the operators of this subpackage share.

Results that several later steps read are written once as Parquet into the
folder that ``spark.checkpoint.dir`` names, which all machines see. A lost
executor then costs its running tasks only. Such tables hold keys, counts or
hashes, are compressed, and may be removed when the result has been written.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators want: Arrow batches bounded in bytes (texts may be long) and splitting of hot keys in joins."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2000000")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


@cache
def _local_folder(application: str) -> str:
    """One temporary folder for each local application."""
    return tempfile.mkdtemp(prefix=f"llm-{application}-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Without one, a temporary folder where all tasks run in this process, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster see")
    return _local_folder(spark.sparkContext.applicationId)


def stored(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it from there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{_run(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _run(spark: SparkSession) -> str:
    return f"llm-{spark.sparkContext.applicationId}"


def remove_stored(spark: SparkSession) -> None:
    """Remove what this application has stored, once no result that reads it is needed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{_run(spark)}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: A side of a join is broadcast up to so many rows of some tens of bytes each, and shuffled beyond.
BROADCAST_ROWS = 1_000_000


def sized_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it is small; otherwise Spark shuffles both sides."""
    return F.broadcast(df) if df.count() <= most else df


def hidden(df: DataFrame, *names: str) -> list[str]:
    """Names for own columns that ``df`` does not have in any letter case: the given ones, lengthened where taken."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_mod(doc_id: str, mod: int) -> Column:
    """``crc32`` of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % mod


def held_out(doc_id: str, mod: int, fold: int) -> Column:
    """True for rows kept out of learning; a row without id is scored but belongs to no fold."""
    return F.coalesce(crc_mod(doc_id, mod) == fold, F.lit(False))


def in_training(doc_id: str, mod: int, fold: int) -> Column:
    return F.coalesce(crc_mod(doc_id, mod) != fold, F.lit(False))


def sample_order(doc_id: str) -> list[Column]:
    """A fixed pseudo-random order of rows by id."""
    return [F.xxhash64(F.lit("sample"), F.col(doc_id)), F.col(doc_id)]
