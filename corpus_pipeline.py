"""A training-data pipeline over ``documents``: five stages, each one operator of the llm subpackage.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's docs. All but the last return the
columns of ``documents``.

Any further columns of ``docs`` are kept with their values, whatever their names. An
empty table stays empty through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from closetlake.llm import jaccard_join, langid, mixing, sharding, tiling
from closetlake.llm.common import prepare, shared_folder, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters or torn between two languages go.

    Null and empty texts have no letters. Rows without id and repeated rows are judged like all others.
    """
    prepare(spark)
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is connected by a Jaccard similarity of 0.8 over five-word shingles.

    The smallest id stays, of several rows with it in one group the one with the smallest hash of all columns; rows of
    one id with different texts are different documents. Rows without id stay. Rows without words are near to wordless rows of their id only.
    """
    prepare(spark)
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not cover a benchmark item.

    Null and wordless texts stay, repeated rows are judged alike, and an empty benchmark takes nothing away.
    """
    prepare(spark)
    return tiling.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix by source weights takes them.

    Rows without words are not taken; a null source is a source. Rows alike in id, text and source share their copies evenly.
    """
    prepare(spark)
    return mixing.mix_rows(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard, in added columns; a null text has no bytes, and rows alike in id and text share a shard."""
    prepare(spark)
    return sharding.assign(docs)


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", mixture),
    ("sharding", shards),
]

#: Trained models, tiles and components have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them the rows rest in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
