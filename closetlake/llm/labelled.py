"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from closetlake.llm.common import sample_order


def per_class(rows: DataFrame, key: str, most: int, classes: int = 256) -> DataFrame:
    """Up to ``most`` rows of each of the ``classes`` most frequent values of ``key``, in a fixed pseudo-random order of ids.

    ``rows`` holds an id once in each class.

    The rows of a large class are first thinned by their hash to about three times
    ``most``, so that ranking them needs few rows however large the class is.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).orderBy(F.desc("_rows"), key).limit(classes)
    order = sample_order("doc_id")
    place = F.shiftrightunsigned(order[0], 11) / F.lit(float(1 << 53))
    thin = rows.join(F.broadcast(counts), key).filter(place * F.col("_rows") < F.lit(3 * most))
    ranked = thin.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter(F.col("_n") <= most).drop("_n", "_rows")


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[DataFrame, float]:
    """``doc_id``, ``text``, ``label`` of up to ``most`` documents with label 0 and as many with 1, and the share of 1 among all labels.

    Null labels and ids are left out; a document with both labels counts as
    labelled with the larger, and of rows with one id that with the smallest hash is taken.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    share = known.agg(F.avg("label")).first()[0]
    # Two times ``most`` rows of an id and a label at most: a bounded side.
    chosen = F.broadcast(per_class(known, "label", most))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(
        F.min_by("text", F.coalesce(F.md5("text"), F.lit(""))).alias("text"), F.max("label").alias("label"))
    return rows, 0.5 if share is None else float(share)
