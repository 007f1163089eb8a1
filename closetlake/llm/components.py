"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closetlake.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (smallest node reachable) for every node of the links ``a``, ``b``.

    Each round takes the smallest label of the neighbours and then the label of that
    label, so chains shorten by more than half; minima are combined before the
    shuffle, so a node with very many links is no heavier than others. Every
    round is written to the shared folder.
    """
    ends = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = ends.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("best"))
        beyond = labels.select(F.col("node").alias("best"), F.col("label").alias("beyond"))
        after = stored(step.join(beyond, "best").select("node", "label", F.least("best", "beyond").alias("now")))
        moved = not after.filter(F.col("now") < F.col("label")).isEmpty()
        labels = after.select("node", F.col("now").alias("label"))
        if not moved:
            return labels
