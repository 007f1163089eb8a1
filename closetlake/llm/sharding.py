"""Sharding by extendible hashing.

A document's key is a 64-bit hash of its id and text. The directory is indexed by
the leading bits of the key; a bucket is named by its bits. All rows start in one
bucket of no bits, and only buckets above the byte limit split on one more bit,
until each fits. The directory is built from byte totals per cell (a cell holds
``CELL_BITS`` more bits than an even split would need), so documents are read
once and only cells are handled level by level; cells that a level's bits do not
separate are cut finer from the keys. A row larger than the limit, and rows equal
in id and text, cannot be separated and stay alone in an ``oversized`` shard.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closetlake.llm.common import hidden, prepare, stored, table

SHARD_BYTES = 64 * 1024 * 1024
CELL_BITS = 4
KEY_BITS = 60


def key_bits() -> Column:
    """The key as a text of ``KEY_BITS`` zeros and ones."""
    h = F.xxhash64("doc_id", "text")
    return F.substring(F.lpad(F.bin(h), 64, "0"), 5, KEY_BITS)


def text_bytes() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """Leaves of the directory: ``cell`` (leading bits, enough to find the leaf), ``shard``, ``shard_bytes``, ``shard_rows``.

    ``rows`` holds ``key`` and ``bytes``. Leaves of different depth have cells of
    different length, so cells come with their length ``cell_bits``.
    """
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    even = max(0, math.ceil(math.log2(max(1.0, total / limit))))
    leaves, prefix, depth, open_rows = [], "", 0, rows
    bits = min(KEY_BITS, even + CELL_BITS)
    while True:
        cells = open_rows.groupBy(F.substring("key", 1, bits).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        cells = stored(cells)
        done, stuck, depth = _split(cells, limit, depth, bits)
        leaves.extend(leaf.withColumn("cell_bits", F.lit(bits)) for leaf in done)
        if stuck is None:
            break
        if bits >= KEY_BITS:
            leaves.append(stuck.withColumn("cell_bits", F.lit(bits)))
            break
        # The buckets that even the whole cell does not separate: cut their rows finer.
        open_rows = stored(open_rows.join(stuck.select(F.col("cell").alias("_cell")), F.substring("key", 1, bits) == F.col("_cell"), "left_semi"))
        bits = min(KEY_BITS, bits + CELL_BITS)
    return reduce(DataFrame.unionByName, leaves)


def _split(cells: DataFrame, limit: int, depth: int, bits: int) -> tuple[list[DataFrame], DataFrame | None, int]:
    """Split level by level; the leaves found, and the cells that are too large as a whole."""
    found, rest = [], cells
    for d in range(depth, bits + 1):
        sums = rest.groupBy(F.substring("cell", 1, d).alias("shard")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)
        named = rest.withColumn("shard", F.substring("cell", 1, d)).join(sums, "shard")
        named = stored(named)
        found.append(named.filter(fits).select("cell", "shard", "shard_bytes", "shard_rows"))
        large = named.filter(~fits)
        if large.isEmpty():
            return found, None, d
        if d == bits:
            return found, large.select("cell", "shard", "shard_bytes", "shard_rows"), d + 1
        rest = large.select("cell", "bytes", "n")
    return found, None, bits


def assign(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """Add ``shard`` (its bits; empty for a single shard), ``shard_bytes``, ``shard_rows`` and ``oversized``.

    A null text has 0 bytes; null ids and empty tables need nothing special. Columns of these names in ``docs`` are
    replaced, all others stay. Rows that are equal in id and text share all bits and so a shard, which is ``oversized``
    where they exceed the limit together.
    """
    added = ["shard", "shard_bytes", "shard_rows", "oversized"]
    docs = docs.drop(*added)
    rows = stored(docs.select(key_bits().alias("key"), text_bytes().alias("bytes")))
    leaves = stored(directory(rows, limit))
    depths = sorted(r[0] for r in leaves.select("cell_bits").distinct().collect())
    key, cell = hidden(docs, "key", "cell")
    keyed = docs.withColumn(key, key_bits())
    parts = [
        keyed.join(
            leaves.filter(F.col("cell_bits") == bits).drop("cell_bits").withColumnRenamed("cell", cell),
            F.substring(key, 1, bits) == F.col(cell),
        ) for bits in depths
    ]
    if not parts:
        return docs.select("*", F.lit("").alias("shard"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).cast("long").alias("shard_rows"), F.lit(False).alias("oversized"))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("oversized", F.col("shard_bytes") > limit).select(*docs.columns, *added)


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> None:
    """Write ``docs`` with one folder per shard."""
    assign(docs, limit).repartition("shard").write.partitionBy("shard").parquet(path)


def op9_sharding(spark, sf_dir):
    """The shard of every document."""
    docs = table(prepare(spark), sf_dir, "documents")
    sized = docs.select("doc_id", "text", text_bytes().alias("bytes"))
    return assign(sized).select("doc_id", "bytes", "shard", "shard_bytes", "shard_rows", "oversized")
