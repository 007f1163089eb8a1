"""Building blocks shared by the operators.

Orders always end in a unique id, so results do not depend on how rows are
spread. A first row per key is found with ``min`` over a struct, which combines
on the map side; a top-k per key uses ``row_number`` with a literal bound, which
Spark cuts to k rows per key before the shuffle. Both keep a key that owns a
large part of all rows from being gathered in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from closetlake.functions.values import col


def newest_first(ts) -> Column:
    """Ascending sort value that puts the newest instant first, missing last."""
    return -F.coalesce(F.unix_micros(col(ts).cast("timestamp")), F.lit(0))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key, numbered from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], fields: list[str]) -> DataFrame:
    """One row per key: the fields of the row that is smallest by ``order``."""
    packed = F.struct(
        *[o.alias(f"o{i}") for i, o in enumerate(order)],
        F.struct(*[F.col(f) for f in fields]).alias("row"),
    )
    best = df.groupBy(*keys).agg(F.min(packed).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.row.{f}").alias(f) for f in fields])


def exploded(df: DataFrame, keep: list[str], array, pos: str, value: str) -> DataFrame:
    """One row per list entry with its position.

    An inner explode would make Spark also filter on the list being non-empty,
    below the projection, and so compute a costly list (parsed JSON, built
    combinations) a second time; the outer form with a filter above does not.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, value))
    return rows.filter(F.col(pos).isNotNull())


def left_all(base: DataFrame, parts: list[DataFrame], key: str = "user_id") -> DataFrame:
    """Left join of per-key results that each hold a key at most once."""
    return reduce(lambda acc, part: acc.join(part, key, "left"), parts, base)


def zero_filled(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.fillna(0, subset=columns)


def flag_first(df: DataFrame, key: str, order: list[str], flag: str) -> DataFrame:
    """Mark the first row of each key by ``order`` (unique columns within the key).

    The first row is aggregated and joined back rather than found by a window, so
    a key with very many rows is split by the skew join instead of sorted as one.
    """
    first = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_first_row"))
    joined = df.join(first, key, "left")
    return joined.withColumn(flag, F.coalesce(F.struct(*order) == F.col("_first_row"), F.lit(False))).drop("_first_row")


# A filter of 4 MB: among 5 million keys it lets some 8 % of the others through.
FILTER_WORDS = 1 << 19
FILTERED_TYPES = ("int", "bigint", "string")


def _filter_bits(key) -> tuple[Column, Column]:
    """The word of a key in a filter, and the two bits of it that the key sets."""
    h = F.xxhash64(col(key).cast("string"))
    one = F.lit(1).cast("bigint")
    bit = lambda by: F.call_function("shiftleft", one, F.shiftrightunsigned(h, by).bitwiseAND(63).cast("int"))
    return F.shiftrightunsigned(h, 12).bitwiseAND(FILTER_WORDS - 1).cast("int"), bit(0).bitwiseOR(bit(6))


def maybe_among(df: DataFrame, key: str, others: DataFrame, other: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be met in ``others``; all that are met stay, few others do.

    A Bloom filter of bounded size, as a scalar subquery: unlike a join, the test
    reaches the scans below ``df``, so that rows are dropped before its shuffles.
    """
    types = {dict(df.dtypes)[key], dict(others.dtypes)[other]}
    if len(types) > 1 or not types <= set(FILTERED_TYPES):
        return df  # equal keys of other types may have different texts
    word, bits = _filter_bits(other)
    words = others.filter(F.col(other).isNotNull()).select(word.alias("word"), bits.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    every = df.sparkSession.range(0, FILTER_WORDS, 1, 1).select(F.col("id").cast("int").alias("word")).join(words, "word", "left")
    held = every.agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")))).alias("held"))
    word, wanted = _filter_bits(key)
    return df.filter(F.get(held.select("held.bits").scalar(), word).bitwiseAND(wanted) == wanted)
