"""Pages of ordered listings by rank selection.

Rows are counted per bucket of the first order column (a day of an instant). Running counts name
the few buckets that hold a page, and only they are looked at again: as long as they hold
more than ``MOST_ROWS`` rows, they are cut into finer buckets, down to single values, and single values
by the next order column, a number by its range and a text by its beginning. Only the rows that
are left are ordered, so no task orders more than ``MOST_ROWS`` rows even if all rows share
an instant, and a listing is read once for the counts and once for the rows of a
page in all but such cases.

Counts can be kept (``bucket_counts``) and given to each page of a listing. Unlike the other
operators these run small jobs when they are called, as what is read depends on counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_ROWS = 10_000
#: Buckets a stretch is cut into.
SPLITS = 1024
DAY = 86_400_000_000


def bucket_counts(df: DataFrame, first: Column, width: int = DAY, origin: int = 0) -> DataFrame:
    """``bucket``, ``n`` and the smallest and largest value (``low``, ``high``) of a whole number, by stretches of ``width``."""
    keyed = df.select(first.cast("bigint").alias("key"))
    bucket = F.floor((F.col("key") - origin) / width).cast("bigint")
    return keyed.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))


def _prefix_counts(df: DataFrame, key: Column, length: int) -> DataFrame:
    keyed = df.select(key.alias("key"))
    return keyed.groupBy(F.substring("key", 1, length).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))


@dataclass
class Stretch:
    """Rows of a bucket: values from ``low`` to ``high``, and how many rows there are and stand before."""

    low: object
    high: object
    n: int
    start: int


def _holding(counts: DataFrame, first: Column, last: Column, start: int = 0) -> tuple[list[Stretch], int]:
    """The buckets with rows ranked ``first`` to ``last`` (from 0, the last one excluded), and the number of all rows.

    ``first`` and ``last`` may use ``total``. One row per bucket reaches the window; the buckets found are
    no more than the ranks and two.
    """
    upto = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    counted = counts.withColumn("end", upto + start).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))
    found = counted.filter((F.col("end") > first) & (F.col("end") - F.col("n") < last)).orderBy("bucket").collect()
    return [Stretch(r["low"], r["high"], r["n"], r["end"] - r["n"]) for r in found], found[0]["total"] if found else 0


def _common(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _within(df: DataFrame, order: list[Column], found: list[Stretch], first: int, last: int, text: bool) -> tuple[Column, int]:
    """A condition on ``order`` for the rows ranked ``first`` to ``last`` and few others, and the rank of the first row it keeps.

    ``found`` are the stretches of the first order column that hold them.
    """
    key = F.coalesce(order[0], F.lit("")) if text else order[0].cast("bigint")
    length = 0
    while sum(s.n for s in found) > MOST_ROWS and any(s.low != s.high for s in found):
        low, high = found[0].low, found[-1].high
        inside = df.filter(key.between(F.lit(low), F.lit(high)))
        if text:
            length = max(length, _common(low, high)) + 2
            counts = _prefix_counts(inside, key, length)
        else:
            counts = bucket_counts(inside, key, max(1, (high - low + 1) // SPLITS), low)
        found = _holding(counts, F.lit(first), F.lit(last), found[0].start)[0]
    start, kept = found[0].start, F.lit(False)
    for k, s in enumerate(found):
        one = key.between(F.lit(s.low), F.lit(s.high))
        if s.n > MOST_ROWS and len(order) > 1:  # one value; of the next column only a part is needed
            own = df.filter(one)
            more, before = _from_start(own, order[1:], max(0, first - s.start), min(s.n, last - s.start))
            one = one & more
            start = start + before if k == 0 else start
        kept = kept | one
    return kept, start


def _from_start(df: DataFrame, order: list[Column], first: int, last: int) -> tuple[Column, int]:
    text = dict(df.select(order[0].alias("key")).dtypes)["key"] == "string"
    counts = _prefix_counts(df, F.coalesce(order[0], F.lit("")), 1) if text else bucket_counts(df, order[0])
    found, _ = _holding(counts, F.lit(first), F.lit(last))
    return _within(df, order, found, first, last, text)


def page(df: DataFrame, order: list[Column], number: int, size: int, counts: DataFrame | None = None) -> DataFrame:
    """One page of an ordered listing, with ``row_no`` (from 1), ``page``, ``page_count`` and ``total_rows``.

    A page beyond the end shows the last one; without rows the page is empty. The first order column must be a
    whole number (instants as microseconds), further ones whole numbers or texts, ascending, and together
    unique. ``counts`` are the listing's ``bucket_counts`` by the first order column, if they are kept.
    """
    counts = bucket_counts(df, order[0]) if counts is None else counts
    pages = F.ceil(F.col("total") / size).cast("bigint")
    shown = F.least(F.lit(max(1, number)).cast("bigint"), pages)
    found, total = _holding(counts, (shown - 1) * size, shown * size)
    page_count = -(-total // size)
    at = min(max(1, number), page_count)
    named = {"total_rows": total, "page_count": page_count, "page": at}
    if found:
        kept, start = _within(df, order, found, (at - 1) * size, min(at * size, total), False)
        rows, first, last = df.filter(kept), (at - 1) * size - start, at * size - start
    else:
        rows, first, last, start = df.filter(F.lit(False)), 0, 0, 0
    # At most MOST_ROWS rows, or those before the page among rows that no order column tells apart.
    ranked = rows.orderBy(*order).limit(max(1, last)).withColumn("row_no", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    ranked = ranked.filter((F.col("row_no") > first) & (F.col("row_no") <= last)).withColumn("row_no", F.col("row_no") + F.lit(start))
    return ranked.withColumns({k: F.lit(v).cast("bigint") for k, v in named.items()})
