"""A trigram index for searches that look for a text anywhere in another.

Postings hold, for each run of three characters, the keys of the texts that contain it, in lists of bounded length. A
text can only contain a needle if it has all of the needle's trigrams, so postings of a few, the rarest
ones, name the candidates; only these texts are read and tested. The result is exact, whatever the
needle: one of fewer than three characters names no candidates and all texts are tested.

Stored, postings are partitioned by trigram and texts by key, so a search reads the partitions of its trigrams and of
its candidates. New texts are appended; a posting of a text that has changed or gone only names a
candidate in vain, a changed text is appended anew.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closetlake.functions.text import strip

GRAM = 3
#: Partitions of postings and of texts, keys of a list, trigrams looked up for a needle, candidates that are broadcast.
BUCKETS, LIST_KEYS, LOOKED_UP, MOST_BROADCAST = 256, 65_536, 4, 1_000_000


def bucket(c, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(buckets)).cast("int")


def postings(texts: DataFrame, key: str, text: str, rows: int, buckets: int = BUCKETS) -> DataFrame:
    """``bucket``, ``gram``, ``keys`` and ``n`` (their number) for the trigrams of each text in lower case; null texts have none.

    ``rows`` is about how many texts there are: lists of a trigram are dealt into pieces of about ``LIST_KEYS`` keys by it.
    """
    pieces = max(1, -(-rows // LIST_KEYS))
    grams = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(.{%d}))" % GRAM), F.lit(1)))
    found = texts.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.explode(grams).alias("gram"))
    piece = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("piece")), F.lit(pieces))
    lists = found.groupBy("gram", piece.alias("piece")).agg(F.collect_set("key").alias("keys"))
    return lists.select(bucket("gram", buckets).alias("bucket"), "gram", F.sort_array("keys").alias("keys"), F.size("keys").cast("bigint").alias("n"))


def append_to_index(texts: DataFrame, path: str, key: str, text: str, rows: int) -> None:
    """Add texts to the index at ``path``: their postings, and the texts themselves by key."""
    found = postings(texts, key, text, rows)
    found.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")
    dealt = texts.withColumn("part", bucket(key, BUCKETS))
    dealt.repartition("part").sortWithinPartitions("part", key).write.mode("append").partitionBy("part").parquet(f"{path}/texts")


def needle(spark, query: str) -> str:
    """The query as texts are compared with it: without blanks around it, in lower case."""
    return spark.range(1).select(F.lower(strip(F.lit(query))).alias("q")).first()["q"]


def _grams(wanted: str) -> list[str]:
    return sorted({wanted[k: k + GRAM] for k in range(len(wanted) - GRAM + 1)})


def _of(index: DataFrame, grams: list[str]) -> DataFrame:
    """Postings of some trigrams; the buckets they are in are named, so other partitions are not read."""
    spark = index.sparkSession
    numbers = spark.createDataFrame([(g,) for g in grams], "gram string").select(bucket("gram", BUCKETS).alias("b")).distinct().collect()
    # The trigram first: where postings are made for this search, few rows are left to find the bucket of.
    return index.filter(F.col("gram").isin(grams) & F.col("bucket").isin([r["b"] for r in numbers]))


def candidates_of_all(index: DataFrame, words: list[list[str]]) -> DataFrame | None:
    """``key`` of the texts that may contain, for each word, one of its texts (in lower case); None if all may.

    The postings of the words' trigrams are read once and passed over twice: one pass counts them, the other
    looks up the rarest ``LOOKED_UP`` of each text and tests which of them a key has.
    """
    # A short text tells nothing, so neither does its word.
    tested = [texts for texts in words if all(len(x) >= GRAM for x in texts)]
    if not tested:
        return None
    grams = sorted({g for texts in tested for x in texts for g in _grams(x)})
    # Kept on the executors' disks: an index that is made for this search is made once.
    read = _of(index, grams).select("gram", "keys", "n").localCheckpoint(storageLevel=StorageLevel.DISK_ONLY)
    n = {r["gram"]: r["n"] for r in read.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    wanted = [[sorted(_grams(x), key=lambda g: (n.get(g, 0), g))[:LOOKED_UP] for x in texts] for texts in tested]
    used = sorted({g for texts in wanted for few in texts for g in few})
    # As many entries for a key as the query has trigrams at most.
    held = read.filter(F.col("gram").isin(used)).select("gram", F.explode("keys").alias("key")).groupBy("key").agg(F.collect_set("gram").alias("grams"))
    has = lambda few: reduce(lambda a, b: a & b, [F.array_contains("grams", g) for g in few])
    every = reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [has(few) for few in texts]) for texts in wanted])
    return held.filter(every).select("key")


def candidates(index: DataFrame, wanted: str) -> DataFrame | None:
    """``key`` of the texts that may contain a needle (in lower case); None if all may."""
    return candidates_of_all(index, [[wanted]])


def search(texts: DataFrame, index: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """The rows of ``texts`` whose ``text`` contains the query, in any case; an empty query shows all with a text."""
    wanted = needle(texts.sparkSession, query)
    found = of_candidates(texts, candidates(index, wanted), key)
    return found.filter(F.contains(F.lower(text), F.lit(wanted)))


def of_candidates(texts: DataFrame, keys: DataFrame | None, key: str) -> DataFrame:
    """The rows of some keys. Where texts are stored in parts, only the parts of these keys are read; candidates are counted here."""
    if keys is None:
        return texts
    named = keys.withColumnRenamed("key", key)
    if "part" in texts.columns:
        parts = [r["b"] for r in keys.select(bucket("key", BUCKETS).alias("b")).distinct().collect()]
        texts = texts.filter(F.col("part").isin(parts))
    return texts.join(F.broadcast(named) if named.count() <= MOST_BROADCAST else named, key, "left_semi")
