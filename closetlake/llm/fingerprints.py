"""Document fingerprints by one-permutation MinHash, in Spark expressions only.

Each shingle (``SHINGLE`` words) is hashed once; the hash's top bits name one of
``BINS`` bins and each bin keeps its smallest hash. An empty bin takes the value of
the full bin that comes first in its own fixed random order of bins (optimal
densification, tries being independent for each bin). Of each value the low
``LOW_BITS`` bits are stored, as two hex digits per bin. Two fingerprints agree in
a bin by chance with probability 2^-``LOW_BITS``, which the likeness corrects.

A text with fewer words is one shingle; a text without words has an empty
fingerprint, alike only to other empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from closetlake.llm.common import prepare, table

BINS, SHINGLE = 128, 5
BIN_BITS, LOW_BITS = 7, 8
#: Characters of text that an ordered bucket holds on average.
BUCKET_CHARS = 4_000_000
#: More text than fits so many buckets makes them larger (a sort spills), not more.
MOST_BUCKETS = 10_000


def _word_hashes(text: Column) -> Column:
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingle_hashes(h: Column) -> Column:
    """Hashes of the runs of words, ``h`` being the word hashes; one for a shorter text, none for no words."""
    def at(i, k):
        return F.get(h, i + k)

    n = F.size(h)
    runs = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[at(i, k) for k in range(SHINGLE)]))
    whole = F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " ")))
    return F.when(n >= SHINGLE, runs).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS).cast("int")


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the fingerprint of column ``text`` as column ``name``; a null text counts as empty."""
    df = df.withColumn("_words", _word_hashes(F.coalesce(F.col(text), F.lit(""))))
    # In sorted order the first hash of each bin is its smallest. (Signed order only moves the upper half of the bins.)
    df = df.withColumn("_hashes", F.sort_array(_shingle_hashes(F.col("_words"))))
    hashes = F.col("_hashes")
    df = df.withColumn("_full", F.filter(hashes, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(hashes, i - 1)))))
    df = df.withColumn("_full", F.map_from_arrays(F.transform("_full", _bin), F.col("_full")))
    bins = F.map_keys("_full")

    def value(b):
        own = F.element_at("_full", b)
        lent = F.array_min(F.transform(bins, lambda c: F.struct(F.xxhash64(F.lit("densify"), b, c).alias("o"), c.alias("c"))))
        return F.coalesce(own, F.element_at("_full", lent["c"]))

    low = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.lpad(F.hex(value(b).bitwiseAND(2**LOW_BITS - 1)), 2, "0"))
    printed = F.when(F.size(bins) > 0, F.lower(F.array_join(low, ""))).otherwise("")
    return df.withColumn(name, printed).drop("_words", "_hashes", "_full")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity from two fingerprints; empty ones are alike, and unlike all others."""
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(2 * BINS - 1), F.lit(2)), lambda i: F.substr(a, i, F.lit(2)) == F.substr(b, i, F.lit(2))))
    chance = 2.0 ** -LOW_BITS
    corrected = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(corrected)


def in_order(docs: DataFrame, carried: list[str]) -> DataFrame:
    """Give each row the ``carried`` columns of the next one, by descending doc_id (null last), then by text.

    After the last comes the first. Rows are cut into buckets at quantiles of the id, so
    order is only made within a bucket; the first row of each bucket also goes, as
    a guest, to the bucket before, so that no bucket waits for another.
    """
    ids = docs.agg(F.sum(F.length("text")).alias("chars"), F.max("doc_id").alias("top")).first()
    n = min(MOST_BUCKETS, max(1, -(-(ids["chars"] or 0) // BUCKET_CHARS)))
    cuts = [k / n for k in range(n, 0, -1)]
    found = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(c) for c in cuts]), F.lit(20 * n))).first()[0] if n > 1 else None
    starts = sorted({ids["top"], *(found or [])} - {None}, reverse=True) or [None]
    listed = F.split(F.lit(",".join(str(s) for s in starts)), ",").cast("array<bigint>")
    first = listed if starts != [None] else F.array(F.lit(None).cast("long"))
    steps = max(1, (len(starts) - 1).bit_length())

    def search(low, k):
        """Doubling steps down: the last bucket whose first id is not below the row's."""
        ahead = low + F.element_at(F.array(*[F.lit(1 << (steps - 1 - i)) for i in range(steps)]), k)
        return F.when((ahead < len(starts)) & (F.get(first, ahead) >= F.col("doc_id")), ahead).otherwise(low)

    own = F.when(F.col("doc_id").isNull(), len(starts) - 1).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0), search))
    rows = docs.withColumn("_bucket", own)
    opens = F.coalesce(F.col("doc_id") == F.get(first, F.col("_bucket")), F.lit(starts == [None]))
    # Guests of the first bucket close the last one: they come after everything there, ids lower or null.
    guest = F.when(F.col("_bucket") > 0, F.col("_bucket") - 1).otherwise(len(starts) - 1)
    places = F.when(opens, F.array(
        F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("guest")), F.struct(guest.alias("bucket"), F.lit(1).alias("guest")),
    )).otherwise(F.array(F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("guest"))))
    rows = rows.withColumn("_place", F.explode(places)).select("*", "_place.*").drop("_place", "_bucket")
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    return rows.filter("guest = 0").drop("bucket", "guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_chars``, ``fingerprint`` of every row, the same of its edited text, and its likeness to that and to the next row.

    The edited text has its last half (rounded down, in code points) replaced by as
    many of the next document's first. Null texts count as empty.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = in_order(with_fingerprint(rows, "text", "fingerprint"), ["text", "fingerprint"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substr(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_sha256", F.sha2("edited", 256))
    rows = with_fingerprint(rows, "edited", "edited_fingerprint")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def op8_fingerprints(spark, sf_dir):
    """Fingerprints of every document and of its edited text."""
    return fingerprints(table(prepare(spark), sf_dir, "documents"))
