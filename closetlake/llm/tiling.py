"""Benchmark decontamination by greedy string tiling.

Test items and documents are read as words (letters and digits, lower case). Seeds are
runs of ``MIN_MATCH`` words; a text and an item that share seeds are a candidate pair. For a
pair, the longest run of words that both have and that no tile covers yet is marked as
a tile, again and again, down to runs of ``MIN_MATCH`` words. The share of the item's
words that tiles cover decides, so passages whose parts were put in another order still count.

Runs are found by running Karp-Rabin hashes with a search length that adapts: it starts at the
longest unmarked stretch and is halved and narrowed to the longest length with a match, so
lengths without a match cost no pass.

Items stay in Spark tables. Seeds of items set bits in a filter of bounded size, which
all tasks get; a text keeps the stretches whose seeds pass it, and nothing of ordinary
text passes. Their seeds are joined with those of the items, pairs are counted, and pairs
that share too few seeds go; the others are tiled. Equal texts are handled once.
Items shorter than ``MIN_MATCH`` words are one seed as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closetlake.llm.common import hidden, prepare, sized_broadcast, stored, table
from closetlake.llm.hashing import mix, powers, slices, word_hashes

MIN_MATCH = 5
THRESHOLD = 0.6
#: 64-bit words of the filter: 8 MB.
FILTER_WORDS = 1 << 20
#: Characters read at a time.
SLICE = 400_000
_WORD = re.compile(r"\w+")
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class _Runs:
    """Karp-Rabin hashes of the runs of any length of some numbers, and which runs are unmarked."""

    def __init__(self, ids: np.ndarray, free: np.ndarray):
        self.ids, self.free = ids, free
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((mix(ids.view(np.uint64)) | np.uint64(1)) * powers(_INVERSE, len(ids)), dtype=np.uint64)])
        self.powers = powers(_BASE, len(ids))

    def longest(self) -> int:
        """Length of the longest unmarked stretch."""
        marked = np.flatnonzero(~self.free)
        return int(np.diff(np.concatenate([[-1], marked, [len(self.free)]])).max()) - 1

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the unmarked runs of ``size``."""
        known = np.concatenate([[0], np.cumsum(self.free)])
        starts = np.flatnonzero(known[size:] - known[:-size] == size)
        with np.errstate(over="ignore"):
            return starts, (self.sums[starts + size] - self.sums[starts]) * self.powers[starts]


def tiles(item: np.ndarray, doc: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in the item, start in the document, length), longest first.

    Both are arrays of word numbers (int64); 0 in ``doc`` is a word no item has. Ties go to the
    smallest start in the item, then in the document. Of equal runs in the
    document the first free one is taken, so a passage repeated in the document
    is not tried again for each copy.
    """
    item, doc = np.asarray(item, dtype=np.int64), np.asarray(doc, dtype=np.int64)
    ours, theirs = _Runs(item, np.ones(len(item), dtype=bool)), _Runs(doc, doc != 0)
    found: list[tuple[int, int, int]] = []
    least = max(1, min(least, len(item)))

    def met(size):
        """Starts of the unmarked runs of ``size`` that both have."""
        (a, a_hash), (b, b_hash) = ours.of(size), theirs.of(size)
        both = np.intersect1d(a_hash, b_hash)
        return a[(at := np.isin(a_hash, both))], a_hash[at], b[(at := np.isin(b_hash, both))], b_hash[at]

    most = len(item)
    while (most := min(most, ours.longest(), theirs.longest())) >= least:
        # A run of some length holds runs of all lesser lengths, so the longest is found by halving.
        low, high, best = least, most, None
        while low <= high:
            size = (low + high + 1) // 2
            starts = met(size)
            if len(starts[0]):
                low, best = size + 1, (size, starts)
            else:
                high = size - 1
        if best is None:
            break
        size, (a, a_hash, b, b_hash) = best
        places: dict[int, list[int]] = {}
        for j, h in zip(b.tolist(), b_hash.tolist(), strict=True):
            places.setdefault(h, []).append(j)
        options = {h: iter(js) for h, js in places.items()}
        for i, h in zip(a.tolist(), a_hash.tolist(), strict=True):
            if not ours.free[i: i + size].all():
                continue
            for j in options[h]:
                if theirs.free[j: j + size].all() and (doc[j: j + size] == item[i: i + size]).all():
                    ours.free[i: i + size] = theirs.free[j: j + size] = False
                    found.append((i, j, size))
                    break
        most = size - 1
    return found


def _seeds(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` word hashes."""
    n = len(ids) - size + 1
    with np.errstate(over="ignore"):
        out = np.full(max(0, n), size, dtype=np.uint64)
        for k in range(size if n > 0 else 0):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + ids[k: k + n])
        return out.view(np.int64)


def _numbers(texts: list) -> Iterator[np.ndarray]:
    """The word hashes of each text, none of them 0."""
    for part in slices(texts, SLICE):
        found = [" ".join(words_of(t)) for t in texts[part.start: part.stop]]
        hashes, places = word_hashes(found, bytes(range(256)))
        hashes[hashes == 0] = 1
        yield from (hashes[a:b] for a, b in zip(places[:-1], places[1:], strict=True))


def items_of(benchmark: DataFrame) -> DataFrame:
    """``item`` (a key), ``item_id``, ``words`` (hashes) of each different item with words, stored."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [w.view(np.int64) for w in _numbers(list(batch["text"]))]
            yield pd.DataFrame({"item": batch["item"], "item_id": batch["item_id"].astype("Int64"), "words": words})[[len(w) > 0 for w in words]]

    rows = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text"))
    return stored(rows.withColumn("item", key).mapInPandas(read, "item string, item_id long, words array<long>"))


def seeds_of(items: DataFrame) -> DataFrame:
    """``seed``, ``item``, ``n_words``, ``many`` (places of the seed in the item), stored."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, words in zip(batch["item"], batch["words"], strict=True):
                seed, many = np.unique(_seeds(words.view(np.uint64), min(len(words), MIN_MATCH)), return_counts=True)
                yield pd.DataFrame({"seed": seed, "item": item, "n_words": np.int32(len(words)), "many": many.astype(np.int32)})

    return stored(items.select("item", "words").mapInPandas(read, "seed long, item string, n_words int, many int"))


def filter_of(seeds: DataFrame) -> np.ndarray:
    """A filter of ``FILTER_WORDS`` 64-bit words in which each seed has set two bits of one."""
    one = F.lit(1).cast("long")
    seed = F.col("seed")
    word = F.shiftrightunsigned(seed, 12).bitwiseAND(FILTER_WORDS - 1)
    bits = F.call_function("shiftleft", one, seed.bitwiseAND(63).cast("int")).bitwiseOR(
        F.call_function("shiftleft", one, F.shiftrightunsigned(seed, 6).bitwiseAND(63).cast("int")))
    found = seeds.select(word.alias("word"), bits.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_WORDS, dtype=np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def passes(seeds: np.ndarray, bits: np.ndarray) -> np.ndarray:
    x = seeds.view(np.uint64)
    want = (np.uint64(1) << (x & np.uint64(63))) | (np.uint64(1) << ((x >> np.uint64(6)) & np.uint64(63)))
    return bits[(x >> np.uint64(12)) & np.uint64(len(bits) - 1)] & want == want


def stretches(docs: DataFrame, bits: np.ndarray, short: list[int]) -> DataFrame:
    """``key`` (of the text), ``seeds``, ``words`` and ``places`` of the stretches whose seeds pass the filter.

    Stretches are in order, apart by a 0; a text without such seeds gives no row. Equal texts give one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, ids in zip(batch["text"], _numbers(list(batch["text"])), strict=True):
                kept, seeds = np.zeros(len(ids) + 1, dtype=np.int32), []
                for size in (*short, MIN_MATCH):
                    if len(ids) < size:
                        continue
                    found = _seeds(ids, size)
                    at = np.flatnonzero(passes(found, shared.value))
                    seeds.append(found[at])
                    np.add.at(kept, at, 1)
                    np.add.at(kept, at + size, -1)
                if not sum(map(len, seeds)):
                    continue
                inside = np.cumsum(kept[:-1]) > 0
                place = np.flatnonzero(inside)
                # A break before each place that does not follow the one before.
                gaps = np.flatnonzero(np.diff(place) > 1) + 1
                out.append((
                    hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest(), np.unique(np.concatenate(seeds)),
                    np.insert(ids[place].view(np.int64), gaps, 0), np.insert(place, gaps, -1).astype(np.int32)))
            if out:
                yield pd.DataFrame(out, columns=["key", "seeds", "words", "places"])

    found = docs.filter(F.col("text").isNotNull()).select("text").mapInPandas(read, "key string, seeds array<long>, words array<long>, places array<int>")
    return stored(found.dropDuplicates(["key"]))


_ADDED = {
    "item_id": "long", "item_words": "int", "covered_words": "int", "coverage": "double", "n_tiles": "int",
    "reordered": "boolean", "spans": "array<struct<first:int,last:int>>",
}


def _tiled(item: np.ndarray, words: np.ndarray, places: np.ndarray, threshold: float) -> dict | None:
    if np.count_nonzero(words) < threshold * len(item):
        return None  # tiles lie in the stretches, so they cover less still
    marked = tiles(item, words)
    covered = sum(n for _, _, n in marked)
    if covered < threshold * len(item):
        return None
    by_item = [j for _, j, _ in sorted(marked)]
    return {
        "item_words": len(item), "covered_words": covered, "coverage": covered / len(item), "n_tiles": len(marked), "reordered": by_item != sorted(by_item),
        "spans": [{"first": int(places[j]), "last": int(places[j + n - 1])} for _, j, n in sorted(marked, key=lambda m: m[1])],
    }


def matched_texts(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``key`` (md5 of the text) and the figures of each different text and item that it covers to ``threshold``, stored."""
    items = items_of(benchmark)
    seeds = seeds_of(items)
    short = [r[0] for r in items.select(F.size("words").alias("n")).filter(F.col("n") < MIN_MATCH).distinct().orderBy("n").collect()]
    parts = stretches(docs, filter_of(seeds), short)
    met = parts.select("key", F.explode("seeds").alias("seed")).join(sized_broadcast(seeds), "seed")
    pairs = met.groupBy("key", "item").agg(F.sum("many").alias("shared"), F.max("n_words").alias("n_words"))
    # A seed covers as many words of the item as it has, at each of its places.
    pairs = pairs.filter(F.col("shared") * F.least(F.lit(MIN_MATCH), F.col("n_words")) >= F.lit(threshold) * F.col("n_words")).select("key", "item")
    fields = ",".join(f"{k}:{v}" for k, v in _ADDED.items() if k != "item_id")

    @F.pandas_udf(f"struct<{fields}>")
    def tile(item: pd.Series, words: pd.Series, places: pd.Series) -> pd.DataFrame:
        rows = [_tiled(*x, threshold) or dict.fromkeys(k for k in _ADDED if k != "item_id") for x in zip(item, words, places, strict=True)]
        return pd.DataFrame(rows, columns=[k for k in _ADDED if k != "item_id"]).astype({"item_words": "Int32", "covered_words": "Int32", "n_tiles": "Int32"})

    rows = pairs.join(parts.select("key", "words", "places"), "key").join(items.select("item", "item_id", F.col("words").alias("item_words")), "item")
    found = rows.select("key", "item_id", tile("item_words", "words", "places").alias("tiled"))
    return stored(found.filter(F.col("tiled.item_words").isNotNull()).select("key", "item_id", "tiled.*"))


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row and item whose words the document covers to ``threshold`` at least.

    Gives the columns of ``docs`` but ``text``, and ``item_id``, ``item_words``,
    ``covered_words``, ``coverage``, ``n_tiles``, ``reordered`` (tiles stand in another
    order than in the item) and ``spans`` (first and last word of each tile in the
    document, from 0). Null and wordless texts and items match nothing, an empty table of either gives no row. Repeated
    rows and ids of documents each give their rows; items that are equal in id and text count once, others of the
    same id each. Columns of these names in ``docs`` are replaced, all others stay.
    """
    found = matched_texts(docs, benchmark, threshold)
    docs = docs.drop(*_ADDED)
    [key] = hidden(docs, "key")
    others = [c for c in docs.columns if c != "text"]
    [theirs] = hidden(docs.withColumn(key, F.lit(0)), "their_key")
    joined = docs.withColumn(key, F.md5("text")).join(sized_broadcast(found.withColumnRenamed("key", theirs)), F.col(key) == F.col(theirs))
    return joined.select(*others, *_ADDED)


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that cover no test item to ``threshold``, with all their columns.

    Null and wordless texts stay, and without items all rows do. Repeated rows are judged alike.
    """
    [key] = hidden(docs, "key")
    leaks = matched_texts(docs, benchmark, threshold).select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, F.md5("text")).join(sized_broadcast(leaks), key, "left_anti").select(*docs.columns)


def op4_decontamination(spark, sf_dir):
    """Every document and test item of which it covers the threshold at least."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = matches(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", "covered_words", "coverage", "n_tiles", "reordered", "spans")
