"""Spelling variants: k-d trees over letter-count vectors.

One edit changes the counts of a word's letters by an L1 distance of one (a letter
more or less) or two (one letter for another). So the near words of a word lie in a
small box around its vector, among words of its length or one letter more.

1. Words are taken from the texts and counted with Spark functions; the vocabulary is
   stored.
2. For each length a k-d tree over letter counts is fitted on a bounded sample of words;
   all words are dealt to its leaves. A leaf that still holds too many is dealt out
   by hash.
3. As a query each word visits the leaves whose box lies within the distance, in the tree of
   its own length and in that of one letter more; of two leaves of one length only the words of the first
   visit the second, as both words of a pair get it. Within a leaf a
   finer tree is searched in the same way; squared distances of count vectors leave few pairs,
   whose letter order is compared.
4. A leaf returns counts and the best near word per word, not pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closetlake.llm.common import prepare, stored, table

LETTERS = "A-Za-z\\u00C0-\\u00FF"
LEAST, TIMES, FEWEST = 7, 10, 2
#: Words the trees are fitted on.
SAMPLE = 100_000
#: Words of a leaf that one task holds, and their letters at most.
LEAF, LEAF_LETTERS = 40_000, 4_000_000
#: Words in a bucket of the finer tree.
BUCKET = 256
#: Queries searched at a time.
CHUNK = 20_000
#: Kinds of rows in a leaf: its words, these as queries, and queries that live in another leaf.
HELD, AT_HOME, FROM_ELSEWHERE = 0, 1, 2
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(docs: DataFrame) -> DataFrame:
    """One row ``word`` for each counted occurrence: runs of letters, A-Z in lower case, some with a letter left out.

    A null text has no words; a null id counts as empty.
    """
    run = F.explode(F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{LEAST},}})"), F.lit(1)))
    low = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    low = low.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, UPPER.lower())).otherwise(F.col("run")).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    word = F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).filter(F.length("word") >= LEAST)


def letters(found: list[str]) -> np.ndarray:
    """The letters of words of one length, a row for each word (all are below U+0100)."""
    return np.frombuffer("".join(found).encode("latin-1"), dtype=np.uint8).reshape(len(found), -1)


def counts(matrix: np.ndarray) -> np.ndarray:
    """How often each of the 256 code points occurs in each word."""
    n, length = matrix.shape
    flat = matrix.astype(np.int64) + 256 * np.arange(n)[:, None]
    out = np.bincount(flat.ravel(), minlength=256 * n).reshape(n, 256)
    return out.astype(np.int16 if length < 1 << 15 else np.int64)


class Tree:
    """A k-d tree: ``nodes`` holds (letter, most on the left, left, right) or (-1, leaf number, 0, 0), the root first."""

    def __init__(self, nodes: list[tuple[int, int, int, int]]):
        self.nodes = nodes
        self.leaves = sum(1 for x in nodes if x[0] < 0)

    @classmethod
    def fit(cls, vectors: np.ndarray, leaves: int = 0, bucket: int = 0) -> tuple[Tree, list[np.ndarray]]:
        """Splits the largest leaf at its most even threshold, to ``leaves`` leaves or until none exceeds ``bucket`` rows.

        Also returns the rows of each leaf. Rows with equal vectors stay together.
        """
        nodes: list[tuple[int, int, int, int]] = [(-1, 0, 0, 0)]
        rows = [np.arange(len(vectors))]
        open_ = [0]  # nodes that are leaves and may be split
        where = {0: 0}
        while open_ and (not leaves or len(rows) < leaves):
            open_.sort(key=lambda k: len(rows[where[k]]))
            node = open_.pop()
            mine = rows[where[node]]
            if len(mine) < 2 or bucket and len(mine) <= bucket:
                break
            part = vectors[mine]
            best = None
            for most in range(int(min(part.max(), 3))):
                share = (part <= most).mean(axis=0)
                letter = int(np.argmin(np.abs(share - 0.5)))
                if 0 < share[letter] < 1 and (best is None or abs(share[letter] - 0.5) < best[0]):
                    best = (abs(share[letter] - 0.5), letter, most)
            if best is None:  # only counts above three differ, or nothing
                spread = part.max(axis=0) - part.min(axis=0)
                letter = int(np.argmax(spread))
                if spread[letter] == 0:
                    continue
                best = (0, letter, int((int(part[:, letter].max()) + int(part[:, letter].min())) // 2))
            _, letter, most = best
            low = part[:, letter] <= most
            left, right = len(nodes), len(nodes) + 1
            leaf = where.pop(node)
            nodes[node] = (letter, most, left, right)
            nodes += [(-1, leaf, 0, 0), (-1, len(rows), 0, 0)]
            where[left], where[right] = leaf, len(rows)
            rows[leaf] = mine[low]
            rows.append(mine[~low])
            open_ += [left, right]
        return cls(nodes), rows

    def home(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(vectors), dtype=np.int64)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, at = todo.pop()
            letter, most, left, right = self.nodes[node]
            if letter < 0:
                out[at] = most
                continue
            low = vectors[at, letter] <= most
            todo += [(left, at[low]), (right, at[~low])]
        return out

    def visits(self, vectors: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each leaf with the rows whose L1 distance to its box is at most ``radius``; boxes out of reach are pruned with all below."""
        n = len(vectors)
        todo = [(0, np.arange(n), np.zeros(n, dtype=np.int64), {})]
        while todo:
            node, at, far, box = todo.pop()
            if not len(at):
                continue
            letter, most, left, right = self.nodes[node]
            if letter < 0:
                yield most, at
                continue
            value = vectors[at, letter].astype(np.int64)
            lo, hi = box.get(letter, (0, 1 << 40))
            rest = far - np.maximum(lo - value, 0) - np.maximum(value - hi, 0)
            for child, a, b in ((left, lo, min(hi, most)), (right, max(lo, most + 1), hi)):
                reach = rest + np.maximum(a - value, 0) + np.maximum(value - b, 0)
                ok = reach <= radius
                todo.append((child, at[ok], reach[ok], box | {letter: (a, b)}))


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by one replaced letter (equal lengths) or by one letter that ``long`` has more."""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(axis=1) == 1
    length = short.shape[1]
    head = np.cumprod(short == long[:, :-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    tail = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    return head + tail >= length


class _Leaf:
    """The words of one leaf, in a finer tree."""

    def __init__(self, found: list[str], n: np.ndarray):
        self.words, self.n, self.letters = found, n, letters(found)
        vectors = counts(self.letters)
        # float32 holds squares below 2**24.
        self.kind = np.float32 if self.letters.shape[1] < 4000 else np.float64
        self.used = np.flatnonzero(vectors.any(axis=0))
        self.vectors = vectors[:, self.used].astype(self.kind)
        self.squares = (self.vectors**2).sum(axis=1)
        self.tree, self.rows = Tree.fit(vectors, bucket=BUCKET)
        self.twice = [-2 * self.vectors[r].T for r in self.rows]
        self.low = [vectors[r].min(axis=0)[self.used] for r in self.rows]
        self.high = [vectors[r].max(axis=0)[self.used] for r in self.rows]

    def pairs(self, other: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of queries and of words of the leaf that are one edit apart."""
        same = other.shape[1] == self.letters.shape[1]
        radius, square = (2, 2) if same else (1, 1)
        every = counts(other)
        total = every.sum(axis=1)
        vectors = every[:, self.used]
        # Letters that no word here has must be replaced, too.
        strange = total - vectors.sum(axis=1)
        whole = vectors.astype(self.kind)
        base = (whole**2).sum(axis=1)
        extra = (every.astype(np.int64) ** 2).sum(axis=1) - base if strange.any() else np.zeros(len(base), self.kind)
        for leaf, at in self.tree.visits(every, radius):
            low, high = self.low[leaf], self.high[leaf]
            mine = vectors[at]
            far = np.maximum(low - mine, 0).sum(axis=1) + np.maximum(mine - high, 0).sum(axis=1) + strange[at]
            at = at[far <= radius]
            if not len(at):
                continue
            rows = self.rows[leaf]
            apart = whole[at] @ self.twice[leaf]
            apart += self.squares[rows]
            apart += (base[at] + extra[at])[:, None]
            q, p = np.nonzero(apart == square)  # all are whole numbers
            q, p = at[q], rows[p]
            ok = one_edit(other[q], self.letters[p])
            yield q[ok], p[ok]


def _best(who: np.ndarray, rank: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How many pairs each of ``size`` words has, and the smallest rank among them."""
    found = np.full(size, np.iinfo(np.int64).max)
    np.minimum.at(found, who, rank)
    return np.bincount(who, minlength=size), found


def _ranks(found: list[str], n: np.ndarray) -> np.ndarray:
    """The place of each word by falling ``n``, then by code points."""
    order = sorted(range(len(found)), key=lambda k: (-int(n[k]), found[k]))
    out = np.empty(len(found), dtype=np.int64)
    out[order] = np.arange(len(found))
    return out


def _searched(leaf: _Leaf, found: list[str], n: np.ndarray, both: bool) -> Iterator[pd.DataFrame]:
    """Counts and best near words of queries of one length, and of the leaf's words for queries from elsewhere (``both``)."""
    pairs = list(leaf.pairs(letters(found)))
    if not pairs or not sum(len(q) for q, _ in pairs):
        return
    q, p = (np.concatenate([x[k] for x in pairs]) for k in (0, 1))
    sides = [(q, p, found, leaf.words, leaf.n)]
    if both:
        sides.append((p, q, leaf.words, found, n))
    for who, whom, names, others, times in sides:
        rank = _ranks(others, times)
        back = np.argsort(rank)
        many, best = _best(who, rank[whom], len(names))
        at = np.flatnonzero(many)
        top = back[best[at]]
        yield pd.DataFrame({"word": [names[k] for k in at], "n_near": many[at], "best": [others[k] for k in top], "best_n": times[top]})


def _in_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by leaf, a leaf's own words first; these are held, the queries pass by."""
    key, own, leaf = None, [], None
    waiting: list[pd.DataFrame] = []
    size = 0

    def search():
        nonlocal leaf, own, waiting, size
        if waiting and leaf is None and own:
            words_ = pd.concat(own, ignore_index=True)
            leaf, own = _Leaf(list(words_["word"]), words_["n"].to_numpy(np.int64)), []
        if waiting and leaf is not None:
            rows = pd.concat(waiting, ignore_index=True)
            for (_, kind), some in rows.groupby(["length", "kind"], sort=True):
                yield from _searched(leaf, list(some["word"]), some["n"].to_numpy(np.int64), kind == FROM_ELSEWHERE)
        waiting, size = [], 0

    for batch in batches:
        for (of, salt, kind), rows in batch.groupby(["leaf", "salt", "kind"], sort=True):
            if (of, salt) != key:
                yield from search()
                key, own, leaf = (of, salt), [], None
            if kind == HELD:
                own.append(rows)
                continue
            waiting.append(rows)
            size += len(rows)
            if size >= CHUNK:
                yield from search()
    yield from search()


def fitted(vocabulary: DataFrame) -> dict[int, Tree]:
    """A tree for each length, from a sample of the vocabulary of ``SAMPLE`` words at most.

    A tree has as many leaves as its length has words in units of a leaf's size. Lengths
    without a sampled word have one leaf.
    """
    sizes = {r[0]: r[1] for r in vocabulary.groupBy("length").count().collect()}
    total = sum(sizes.values())
    # One leaf per length needs no sample.
    wide = {k: -(-v // max(1, min(LEAF, LEAF_LETTERS // k))) for k, v in sizes.items()}
    order = F.xxhash64("word")
    place = F.shiftrightunsigned(order, 11) / F.lit(float(1 << 53))
    several = [k for k, v in wide.items() if v > 1]
    thin = vocabulary.filter(F.col("length").isin(several) & (place * total < 2 * SAMPLE)) if several else vocabulary.limit(0)
    sample = [r[0] for r in thin.select("word", order.alias("o")).orderBy("o", "word").limit(SAMPLE).collect()]
    by_length: dict[int, list[str]] = {}
    for w in sample:
        by_length.setdefault(len(w), []).append(w)
    return {k: Tree.fit(counts(letters(by_length[k])), leaves=wide[k])[0] if k in by_length else Tree([(-1, 0, 0, 0)]) for k in sizes}


def _dealt(trees: dict[int, Tree], shares: dict[tuple[int, int], int] | None):
    """Home leaves (``shares`` is None), or rows of all leaves a word belongs to or visits; large leaves have several shares."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, rows in batch.groupby("length", sort=True):
                length, found, n = int(length), rows["word"].to_numpy(), rows["n"].to_numpy()
                vectors = counts(letters(list(found)))
                home = trees[length].home(vectors)
                names = np.array([f"{length}/{k}" for k in range(trees[length].leaves)], dtype=object)
                if shares is None:
                    yield pd.DataFrame({"leaf": names[home]})
                    continue
                parts = np.array([shares.get(x, 1) for x in names])
                salt = np.array([zlib.crc32(w.encode()) for w in found]) % parts[home]
                yield pd.DataFrame({"leaf": names[home], "salt": salt.astype("int32"), "kind": np.int32(HELD), "length": np.int32(length), "word": found, "n": n})
                for other, radius in ((length, 2), (length + 1, 1)):
                    if other not in trees:
                        continue
                    for leaf, at in trees[other].visits(vectors, radius):
                        if other == length:
                            at = at[home[at] <= leaf]
                        kind = np.where((home[at] == leaf) & (other == length), AT_HOME, FROM_ELSEWHERE).astype("int32")
                        name = f"{other}/{leaf}"
                        for k in range(shares.get(name, 1)):
                            yield pd.DataFrame({"leaf": name, "salt": np.int32(k), "kind": kind, "length": np.int32(length), "word": found[at], "n": n[at]})

    return run


def near(vocabulary: DataFrame) -> DataFrame:
    """``word``, ``n_near``, ``best``, ``best_n`` of each word of ``vocabulary`` (word, n, length) that has a near word.

    ``best`` is the near word with the largest ``n``, of equal ones the smallest in code-point order.
    """
    trees = fitted(vocabulary)
    # A number for each leaf; there are as many leaves as words in units of a leaf's size.
    homes = vocabulary.select("word", "n", "length").mapInPandas(_dealt(trees, None), "leaf string").groupBy("leaf").count()
    shares = {}
    for name, many in homes.filter(F.col("count") > LEAF).collect():
        shares[name] = -(-many // max(1, min(LEAF, LEAF_LETTERS // int(name.split("/")[0]))))
    rows = vocabulary.select("word", "n", "length").mapInPandas(_dealt(trees, shares), "leaf string, salt int, kind int, length int, word string, n long")
    met = rows.repartition("leaf", "salt").sortWithinPartitions("leaf", "salt", "kind").mapInPandas(_in_leaves, "word string, n_near long, best string, best_n long")
    top = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top")).select(
        "word", "n_near", F.col("top.word").alias("best"), (-F.col("top.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of all rows of ``forms`` (word, form): the last word reached by following forms.

    The distance covered doubles each round. A form occurs ten times as often as its word, so
    chains end, after as many steps as the largest count has digits.
    """
    at = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stored(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if after.filter("moved").isEmpty():
            return at
        at = after.select("word", "root")


def variants(vocabulary: DataFrame, times: int = TIMES) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of each word of ``vocabulary`` (word, n, length)."""
    found = near(vocabulary)
    named = stored(vocabulary.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("best_n") >= times * F.col("n"), F.struct("best", "best_n")).alias("form")))
    last = roots(named.filter(F.col("form").isNotNull()).select("word", F.col("form.best").alias("form")))
    return named.join(last, "word", "left").select(
        "word", F.col("form.best").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("form.best_n").alias("form_n"))


def vocabulary(docs: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """``word``, ``n`` and ``length`` of the words that occur at least ``fewest`` times, stored."""
    return stored(words(docs).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= fewest).withColumn("length", F.length("word")))


def op12_spelling_variants(spark, sf_dir):
    """Near words, form and root of every word of all documents."""
    return variants(vocabulary(table(prepare(spark), sf_dir, "documents")))
