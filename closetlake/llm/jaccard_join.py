"""Exact Jaccard join on word shingles by token-combination prefixes.

Documents are sets of shingle hashes; equal sets are one node. A set of ``n``
tokens that is similar to another shares at least ``need(n)`` tokens with it, so
at most ``n - need(n)`` of its tokens stay unshared. All steps rest on that and
lose no pair.

1. *Which sets can have a partner.* Of the ``n - need(n) + k`` tokens with the
   smallest hashes at least ``k`` must occur in another set's. Sets that fail are
   done; of ordinary text that is nearly all, so only these short lists are
   shuffled for all documents.
2. *Token classes.* The other sets' tokens are counted: ``only here``, ``rare`` (in up
   to ``RARE`` sets) or ``frequent``. In the order only here, rare, frequent, a prefix
   of ``n - need(n) + 2`` tokens holds two shared tokens. Either one of them is rare:
   rare tokens of the prefix are indexed singly. Or both are frequent: the
   frequent tokens of the prefix are indexed as combinations of two. (Prefixes
   of very long documents would hold too many combinations; these and those that may match them
   index their frequent tokens singly.)
3. *Candidates without all pairs.* Within an index key every set is paired with
   the key's most typical set only; the pairs are verified and linked sets get a
   common label. Only sets of a key that still have different labels are
   paired with each other, if their sizes and numbers of shareable tokens allow it.

Tokens are grouped by sorting within a partition and reading it as a stream. Tokens that very many sets share are
found on a bounded sample of sets first; more than ``RARE`` sets of the sample have them, so they are known
to be frequent, and their rows are dealt out by set instead of being brought together. Equal sets are sent once per task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closetlake.llm.common import hidden, prepare, sized_broadcast, stored, table
from closetlake.llm.components import components
from closetlake.llm.hashing import mix, set_hash, shingle_hashes, slices, word_hashes

SIZE, TIMES, OF = 3, 90, 100
RARE = 16
#: Above so many prefix tokens, frequent ones are indexed singly.
MOST_COMBINED = 64
#: Tokens of a set kept beside an index entry to see whether a pair is met elsewhere.
EARLY = 6
#: Characters hashed at a time.
SLICE = 400_000
#: Rows a task builds before it passes them on.
CHUNK = 200_000
#: Texts on which the most frequent tokens are looked for, and so many of these tokens at most; both only decide what is sent where.
HOT_SAMPLE, MOST_HOT = 20_000, 100_000
#: Parts that the rows of such a token are dealt into.
SHARES = 1024
#: Sets remembered by a task to send equal ones once.
REMEMBERED = 100_000


def need(n: int, times: int, of: int) -> int:
    """The least overlap of a set of ``n`` tokens with any similar set."""
    return -(-times * n // of)


def _sets(texts: list, size: int) -> Iterator[np.ndarray]:
    for part in slices(texts, SLICE):
        yield from shingle_hashes(*word_hashes(texts[part.start: part.stop]), size)


def nodes(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``node`` (hash of the set; null for an empty one) of every row."""

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(len(s), set_hash(s) if len(s) else None) for s in _sets(list(batch["text"]), size)]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "n_shingles": pd.array([n for n, _ in found], dtype="int64"),
                "node": pd.array([h for _, h in found], dtype="Int64"),
            })

    return docs.select("doc_id", "text").mapInPandas(name, "doc_id long, n_shingles long, node long")


def _chunks(found: Iterator[tuple[np.ndarray, tuple[int, ...]]], names: list[str]) -> Iterator[pd.DataFrame]:
    """One row per token of the given sets, the numbers of its set beside it, some sets at a time."""
    held, n = [], 0

    def rows():
        counts = [len(t) for t, _ in held]
        columns = {"token": np.concatenate([t for t, _ in held])}
        for i, name in enumerate(names):
            columns[name] = np.repeat(np.array([x[i] for _, x in held], dtype=np.int64), counts)
        return pd.DataFrame(columns)

    for tokens, numbers in found:
        held.append((tokens, numbers))
        n += len(tokens)
        if n >= CHUNK:
            yield rows()
            held, n = [], 0
    if held:
        yield rows()


class _Seen:
    """Remembers the sets a task has sent; forgets all when full, which only sends some twice."""

    def __init__(self):
        self.held: set[int] = set()

    def __call__(self, node: int) -> bool:
        if node in self.held:
            return True
        if len(self.held) >= REMEMBERED:
            self.held.clear()
        self.held.add(node)
        return False


def _short_lists(docs: DataFrame, size: int, times: int, of: int) -> DataFrame:
    """``token``, ``node``, ``least``: the tokens with the smallest hashes of each set, and how many must be shared."""

    def lists(batches):
        seen = _Seen()
        for batch in batches:
            for s in _sets(list(batch["text"]), size):
                n = len(s)
                # Different sets of fewer tokens cannot be similar enough.
                if n == 0 or of * n < times * (n + 1) or seen(node := set_hash(s)):
                    continue
                spare = n - need(n, times, of)
                extra = max(1, min(n - spare, spare // 2))
                yield s[: spare + extra], (node, extra)

    def send(batches):
        yield from _chunks(lists(batches), ["node", "least"])

    return docs.select("text").mapInPandas(send, "token long, node long, least int")


def _distinct_runs(batches, columns: list[str]):
    """Batches sorted by token and node, without repeated (token, node) rows."""
    last = None
    for batch in batches:
        if not len(batch):
            continue
        t, n = batch["token"].to_numpy(), batch["node"].to_numpy()
        new = np.ones(len(t), dtype=bool)
        new[1:] = (t[1:] != t[:-1]) | (n[1:] != n[:-1])
        new[0] = last != (t[0], n[0])
        last = (t[-1], n[-1])
        yield {c: batch[c].to_numpy()[new] for c in columns}


def _shared_only(batches, columns: list[str]):
    """Of a partition sorted by token, the rows whose token another set has too."""
    held, held_shared = None, False
    for rows in _distinct_runs(batches, [*columns, "hot"]):
        hot = rows.pop("hot")
        if hot.any():  # another set has them, wherever it is
            yield pd.DataFrame({c: v[hot] for c, v in rows.items() if c != "token"})
            rows = {c: v[~hot] for c, v in rows.items()}
        if held is not None:
            rows = {c: np.concatenate([held[c], rows[c]]) for c in columns}
        t = rows["token"]
        if not len(t):
            continue
        shared = np.zeros(len(t), dtype=bool)
        same = t[1:] == t[:-1]
        shared[:-1] |= same
        shared[1:] |= same
        shared[0] |= held_shared
        held, held_shared = {c: v[-1:] for c, v in rows.items()}, shared[-1]
        shared[-1] = False
        yield pd.DataFrame({c: v[shared] for c, v in rows.items() if c != "token"})
    if held is not None and held_shared:
        yield pd.DataFrame({c: v for c, v in held.items() if c != "token"})


def _classes(batches, columns: list[str], rare: int):
    """Of a partition sorted by token, the rows of shared tokens with ``df``: how many sets have it, ``rare + 1`` for more."""
    held, over = None, False

    def out(rows, df):
        return pd.DataFrame(rows | {"df": np.minimum(df, rare + 1)})

    for rows in _distinct_runs(batches, [*columns, "hot"]):
        hot = rows.pop("hot")
        if hot.any():
            yield out({c: v[hot] for c, v in rows.items()}, np.full(int(hot.sum()), rare + 1))
            rows = {c: v[~hot] for c, v in rows.items()}
        t = rows["token"]
        if not len(t):
            continue
        if over and t[0] == over_token:  # rows of a token already known to be frequent
            n = int(np.searchsorted(t != over_token, True)) if (t != over_token).any() else len(t)
            yield out({c: v[:n] for c, v in rows.items()}, np.full(n, rare + 1))
            rows = {c: v[n:] for c, v in rows.items()}
        if not len(rows["token"]):
            continue
        over = False
        if held is not None:
            rows = {c: np.concatenate([held[c], rows[c]]) for c in columns}
        t = rows["token"]
        starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        counts = np.diff(np.append(starts, len(t)))
        df = np.repeat(counts, counts)
        last = starts[-1]
        done = (df > 1) & (np.arange(len(t)) < last)
        yield out({c: v[done] for c, v in rows.items()}, df[done])
        rest = {c: v[last:] for c, v in rows.items()}
        if counts[-1] > rare:
            over, over_token, held = True, t[-1], None
            yield out(rest, np.full(counts[-1], rare + 1))
        else:
            held = rest
    if held is not None and len(held["token"]) > 1:
        yield out(held, np.full(len(held["token"]), len(held["token"])))


def hot_tokens(docs: DataFrame, size: int) -> DataFrame:
    """``token``: tokens that more than ``RARE`` sets of a sample have, the most frequent ones, stored."""
    many = max(1, docs.count())
    place = F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(1 << 53))
    some = docs.filter(F.col("text").isNotNull() & (place * many < HOT_SAMPLE)).select("text").distinct()

    def send(batches):
        yield from _chunks(((s, (set_hash(s),)) for batch in batches for s in _sets(list(batch["text"]), size) if len(s)), ["node"])

    counted = some.mapInPandas(send, "token long, node long").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("sets"))
    return stored(counted.filter(F.col("sets") > RARE).orderBy(F.desc("sets"), "token").limit(MOST_HOT).select("token"))


def _spread(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` with ``hot`` (a frequent token of the sample), brought together by token, but hot ones by set as well; sorted by token and set."""
    marked = rows.join(hot.withColumn("hot", F.lit(True)), "token", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    share = F.when(F.col("hot"), F.pmod(F.col("node"), F.lit(SHARES))).otherwise(0)
    return marked.repartition("token", share).sortWithinPartitions("token", "node")


def linkable(docs: DataFrame, size: int, times: int, of: int) -> DataFrame:
    """``node``, ``n``, ``n_rare``, ``tokens`` (the shared ones, rare first) of each set that may have a partner."""
    hot = F.broadcast(hot_tokens(docs, size))  # MOST_HOT rows at most
    first = _spread(_short_lists(docs, size, times, of), hot)
    shared = first.mapInPandas(partial(_shared_only, columns=["token", "node", "least"]), "node long, least int")
    some = shared.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("least").alias("least")).filter(F.col("n") >= F.col("least"))
    some = stored(some.select("node"))

    def send(batches):
        seen = _Seen()
        for batch in batches:
            for part in slices(list(batch["text"]), SLICE):
                rows = [(h, s) for s in _sets(list(batch["text"][part.start: part.stop]), size) if len(s) and not seen(h := set_hash(s))]
                if rows:
                    yield pd.DataFrame({"node": [h for h, _ in rows], "n": [len(s) for _, s in rows], "tokens": [s for _, s in rows]})

    # One Python step here, so that a task keeps one Python worker; its sets are only kept where they may link.
    named = docs.filter(F.col("text").isNotNull()).select("text").mapInPandas(send, "node long, n int, tokens array<long>")
    tokens = named.join(sized_broadcast(some), "node").select(F.explode("tokens").alias("token"), "node", "n")
    counted = _spread(tokens, hot).mapInPandas(
        partial(_classes, columns=["token", "node", "n"], rare=RARE), "token long, node long, n int, df int")
    sets = counted.groupBy("node").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("found"))
    sets = sets.filter(F.size("found") * of >= F.col("n") * times)
    return stored(sets.select(
        "node", "n", F.size(F.filter("found", lambda x: x["df"] <= RARE)).alias("n_rare"), F.col("found.token").alias("tokens")))


def _index(sets: DataFrame, times: int, of: int, early: int = 0) -> DataFrame:
    """``key``, ``node``, ``n`` and ``able`` of each index entry.

    A pair only needs to be met at the key of its first shared tokens. The tokens of
    the set before these are unshared then, so ``able`` is the number of tokens that
    the pair can share still. ``early0`` and so on are the
    first (``early``) tokens of the set that stand before, 0 for none: two sets with a
    common one are met at another key.
    """
    long = MOST_COMBINED * of // (of - times) if times < of else 1 << 62

    def entries(node, n, n_rare, tokens):
        """Frames of the entries of one set: rare tokens, combinations of frequent ones, or these singly."""
        tokens = np.asarray(tokens, dtype=np.int64)
        least = need(n, times, of)
        prefix = tokens[: n - least + 2 - (n - len(tokens))]  # tokens only here come before these
        first = np.zeros(early, dtype=np.int64)
        first[: min(early, len(prefix))] = prefix[:early]

        def rows(keys, i, j, able):
            """Keys made of the prefix tokens ``i`` and ``j`` (the same for single ones)."""
            at = np.arange(early)
            before = np.where((at < j[:, None]) & (at != i[:, None]), first, 0)
            return np.column_stack([keys, np.full(len(keys), node), np.full(len(keys), n), able, before])

        rare, often = np.arange(min(len(prefix), n_rare)), np.arange(n_rare, len(prefix))
        yield rows(prefix[rare], rare, rare, len(tokens) - rare)
        if len(tokens) - n_rare < least:
            return
        if n <= long and len(often) > 1:
            i, j = (often[x] for x in np.triu_indices(len(often), 1))
            both = mix(mix(prefix.view(np.uint64)[i] ^ np.uint64(0x632BE59BD9B4E019)) + prefix.view(np.uint64)[j])
            yield rows(both.view(np.int64), i, j, len(tokens) - j + 1)
        if n * of >= long * times:
            yield rows(prefix[often], often, often, len(tokens) - often)

    columns = ["key", "node", "n", "able", *[f"early{k}" for k in range(early)]]

    def send(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(batch["node"], batch["n"], batch["n_rare"], batch["tokens"], strict=True):
                for rows in entries(*row):
                    held.append(rows)
                    size += len(rows)
                if size >= CHUNK:
                    yield pd.DataFrame(np.concatenate(held), columns=columns)
                    held, size = [], 0
        if held:
            yield pd.DataFrame(np.concatenate(held), columns=columns)

    return sets.mapInPandas(send, "key long, node long, n int, able int" + "".join(f", early{k} long" for k in range(early)))


def _met_before(a: str, b: str):
    """Whether two entries name a common early token (0 stands for none)."""
    tokens = [F.array_remove(F.array(*[F.col(f"{x}.early{k}") for k in range(EARLY)]), 0) for x in (a, b)]
    return F.arrays_overlap(*tokens)


def _possible(a_n, b_n, a_able, b_able, times: int, of: int):
    """Whether sizes and shareable tokens allow similarity (columns or arrays)."""
    return (a_n * of >= b_n * times) & (b_n * of >= a_n * times) & (a_able * (times + of) >= (a_n + b_n) * times) & (
        b_able * (times + of) >= (a_n + b_n) * times)


def _stars(batches, times: int, of: int):
    """Of a partition sorted by key, pairs of each key's first set with the key's others."""
    head = None
    for batch in batches:
        if not len(batch):
            continue
        rows = {c: batch[c].to_numpy().astype(np.int64) for c in ("key", "node", "n", "able")}
        if head is not None:
            rows = {c: np.concatenate([[head[c]], v]) for c, v in rows.items()}
        key = rows["key"]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        first = np.repeat(starts, np.diff(np.append(starts, len(key))))
        a = {c: v[first] for c, v in rows.items()}
        head = {c: v[first[-1]] for c, v in rows.items()}
        ok = (a["node"] != rows["node"]) & _possible(a["n"], rows["n"], a["able"], rows["able"], times, of)
        pairs = np.unique(np.stack([np.minimum(a["node"], rows["node"])[ok], np.maximum(a["node"], rows["node"])[ok]]), axis=1)
        yield pd.DataFrame({"a": pairs[0], "b": pairs[1]})


def _verified(pairs: DataFrame, sets: DataFrame, times: int, of: int) -> DataFrame:
    a = sets.select(F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("tokens").alias("a_tokens"))
    b = sets.select(F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("tokens").alias("b_tokens"))
    both = F.size(F.array_intersect("a_tokens", "b_tokens"))
    met = pairs.join(a, "a").join(b, "b").withColumn("both", both)
    return met.filter(F.col("both") * of >= (F.col("a_n") + F.col("b_n") - F.col("both")) * times).select("a", "b")


def links(docs: DataFrame, size: int = SIZE, times: int = TIMES, of: int = OF) -> tuple[DataFrame, DataFrame]:
    """Links between different sets that join all that are similar, and their components (``node``, ``label``).

    Of a group of similar sets enough pairs are verified to connect it, not all. Combinations of two need two shared
    tokens; two different similar sets have them at thresholds above a half, and others are refused.
    """
    if not of < 2 * times <= 2 * of:
        raise ValueError("the threshold must be above 0.5 and 1 at most")
    sets = linkable(docs, size, times, of)
    index = _index(sets, times, of)
    ordered = index.repartition("key").sortWithinPartitions("key", F.desc("able"), "n", "node")
    stars = ordered.mapInPandas(partial(_stars, times=times, of=of), "a long, b long").distinct()
    near = stored(_verified(stars, sets, times, of))
    labels = components(near)
    # Sets that share a key and are not connected yet.
    labelled = _index(sets, times, of, EARLY).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    apart = stored(labelled.join(mixed, "key", "left_semi"))
    a, b = apart.alias("a"), apart.alias("b")
    able = _possible(F.col("a.n"), F.col("b.n"), F.col("a.able"), F.col("b.able"), times, of)
    rest = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.label") != F.col("b.label")) & able
                  & ~_met_before("a", "b"))
    rest = rest.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    more = stored(_verified(rest, sets, times, of))
    if more.isEmpty():
        return near, labels
    return near.union(more), components(near.union(more))


def groups(docs: DataFrame, size: int = SIZE, times: int = TIMES, of: int = OF) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs`` (doc_id, text).

    Rows link when ``of`` times their shared shingles reach ``times`` times all theirs; equal
    sets always link. A row without words is its own component; a row without id has
    the smallest id of its component, null if there is none.
    """
    named = stored(nodes(docs, size))
    _, labels = links(docs, size, times, of)
    lowest = named.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first"))
    joined = lowest.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    per_label = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    found = stored(joined.join(per_label, "label").select("node", "component_id"))
    return named.join(found, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _named(size: int):
    """The hash of a text's set, null for an empty one, beside the row."""

    @F.pandas_udf("long")
    def name(texts: pd.Series) -> pd.Series:
        return pd.Series([set_hash(s) if len(s) else None for s in _sets(list(texts), size)], dtype="Int64")

    return name("text")


def keep_one(docs: DataFrame, size: int = 5, times: int = 80, of: int = 100) -> DataFrame:
    """One row of each group of near copies, with all columns of ``docs``; rows without id stay.

    The row with the smallest id stays, of several with that id in the group the one whose columns
    have the smallest hash. Rows with one id and different texts are different documents. A row without words
    is near to nothing but the wordless rows of its id.
    """
    node, mark = hidden(docs, "node", "mark")
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    marked = docs.withColumn(mark, F.xxhash64(*[F.col(f"`{c}`") for c in plain]))
    rows = stored(marked.filter(F.col("doc_id").isNotNull()).withColumn(node, _named(size)).select("doc_id", F.col(node).alias("node"), F.col(mark).alias("mark")))
    _, labels = links(docs, size, times, of)
    own = F.struct("doc_id", "mark")
    found = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of_group = found.filter(F.col("label").isNotNull()).groupBy("label").agg(F.min(own).alias("first"))
    wordless = rows.filter(F.col("node").isNull()).groupBy("doc_id").agg(F.min(own).alias("first"))
    first = stored(of_group.select("first.*").unionByName(wordless.select("first.*")))
    counted = rows.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("alike"))
    gone = stored(counted.join(first, ["doc_id", "mark"], "left_anti").select("doc_id", F.col("mark").alias(mark)))
    kept = marked.join(sized_broadcast(gone), ["doc_id", mark], "left_anti")
    # Rows alike in every column: one of them.
    repeated = stored(counted.filter("alike > 1").join(first, ["doc_id", "mark"], "left_semi").select("doc_id", F.col("mark").alias(mark)))
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    again = sized_broadcast(repeated)
    single, several = kept.join(again, ["doc_id", mark], "left_anti"), kept.join(again, ["doc_id", mark], "left_semi")
    return single.select(*docs.columns).unionByName(several.dropDuplicates(["doc_id", mark]).select(*docs.columns))


def op10_jaccard_join(spark, sf_dir):
    """Component of every document under 3-word shingles and a Jaccard similarity of 0.9."""
    return groups(table(prepare(spark), sf_dir, "documents"))
