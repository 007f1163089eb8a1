"""Prefix trie of conversations by range minima over sorted common prefixes.

A conversation is the sequence of its turns' digests (16 bytes each), so byte order
of the joined digests is an order in which every prefix is one interval.

1. Equal sequences become one row with the number of its conversations; the hash
   over their ids is made from pieces that range partitions have sorted and joined.
2. Distinct sequences are dealt into parts by boundaries from a bounded sample of
   keys and sorted. A hot first turn, or any hot prefix, is cut like everything else.
3. In a part, adjacent rows give the longest common prefixes (LCPs), and a sparse table
   their range minima. Each candidate prefix, which is a row and a depth, searches its
   left and right extents by binary steps over the table. Counts, leaves and bytes of an
   interval are differences of running sums.
4. A prefix that goes on beyond a border of its part gives one partial row for each part; all
   figures are sums over rows, so partial rows are added. There are at most twice as
   many of them per part as its border rows have turns.

The digests of one conversation must fit into one row (16 bytes a turn).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from closetlake.llm.common import prepare, sized_broadcast, stored, table

TURN = 16
#: Bytes of keys in a part, and sampled keys for each part.
PART_BYTES, PER_PART = 8_000_000, 20
#: Bytes of a key that a boundary may have.
BOUNDARY_BYTES = 4096
#: Ids joined into one piece before they are hashed.
PIECE = 10_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
PARTIAL = (
    "node_key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string")


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns`` (digest in hex, bytes of the text) of each conversation in the order of turns.

    A null turn comes first, equal turns in the order of their digests; null role and text are
    empty. Rows without ``conv_id`` belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN)
    one = F.struct(F.col("turn").alias("turn"), digest.alias("digest"), F.octet_length(text).alias("bytes"))
    grouped = turns.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Each conversation with its first turns taken from the conversation at the multiple of five below it."""
    h = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    heads = own.filter(F.col("conv_id") % 5 == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("head"))
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).withColumn("h", h).join(heads, "base", "left")
    none = F.array().cast(own.schema["turns"].dataType)
    head = F.coalesce(F.when(F.col("h") > 0, F.slice("head", F.lit(1), F.col("h"))), none)
    rest = F.slice("turns", F.col("h") + 1, F.size("turns") + 1)
    return joined.select("conv_id", F.concat(head, rest).alias("turns"))


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted ids of a sequence, joined by commas, some thousand at a time."""
    for batch in batches:
        ids, sids = batch["conv_id"].to_numpy(), batch["sid"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], sids[1:] != sids[:-1]])) if len(ids) else np.empty(0, int)
        cuts = [(k, min(k + PIECE, b)) for a, b in zip(starts, [*starts[1:], len(ids)], strict=True) for k in range(a, b, PIECE)]
        yield pd.DataFrame({"sid": [sids[a] for a, _ in cuts], "first": [ids[a] for a, _ in cuts], "ids": [",".join(map(str, ids[a:b])) for a, b in cuts]})


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 over the pieces of each sequence; a stream, whatever the number of pieces."""
    sid, state = None, None
    for batch in batches:
        done = []
        for s, ids in zip(batch["sid"], batch["ids"], strict=True):
            if s == sid:
                state.update(b",")
            else:
                if sid is not None:
                    done.append((sid, state.hexdigest()))
                sid, state = s, hashlib.sha256()
            state.update(ids.encode())
        yield pd.DataFrame(done, columns=["sid", "ends"])
    if sid is not None:
        yield pd.DataFrame([(sid, state.hexdigest())], columns=["sid", "ends"])


def distinct(convs: DataFrame) -> DataFrame:
    """``key``, ``sizes``, ``n``, ``first``, ``ends`` of each distinct sequence of ``convs`` (conv_id, turns)."""
    key = F.unhex(F.array_join(F.col("turns.digest"), ""))
    keyed = stored(convs.select("conv_id", key.alias("key"), F.col("turns.bytes").alias("sizes"))
                   .withColumn("sid", F.substring(F.sha2("key", 256), 1, 2 * TURN)))
    sets = keyed.groupBy("sid").agg(F.any_value("key").alias("key"), F.any_value("sizes").alias("sizes"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"))
    sorted_ids = keyed.select("sid", "conv_id").repartitionByRange("sid", "conv_id").sortWithinPartitions("sid", "conv_id")
    pieces = sorted_ids.mapInPandas(_pieces, "sid string, first long, ids string").repartition("sid").sortWithinPartitions("sid", "first")
    ends = pieces.mapInPandas(_hashed, "sid string, ends string")
    return stored(sets.join(ends, "sid").drop("sid"))


def boundaries(sets: DataFrame) -> list[bytes]:
    """First keys of all parts but the first, from a bounded sample: ``PER_PART`` keys for each part."""
    bytes_ = sets.agg(F.sum(F.length("key") + 64)).first()[0] or 0
    parts = max(int(bytes_ // PART_BYTES) + 1, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = F.xxhash64("key")
    rows = sets.select(F.substring("key", 1, BOUNDARY_BYTES).alias("key"), order.alias("o")).orderBy("o", "key").limit(parts * PER_PART).collect()
    keys = sorted(bytes(r["key"]) for r in rows)
    return sorted(set(keys[PER_PART::PER_PART]))


def with_part(sets: DataFrame, bounds: list[bytes]) -> DataFrame:
    """Adds ``part``, the number of boundaries up to the key."""
    shared = np.array(bounds, dtype=object)

    @F.pandas_udf("int")
    def part(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared, key.to_numpy(), side="right").astype("int32") if len(shared) else np.zeros(len(key), dtype="int32"))

    return sets.withColumn("part", part("key"))


def common_turns(a: bytes | None, b: bytes | None) -> int:
    """Turns that two keys begin with alike; -1 if one is missing."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // TURN * TURN
    differ = np.flatnonzero(np.frombuffer(a[:n], dtype=np.uint8) != np.frombuffer(b[:n], dtype=np.uint8))
    return int((differ[0] if len(differ) else n) // TURN)


def borders(parted: DataFrame) -> dict[int, tuple[int, int]]:
    """By part the turns that its first key shares with the key before, and its last key with the one after (-1: none)."""

    @F.pandas_udf("int")
    def shared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([common_turns(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")

    # One row for each part.
    edges = parted.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    w = Window.orderBy("part")
    met = edges.select("part", "low", "high", F.lag("high").over(w).alias("before"), F.lead("low").over(w).alias("after"))
    return {r[0]: (r[1], r[2]) for r in met.select("part", shared("before", "low"), shared("high", "after")).collect()}


class _Minima:
    """Sparse table of the minima over all ranges whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.rows, step = [values], 1
        while 2 * step <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minima over ``a..b``, both included."""
        out = np.empty(len(a), dtype=self.rows[0].dtype)
        level = np.frexp((b - a + 1).astype(float))[1] - 1
        for k in np.unique(level):
            at = level == k
            row = self.rows[k]
            out[at] = np.minimum(row[a[at]], row[b[at] - (1 << k) + 1])
        return out

    def right(self, i: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The last row up to which all LCPs after row ``i`` reach ``d`` (entry k is the LCP of rows k and k + 1)."""
        at = i.copy()
        for k in reversed(range(len(self.rows))):
            row = self.rows[k]
            ok = at < len(row)
            ok[ok] = row[at[ok]] >= d[ok]
            at[ok] += 1 << k
        return at

    def left(self, i: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The first row from which all LCPs up to row ``i`` reach ``d``."""
        at = i.copy()
        for k in reversed(range(len(self.rows))):
            row, start = self.rows[k], at - (1 << k)
            ok = start >= 0
            ok[ok] = row[start[ok]] >= d[ok]
            at[ok] -= 1 << k
        return at


def adjacent(flat: np.ndarray, offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    """LCP in turns of each row and the next; ``flat`` holds the turns of all rows."""
    n = np.minimum(length[:-1], length[1:])
    at = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    equal = flat[offset[at] + pos] == flat[offset[at + 1] + pos]
    out = n.copy()
    np.minimum.at(out, at[~equal], pos[~equal])
    return out


def _path_keys(key: bytes, depth: int) -> list[bytes]:
    """Names of the prefixes of a key, from the root to ``depth``, each from the one before."""
    out = [b"root"]
    for k in range(depth):
        out.append(hashlib.blake2b(out[-1] + key[k * TURN: (k + 1) * TURN], digest_size=TURN).digest())
    return out


def part_nodes(rows: pd.DataFrame, before: int, after: int) -> pd.DataFrame:
    """The nodes of one part, whole ones and those that go on in another part."""
    keys, count = list(rows["key"]), len(rows)
    length = np.array([len(k) // TURN for k in keys])
    offset = np.cumsum(length) - length
    flat = np.frombuffer(b"".join(keys), dtype=f"V{TURN}")
    size = np.concatenate([np.asarray(s, dtype=np.int64) for s in rows["sizes"]] + [np.zeros(1, np.int64)])
    running = np.concatenate([[0], np.cumsum(size)])
    n, first = rows["n"].to_numpy(np.int64), rows["first"].to_numpy(np.int64)
    lcp = adjacent(flat, offset, length)
    # Of row i: what it shares with the row before and the row after, over the borders too.
    back, on = np.concatenate([[before], lcp]), np.concatenate([lcp, [after]])
    minima, firsts = _Minima(lcp), _Minima(first)

    def up_to(i, d):
        """Bytes of the first ``d`` turns of row ``i``."""
        return running[offset[i] + np.maximum(d, 0)] - running[offset[i]]

    total = up_to(np.arange(count), length)
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (n, on < length, total - up_to(np.arange(count), back), n * total)]

    # Candidates: every row with every depth, and the root.
    i = np.concatenate([np.repeat(np.arange(count), length), [0]])
    d = np.concatenate([np.arange(len(flat)) - np.repeat(offset, length) + 1, [0]])
    low, high = minima.left(i, d), minima.right(i, d)
    own = low == i
    low, high, d = low[own], high[own], d[own]
    convs, leaves, fresh, weighted = (s[high + 1] - s[low] for s in sums)
    starts = d > back[low]  # the node begins in this part
    above = up_to(low, d - 1)
    fresh = np.where(starts, fresh - (total - up_to(np.arange(count), back))[low] + total[low] - above, fresh)
    place = {x: k for k, x in enumerate(zip(low.tolist(), d.tolist(), strict=True))}
    children = (starts & (d < length[low])).astype(np.int64)
    inner = np.flatnonzero(back >= 0)
    for where in zip(minima.left(inner, back[inner]).tolist(), back[inner].tolist(), strict=True):
        children[place[where]] += 1
    # The row above: the interval of the prefix that is one turn shorter.
    up = np.maximum(d - 1, 0)
    p_low, p_high = minima.left(low, up), minima.right(low, up)
    parent = firsts.least(p_low, p_high)
    first_path, last_path = _path_keys(keys[0], max(before, 0)), _path_keys(keys[-1], max(after, 0))

    def names(low, high, d):
        """Names of the nodes that go on beyond a border (the root always does); None for the others."""
        return [
            b"root" if x == 0 else first_path[x] if a == 0 and x <= before else last_path[x] if b == count - 1 and x <= after else None
            for a, b, x in zip(low.tolist(), high.tolist(), d.tolist(), strict=True)]

    parents = names(p_low, p_high, up)
    ends = rows["ends"].to_numpy()
    return pd.DataFrame({
        "node_key": names(low, high, d), "parent_key": [p if x else None for p, x in zip(parents, d, strict=True)], "conv_id": firsts.least(low, high), "depth": d,
        "parent_conv_id": pd.array(np.where(d > 0, parent, 0), dtype="Int64"), "n_convs": convs, "n_children": children, "n_leaves": leaves,
        "saved_tokens": weighted - convs * above - fresh,
        "ends_sha256": [ends[a] if s and length[a] == x else None for a, s, x in zip(low, starts, d, strict=True)],
    })


def _each_part(border: dict[int, tuple[int, int]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            for part, rows in batch.groupby("part", sort=True):
                if held and held[0]["part"].iat[0] != part:
                    yield part_nodes(pd.concat(held, ignore_index=True), *border[int(held[0]["part"].iat[0])])
                    held = []
                held.append(rows)
        if held:
            yield part_nodes(pd.concat(held, ignore_index=True), *border[int(held[0]["part"].iat[0])])

    return run


def trie(convs: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of ``convs`` (conv_id, turns: array of digest in hex and bytes), turnless ones included.

    No conversation gives no node. ``ends_sha256`` covers the ids of the conversations that end at the node.
    """
    sets = distinct(convs)
    bounds = boundaries(sets)
    parted = with_part(sets, bounds)
    border = borders(parted)
    ordered = parted.repartition(len(bounds) + 1, "part").sortWithinPartitions("part", "key")
    found = stored(ordered.mapInPandas(_each_part(border), PARTIAL))
    summed = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    open_ = stored(found.filter(F.col("node_key").isNotNull()).groupBy("node_key", "depth").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), *summed, F.max("ends_sha256").alias("ends_sha256")))
    columns = ["conv_id", "depth", "parent_key", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = found.filter(F.col("node_key").isNull()).select(*columns).unionByName(open_.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns))
    above = sized_broadcast(open_.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("above")))
    root = F.col("depth") == 0
    return nodes.join(above, "parent_key", "left").select(
        "conv_id", "depth", F.when(~root, F.coalesce("above", "parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        # A root alone is a leaf itself.
        F.when(root, F.greatest("n_leaves", F.lit(1))).otherwise(F.col("n_leaves")).alias("n_leaves"), "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def op13_prefix_trie(spark, sf_dir):
    """Prefix trie of all rebuilt conversations."""
    own = stored(sequences(table(prepare(spark), sf_dir, "conversations")))
    return trie(rebuilt(own))


_CRC = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(length(conv_id::VARCHAR)), lambda k: ascii(substr(conv_id::VARCHAR, k + 1, 1))::UBIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1))))"""

OP13_SQL = f"""
WITH own AS (
    SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), keyed AS (SELECT *, (xor({_CRC}, 4294967295::UBIGINT) % 9)::BIGINT AS h FROM own),
built AS (
    SELECT k.conv_id, list_concat(coalesce(b.turns[1:k.h], []), k.turns[k.h + 1:]) AS turns
    FROM keyed k LEFT JOIN own b ON b.conv_id = k.conv_id - k.conv_id % 5
), steps AS (
    SELECT conv_id, len(turns) AS long, d.d AS depth, turns[1:d.d] AS prefix, turns[1:d.d - 1] AS above, turns[d.d].t AS last
    FROM built, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d) d
), nodes AS (
    SELECT prefix, depth, any_value(above) AS above, any_value(last) AS last, min(conv_id) AS conv_id, count(*) AS n_convs,
           coalesce(string_agg(CASE WHEN long = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends
    FROM steps GROUP BY prefix, depth
), kids AS (SELECT above AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above),
full_nodes AS (
    SELECT n.*, coalesce(k.n_children, 0) AS n_children, (n.n_convs - 1) * coalesce(strlen(n.last), 0) AS saved
    FROM nodes n LEFT JOIN kids k ON k.prefix = n.prefix
), sums AS (
    SELECT prefix[1:d.d] AS prefix, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
    FROM full_nodes, LATERAL (SELECT unnest(range(0, depth + 1)) AS d) d GROUP BY 1
)
SELECT n.conv_id, n.depth::BIGINT AS depth, CASE WHEN n.depth > 0 THEN p.conv_id END AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       n.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_nodes n JOIN sums s ON s.prefix = n.prefix LEFT JOIN full_nodes p ON n.depth > 0 AND p.prefix = n.above
"""
