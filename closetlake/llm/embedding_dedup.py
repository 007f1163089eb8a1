"""Near-duplicate embeddings by collision-counting projections.

Unit vectors are projected on many random directions, scaled so that a projection of
evenly spread vectors has a deviation of one. Two vectors with the wanted cosine differ
little in each: they collide where one lies in the window around the other.

1. Equal vectors of a label become one row with a count.
2. A window of one direction holds a fixed share of all vectors, so counting over all of them would
   be quadratic. Vectors are first dealt into cells: a table cuts a few directions
   into slabs at random offsets, and a pair is met if it shares the cell of any table.
   How many directions and tables there are follows from the number of vectors, so
   that a vector of a bounded sample meets about ``MATES`` others by chance and
   all tables miss at most ``MISS`` of the pairs at the threshold.
3. Within a cell, each counted direction is sorted; each vector's window is a range of
   ranks. Pairs are candidates if at least as many windows collide as all but ``MISS`` of the pairs at
   the threshold have; this count is calibrated by simulation with the same directions.
4. The first pass does so on one byte per direction and keeps the vectors that have any candidate, so only these
   are shuffled as a whole. The second pass verifies candidates by cosine in double precision
   and counts a pair in the first table that it meets in.

Cells above ``BLOCK`` vectors are cut into blocks by hash; each pair of blocks is a task's
work of bounded size. A pair is never a row: a block returns for each vector the number of links and one
link towards its group. Within a group of different near-copies the work
is that of verifying its pairs, as each must be counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closetlake.llm.common import prepare, sized_broadcast, stored, table
from closetlake.llm.components import components
from closetlake.llm.hashing import mix

COSINE = 0.98
#: Share of the pairs at the threshold that cells, and that counts, may lose.
MISS = 0.01
#: Directions whose collisions are counted.
COUNTED = 32
#: Vectors met by chance, and the sample this is measured on.
MATES, SAMPLE = 64, 1_000
#: Width of a slab, and half of a window in deviations of a difference at the threshold.
SLAB, WINDOW = 2.0, 2.0
#: Directions that a cell is made of at most (cells are cut into blocks beyond).
MOST_CUT = 20
#: Vectors of a block.
BLOCK = 2048
#: Groups of so many vectors are compared alone, smaller ones together; pairs counted at a time.
DENSE, PAIRS = 256, 1_000_000
#: Steps of a projection that is kept as one byte.
STEP = 1 / 28
SEED = 11


def _directions(d: int, n: int, what: int) -> np.ndarray:
    """``n`` random directions as columns, orthogonal in groups of ``d``, of length sqrt(d)."""
    rng = np.random.default_rng([SEED, d, what])
    found = [np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(-(-n // d))]
    return np.hstack(found)[:, :n] * np.sqrt(d)


def _differences(d: int, cosine: float, n: int) -> np.ndarray:
    """Random differences of two unit vectors with the given cosine."""
    x = np.random.default_rng([SEED, d]).standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True) * np.sqrt(2 - 2 * cosine)


class Model:
    """Directions of all tables and counted ones for vectors of ``d`` components."""

    def __init__(self, d: int, cut: int, cosine: float):
        self.cut, missed = cut, np.ones(4000)
        apart = _differences(d, cosine, len(missed))
        tables = []
        while missed.mean() > MISS:
            tables.append(_directions(d, cut, 1 + len(tables)))
            missed *= 1 - np.maximum(0, 1 - np.abs(apart @ tables[-1]) / SLAB).prod(axis=1)
        self.tables = np.hstack(tables)
        self.offsets = np.random.default_rng([SEED, d, 0]).uniform(0, SLAB, self.tables.shape[1])
        self.counted = _directions(d, COUNTED, 0)
        # Half a window in steps, and one step for rounding.
        self.half = int(WINDOW * np.sqrt(2 - 2 * cosine) / STEP) + 1
        collisions = (np.abs(_differences(d, cosine, 40_000) @ self.counted) <= self.half * STEP - STEP).sum(axis=1)
        self.least = int(np.quantile(collisions, MISS, method="lower"))

    def cells(self, unit: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The cell of each vector in each table, as a hash."""
        slabs = np.floor((unit @ self.tables + self.offsets) / SLAB).astype(np.int64).view(np.uint64)
        start = mix(label.astype(np.int64).view(np.uint64) ^ np.uint64(unit.shape[1] << 32))
        out = []
        with np.errstate(over="ignore"):
            for t in range(slabs.shape[1] // self.cut):
                key = mix(start + np.uint64(t))
                for k in range(self.cut):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + slabs[:, t * self.cut + k])
                out.append(key.view(np.int64))
        return np.stack(out, axis=1)

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        """Counted projections in steps; far ones are cut, which only adds collisions."""
        return np.clip(np.rint(unit @ self.counted / STEP), -127, 127).astype(np.int8)


@lru_cache(maxsize=64)
def model(d: int, cut: int, cosine: float) -> Model:
    return Model(d, cut, cosine)


def candidates(a: np.ndarray, b: np.ndarray, half: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of two sketches of which at least ``least`` windows collide, some queries at a time.

    Each direction of ``b`` is sorted; the window around a query is a range of ranks there.
    """
    ranks, lows, widths = [], [], []
    for x, y in zip(a.T.astype(np.int16), b.T.astype(np.int16), strict=True):
        order = np.argsort(y, kind="stable")
        rank = np.empty(len(y), dtype=np.uint16)
        rank[order] = np.arange(len(y))
        low = np.searchsorted(y[order], x - half, side="left")
        ranks.append(rank)
        lows.append(low.astype(np.uint16))
        widths.append((np.searchsorted(y[order], x + half, side="right") - low).astype(np.uint16))
    step = max(1, 1_000_000 // len(b))
    for k in range(0, len(a), step):
        part = slice(k, k + step)
        found = np.zeros((len(a[part]), len(b)), dtype=np.uint8)
        for rank, low, width in zip(ranks, lows, widths, strict=True):
            found += (rank[None, :] - low[part, None]) < width[part, None]
        i, j = np.nonzero(found >= least)
        yield i + k, j


def _units(vectors: np.ndarray) -> np.ndarray:
    # Divided by the largest component first, so that squares neither overflow nor vanish.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _as_array(x) -> np.ndarray | None:
    """A vector in double precision; None where it cannot link."""
    if x is None:
        return None
    v = np.asarray(x, dtype=np.float64)
    return v if len(v) and np.isfinite(v).all() and v.any() else None


def named(rows: DataFrame) -> DataFrame:
    """``vec_id``, ``node`` (a name of label and vector; null where a row cannot link), ``label`` and ``embedding``."""

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes = []
            for x, label in zip(batch["embedding"], batch["label"], strict=True):
                v = None if pd.isna(label) else _as_array(x)
                # Adding zero makes -0.0 and 0.0 equal.
                nodes.append(None if v is None else hashlib.blake2b((v + 0.0).tobytes(), digest_size=16, salt=int(label).to_bytes(8, "little", signed=True)).digest())
            yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "node": nodes, "label": batch["label"].astype("Int64"), "embedding": batch["embedding"]})

    kind = rows.schema["embedding"].dataType.simpleString()
    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    return plain.mapInPandas(name, f"vec_id long, node binary, label long, embedding {kind}")


def _by_size(embeddings: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each number of components."""
    sizes = embeddings.map(len).to_numpy()
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, np.stack([np.asarray(x, dtype=np.float64) for x in embeddings.iloc[at]])


def cut_for(nodes: DataFrame, cosine: float) -> int:
    """Directions per cell, so that a vector of a bounded sample shares a cell with about ``MATES`` others of its label by chance."""
    most = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    order = F.xxhash64("node")
    rows = nodes.select("label", "embedding", order.alias("o")).orderBy("o", "node").limit(SAMPLE).toPandas()
    shares, weight = np.zeros(MOST_CUT), 0
    for _, same in rows.groupby("label"):
        for _, vectors in _by_size(same["embedding"]):
            unit = _units(vectors)
            i, j = np.triu_indices(len(unit), 1)
            far = np.einsum("ij,ij->i", unit[i], unit[j]) < cosine
            i, j = i[far], j[far]
            at = unit @ _directions(unit.shape[1], MOST_CUT, 1)
            shares += np.cumprod(np.maximum(0, 1 - np.abs(at[i] - at[j]) / SLAB), axis=1).sum(axis=0)
            weight += len(i)
    fits = np.flatnonzero(most * shares <= MATES * max(1, weight))
    return int(fits[0]) + 1 if len(fits) else MOST_CUT


def in_cells(nodes: DataFrame, cut: int, cosine: float, whole: bool) -> DataFrame:
    """Rows of nodes dealt into cells and blocks; with the vector and all cells (``whole``), or with a sketch only."""
    kind = nodes.schema["embedding"].dataType.simpleString()
    payload = f"keys array<long>, embedding {kind}, n long" if whole else "sketch binary"

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, vectors in _by_size(batch["embedding"]):
                mine, own = batch.iloc[at], model(vectors.shape[1], cut, cosine)
                unit = _units(vectors)
                keys = own.cells(unit, mine["label"].to_numpy())
                rows = {"d": np.int32(vectors.shape[1]), "label": mine["label"].to_numpy(), "node": mine["node"].to_numpy()}
                if whole:
                    rows |= {"keys": list(keys), "embedding": mine["embedding"].to_numpy(), "n": mine["n"].to_numpy()}
                else:
                    rows |= {"sketch": [x.tobytes() for x in own.sketch(unit)]}
                for t in range(keys.shape[1]):
                    yield pd.DataFrame({"cell": keys[:, t], "t": np.int32(t)} | rows)

    columns = ["node", "label", "embedding", "n"] if whole else ["node", "label", "embedding"]
    rows = nodes.select(*columns).mapInPandas(deal, f"cell long, t int, d int, label long, node binary, {payload}")
    keys = nodes.select("node", "label", "embedding").mapInPandas(_cells_only(cut, cosine), "cell long")
    large = stored(keys.groupBy("cell").count().filter(F.col("count") > BLOCK).select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    dealt = rows.join(sized_broadcast(large), "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other")
    return dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "t", "d", "label", "block")


def _cells_only(cut: int, cosine: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, vectors in _by_size(batch["embedding"]):
                keys = model(vectors.shape[1], cut, cosine).cells(_units(vectors), batch["label"].to_numpy()[at])
                yield pd.DataFrame({"cell": keys.ravel()})

    return run


GROUP = ["cell", "i", "j", "t", "d", "label"]


def _whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of whole groups of a sorted stream, many small ones at a time, and the number of each row's group."""
    held: pd.DataFrame | None = None

    def cut(rows):
        keys = rows[GROUP].to_numpy(np.int64)
        new = (keys[1:] != keys[:-1]).any(axis=1)
        return np.concatenate([[0], np.cumsum(new)])

    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        group = cut(rows)
        open_ = int(np.searchsorted(group, group[-1]))
        held = rows.iloc[open_:].reset_index(drop=True)
        if open_:
            yield rows.iloc[:open_], group[:open_]
    if held is not None:
        yield held, cut(held)


def _small_candidates(sketch: np.ndarray, group: np.ndarray, half: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``candidates`` within each of many small groups: all groups are sorted at once by group and projection."""
    n = len(group)
    at = np.arange(n)
    last = np.searchsorted(group, group, side="right")
    base = group.astype(np.int64) * 1024
    ranks, lows, widths = (np.empty((sketch.shape[1], n), dtype=np.uint32) for _ in range(3))
    for k, x in enumerate(sketch.T.astype(np.int64)):
        value = base + x
        order = np.argsort(value, kind="stable")
        ranks[k, order] = at
        lows[k] = np.searchsorted(value[order], value - half, side="left")
        widths[k] = np.searchsorted(value[order], value + half, side="right") - lows[k]
    many = last - at - 1
    upto = np.cumsum(many)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS, side="right")))
        part = many[start:stop]
        i = np.repeat(at[start:stop], part)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(part) - part, part)
        found = np.zeros(len(i), dtype=np.uint8)
        for rank, low, width in zip(ranks, lows, widths, strict=True):
            found += (rank[j] - low[i]) < width[i]
        ok = found >= least
        yield i[ok], j[ok]
        start = stop


def _pairs(rows: pd.DataFrame, group: np.ndarray, sketch: np.ndarray, own: Model) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of row numbers within all groups; groups are small ones together, large ones and block pairs each alone."""
    first, size = np.unique(group, return_index=True, return_counts=True)[1:]
    alone = (size >= DENSE) | (rows["i"].to_numpy() != rows["j"].to_numpy())[first]
    for a, b in zip(first[alone], (first + size)[alone], strict=True):
        block, i, j = rows["block"].to_numpy()[a:b], int(rows["i"].iat[a]), int(rows["j"].iat[a])
        x, y = a + np.flatnonzero(block == i), a + np.flatnonzero(block == j)
        if not len(x) or not len(y):
            continue
        for p, q in candidates(sketch[x], sketch[y], own.half, own.least):
            p, q = x[p], y[q]
            if i == j:
                p, q = p[p < q], q[p < q]
            yield p, q
    some = np.flatnonzero(np.repeat(~alone & (size > 1), size))
    if len(some):
        for p, q in _small_candidates(sketch[some], group[some], own.half, own.least):
            yield some[p], some[q]


def _by_components(rows: pd.DataFrame, group: np.ndarray, cut: int, cosine: float) -> Iterator[tuple[pd.DataFrame, np.ndarray, Model]]:
    d = rows["d"].to_numpy()
    for k in np.unique(d):
        at = np.flatnonzero(d == k)
        yield rows.iloc[at].reset_index(drop=True), group[at], model(int(k), cut, cosine)


def _with_candidates(cut: int, cosine: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for all_, groups_ in _whole_groups(batches):
            for rows, group, own in _by_components(all_, groups_, cut, cosine):
                sketch = np.frombuffer(b"".join(rows["sketch"]), dtype=np.int8).reshape(len(rows), -1)
                found = np.zeros(len(rows), dtype=bool)
                for i, j in _pairs(rows, group, sketch, own):
                    found[i] = found[j] = True
                if found.any():
                    yield pd.DataFrame({"node": rows["node"].to_numpy()[found]}).drop_duplicates()

    return run


def _lowest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest row number reachable from each row by the pairs."""
    low = np.arange(n)
    while True:
        before = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if (low == before).all():
            return low


def _near(unit: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs reach the cosine: from products of matrices where most pairs of some rows are asked for, else one by one."""
    rows_i, at_i = np.unique(i, return_inverse=True)
    rows_j, at_j = np.unique(j, return_inverse=True)
    if len(rows_i) * len(rows_j) <= 4 * len(i):
        return (unit[rows_i] @ unit[rows_j].T)[at_i, at_j] >= cosine
    step = max(1, 4_000_000 // unit.shape[1])
    return np.concatenate([np.einsum("ij,ij->i", unit[i[k: k + step]], unit[j[k: k + step]]) for k in range(0, len(i), step)]) >= cosine


def _linked(cut: int, cosine: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for all_, groups_ in _whole_groups(batches):
            for rows, group, own in _by_components(all_, groups_, cut, cosine):
                unit = _units(np.stack([np.asarray(x, dtype=np.float64) for x in rows["embedding"]]))
                keys, n, t = np.stack(list(rows["keys"])), rows["n"].to_numpy(np.int64), rows["t"].to_numpy()
                earlier = np.arange(keys.shape[1])
                links, low = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
                for i, j in _pairs(rows, group, own.sketch(unit), own):
                    if not len(i):
                        continue
                    ok = _near(unit, i, j, cosine)
                    i, j = i[ok], j[ok]
                    # A pair counts in the first table that it meets in.
                    ok = ~((keys[i] == keys[j]) & (earlier < t[i, None])).any(axis=1)
                    i, j = i[ok], j[ok]
                    links += np.bincount(i, weights=n[j], minlength=len(rows)).astype(np.int64)
                    links += np.bincount(j, weights=n[i], minlength=len(rows)).astype(np.int64)
                    low = _lowest(np.concatenate([i, np.arange(len(rows))]), np.concatenate([j, low]), len(rows))
                at = np.flatnonzero(links)
                if len(at):
                    nodes = rows["node"].to_numpy()
                    yield pd.DataFrame({"node": nodes[at], "links": links[at], "low": nodes[low[at]]})

    return run


def groups(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row of ``rows`` (vec_id, embedding, label).

    Rows link if their labels are equal and the cosine of their vectors reaches ``cosine``. A row links with
    nothing if its label or vector is null, or the vector has no component, only zeros, or one that is null or not
    finite; vectors with different numbers of components do not link. Repeated ids are rows of their own. A row without id
    counts as a link and has the smallest id of its component; it is never kept.
    """
    all_ = named(rows)
    ids = stored(all_.select("vec_id", "node"))
    nodes = stored(all_.filter(F.col("node").isNotNull()).groupBy("node").agg(
        F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"), F.count(F.lit(1)).alias("n")))
    cut = cut_for(nodes, cosine)
    some = stored(in_cells(nodes, cut, cosine, whole=False).mapInPandas(_with_candidates(cut, cosine), "node binary").distinct())
    left = stored(nodes.join(sized_broadcast(some), "node", "left_semi"))
    met = stored(in_cells(left, cut, cosine, whole=True).mapInPandas(_linked(cut, cosine), "node binary, links long, low binary"))
    labels = components(met.filter("node != low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct())
    counted = nodes.select("node", "n").join(met.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(labels, "node", "left")
    counted = counted.select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("label", "node").alias("label"))
    known = stored(ids.join(counted, "node", "left").select("vec_id", "n_links", "label"))
    first = known.filter(F.col("label").isNotNull()).groupBy("label").agg(F.min("vec_id").alias("first"))
    component = F.when(F.col("label").isNull(), F.col("vec_id")).otherwise(F.col("first"))
    return known.join(first, "label", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op11_embedding_dedup(spark, sf_dir):
    """Links and component of every embedding among those of its label, at a cosine of 0.98."""
    return groups(table(prepare(spark), sf_dir, "embeddings"))


#: All pairs, for small tables. ``groups`` finds at least 98 of 100 pairs at the threshold and nearly all above.
OP11_SQL = f"""
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}
), reach AS (SELECT vec_id AS v, vec_id AS r FROM embeddings UNION SELECT reach.v, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id)::BIGINT AS n_links,
       (SELECT min(r) FROM reach WHERE reach.v = e.vec_id) AS component_id, (SELECT min(r) FROM reach WHERE reach.v = e.vec_id) = e.vec_id AS kept
FROM embeddings e
"""
