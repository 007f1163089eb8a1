"""Mixing sources to target weights by weighted fair queueing.

Sources get shares of a budget of words by weight, none more than ``MOST_EPOCHS``
times what it has. Each source queues its documents in shuffled order, once per
epoch. A queued document's virtual finish time is the number of its source's
words up to and including it, divided by the source's target; the mix takes
documents by finish time until the budget is spent, so at any point all sources
have got about the same part of their targets.

Running sums never put a source or the whole table into one task. Each document
gets a place in [0, 1) from its hash; places are cut into cells of about
``CELL_ROWS`` rows in two levels, sums per cell are added up over cells, and only
within a cell are documents added one by one. The same cells find the finish
time at which the budget ends, so the global order needs no sort of all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from closetlake.llm.common import hidden, prepare, stored, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
CELL_ROWS = 500
COARSE = 1024


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shuffle_key() -> Column:
    """A fixed random order of rows: 32 hex digits of id and text."""
    return F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))


def place(key: str) -> Column:
    """The key's first 13 hex digits as a number in [0, 1)."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """Add ``rank`` and ``target`` to a table of sources (``source``, ``source_size``, few rows).

    Sources in code point order, null last, get the weights in turn. The budget is
    ``share`` of all sizes; a source whose share by weight exceeds ``most`` times its
    size stops there and the rest is shared anew, which is one search for the
    level at which the capped and the uncapped add up to the budget.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(turn, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", "rank").rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    levels = (
        ranked.withColumn("budget", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        # The first source (by ratio) that stays below its cap sets the level; later rows give less, earlier ones exceed their cap.
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    )
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return levels.select("source", "source_size", "rank", target.alias("target"), "budget")


def queued(rows: DataFrame) -> DataFrame:
    """Add ``upto``: words of the source up to and including the row, in shuffled order.

    ``rows`` has ``source``, ``source_rows``, ``key``, ``u`` (place), ``doc_id`` and ``size``.
    """
    fine = F.floor(F.col("u") * F.ceil(F.col("source_rows") / CELL_ROWS)).cast("long")
    rows = rows.withColumn("coarse", F.floor(F.col("u") * COARSE).cast("int")).withColumn("fine", fine)
    cells = rows.groupBy("source", "coarse", "fine").agg(F.sum("size").alias("words"))
    earlier = Window.unboundedPreceding, -1
    in_coarse = F.coalesce(F.sum("words").over(Window.partitionBy("source", "coarse").orderBy("fine").rowsBetween(*earlier)), F.lit(0))
    cells = cells.withColumn("in_coarse", in_coarse)
    tops = rows.groupBy(F.col("source").alias("_s"), F.col("coarse").alias("_c")).agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("_s").orderBy("_c").rowsBetween(*earlier)), F.lit(0))
    tops = tops.select("_s", "_c", before.alias("before"))
    at_top = F.col("source").eqNullSafe(F.col("_s")) & (F.col("coarse") == F.col("_c"))
    o = cells.join(tops, at_top).select("_s", "_c", F.col("fine").alias("_f"), (F.col("before") + F.col("in_coarse")).alias("offset"))
    own = Window.partitionBy("source", "coarse", "fine").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("upto", F.sum("size").over(own))
    joined = summed.join(o, at_top & (F.col("fine") == F.col("_f")))
    return joined.withColumn("upto", F.col("upto") + F.col("offset")).drop("_s", "_c", "_f", "offset", "coarse", "fine")


def _entries(rows: DataFrame, epochs: int) -> DataFrame:
    """One row per document and epoch that holds words, with its finish time."""
    rows = rows.filter(F.col("size") > 0)
    out = rows.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
    return out.withColumn("finish", finish(F.col("epoch")))


def finish(epoch: Column) -> Column:
    return (F.col("upto") + epoch * F.col("source_size")) / F.col("target")


ORDER = ["finish", "rank", "epoch", "key", "doc_id", "size"]


def _cutoff(entries: DataFrame, budget: int) -> tuple | None:
    """The first entry (as its order) that the budget does not hold whole, and the words left for it."""
    span = entries.agg(F.count(F.lit(1)).alias("n"), F.max("finish").alias("top")).first()
    if not span["n"]:
        return None
    low, high, spent, n = 0.0, math.nextafter(span["top"], math.inf), 0, span["n"]
    # Narrow the stretch of finish times in which the budget ends, by sums per cell.
    while n > 4 * CELL_ROWS and high - low > 1e-12 * high:
        width = (high - low) / COARSE
        cell = F.least(F.floor((F.col("finish") - low) / width), F.lit(COARSE - 1)).cast("int")
        inside = entries.filter((F.col("finish") >= low) & (F.col("finish") < high))
        sums = inside.groupBy(cell.alias("cell")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.min("finish").alias("low"), F.max("finish").alias("top")).orderBy("cell").collect()
        for s in sums:
            if spent + s["words"] > budget:
                break
            spent += s["words"]
        else:
            return None
        if s["n"] == n:
            break
        low, high, n = s["low"], math.nextafter(s["top"], math.inf), s["n"]
    # Entries within the last stretch, in order. A source has one entry at most at any one time,
    # so there are no more of them than CELL_ROWS and sources.
    inside = entries.filter((F.col("finish") >= low) & (F.col("finish") < high))
    order = Window.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    last = inside.withColumn("upto_here", F.sum("size").over(order)).filter(F.col("upto_here") + spent > budget)
    first = last.orderBy(*ORDER).select(*ORDER, "upto_here").first()
    return None if first is None else (first, budget - spent - (first["upto_here"] - first["size"]))


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, source): its size, its source's size and target, and the words taken.

    Every row comes back once: ``doc_id``, ``source``, ``key``, ``size``, ``source_size``, ``target``
    and ``taken`` (at most ``most`` times its size; the row at which the budget ends may give
    part of its words). Null texts have size 0 and take nothing; a null source is a source.
    """
    sized = stored(docs.select("doc_id", "source", shuffle_key().alias("key"), word_count().alias("size")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    goals = targets(sizes, weights, share, most).join(
        sizes.select(F.col("source").alias("_s"), "source_rows"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    goals = stored(goals)
    known = goals.withColumnRenamed("source", "_s")
    rows = sized.join(known, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("u", place("key"))
    rows = stored(queued(rows).drop("u", "source_rows"))
    first = goals.select("budget").first()
    end = _cutoff(_entries(rows, most), math.floor(first["budget"])) if first else None
    taken = F.lit(0).cast("long")
    for epoch in range(most):
        whole = F.col("size")  # of this epoch, as long as the budget lasts
        if end is not None:
            at, rest = end
            here = F.struct(finish(F.lit(epoch)), F.col("rank"), F.lit(epoch), F.col("key"), F.col("doc_id"), F.col("size"))
            edge = F.struct(*[F.lit(at[c]).cast(t) for c, t in zip(ORDER, ("double", "int", "int", "string", "long", "long"), strict=True)])
            whole = F.when(here < edge, F.col("size")).when(here == edge, F.lit(rest)).otherwise(0)
        taken = taken + F.when(F.col("size") > 0, whole).otherwise(0)
    return rows.select("doc_id", "source", "key", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix_rows(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """The mixed corpus: rows of ``docs`` as often as the mix takes them, whole, with all their columns.

    The row at which the budget ends stays if half of it is taken. Rows without words, as null texts, are
    never taken; a null source is a source. Rows alike in id, text and source share what the mix takes of them
    as evenly as whole rows can, in the order of a hash of all columns.
    """
    key, theirs, source, copies, alike, number = hidden(docs, "key", "their_key", "their_source", "copies", "alike", "number")
    found = mixed(docs, weights, share, most)
    # A row that the mix takes in part counts by the nearest whole number.
    plan = found.withColumn("c", F.round(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("long")).groupBy(
        F.col("key").alias(theirs), F.col("source").alias(source)).agg(F.sum("c").alias(copies), F.count(F.lit(1)).alias(alike))
    plan = plan.filter(F.col(copies) > 0)
    joined = docs.withColumn(key, shuffle_key()).join(plan, (F.col(key) == F.col(theirs)) & F.col("source").eqNullSafe(F.col(source)))
    even = F.col(copies) % F.col(alike) == 0
    plain = joined.filter(even).withColumn(number, (F.col(copies) / F.col(alike)).cast("long"))
    # Where copies are left over, equal rows become one with their number; the n-th of all gets as many as the share up to it grows by.
    same = [*docs.columns, key, source, copies, alike]
    uneven = joined.filter(~even).groupBy(*[F.col(f"`{c}`") for c in same]).agg(F.count(F.lit(1)).alias(number))
    order = Window.partitionBy(key, source).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    upto = F.sum(number).over(order.rowsBetween(Window.unboundedPreceding, 0))
    part = lambda n: F.floor(F.col(copies) * n / F.col(alike))
    uneven = uneven.withColumn(number, part(upto) - part(upto - F.col(number)))
    out = plain.select(*docs.columns, number).unionByName(uneven.select(*docs.columns, number))
    return out.filter(F.col(number) > 0).withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.col(number)))).select(*docs.columns)


def op3_source_mixing(spark, sf_dir):
    """Words the mix takes of every document."""
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text", "source")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = """
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS k,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, 1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM sizes),
weighed AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap
  FROM ranked),
levels AS (
  SELECT *, cap / weight AS ratio,
    (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
goals AS (
  SELECT source, source_size, rank, budget,
    least(cap, coalesce(max(CASE WHEN level <= ratio THEN level END) OVER () * weight, cap)) AS target
  FROM levels),
queued AS (
  SELECT s.doc_id, s.k, s.size, g.source_size, g.rank, g.target, g.budget,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id NULLS FIRST, s.size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto,
    row_number() OVER () AS id
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
entries AS (
  SELECT q.*, e.epoch, (upto + e.epoch * source_size)::DOUBLE / target AS finish
  FROM queued q, (VALUES (0), (1)) AS e(epoch) WHERE size > 0),
spent AS (
  SELECT id, size, floor(budget)::BIGINT AS budget,
    sum(size) OVER (ORDER BY finish, rank, epoch, k, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto_here
  FROM entries),
took AS (
  SELECT id, sum(greatest(0, least(size, budget - (upto_here - size))))::BIGINT AS taken FROM spent GROUP BY id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM queued q LEFT JOIN took t USING (id)
"""
