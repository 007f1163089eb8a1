"""Purchase check: similar owned garments and the looks a candidate allows.

A pair scores 40 for the same category, 25 for the same subtype, 15 for color,
10 for pattern and 10 for material, and counts as similar from 65. So only a
garment of the candidate's category can be similar, and it must share one of
eleven sets of further attributes. For each such set the owner's garments are
indexed by the values of the set, and only the first six per entry are kept:
a garment beyond them is outranked by those six for any candidate. Candidates
look up their own eleven entries. The result is exact and the work grows with
garments plus candidates, never with their product. Before, garments are looked
up under the three smallest of the sets: one that meets no candidate there can
meet none under any set, and gets no entries.
"""

from __future__ import annotations

from itertools import combinations as subsets

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from closetlake.functions.taxonomy import BASE_SLOTS, SLOTS, base_kind, taxonomy_values, with_taxonomy
from closetlake.functions.text import search_key
from closetlake.functions.values import first_number
from closetlake.operators.common import exploded, newest_first, top_k
from closetlake.operators.garments import purchase_usable

# Fixed values.
CATEGORY_WEIGHT = 40
WEIGHTS = {"sub_category": 25, "primary_color": 15, "pattern": 10, "material": 10}
THRESHOLD = 65
SIMILAR_LIMIT = 6
ROTATIONS = 12

# Sets of attributes that, with the category, reach the threshold.
QUALIFYING = [
    names
    for size in range(1, len(WEIGHTS) + 1)
    for names in subsets(WEIGHTS, size)
    if CATEGORY_WEIGHT + sum(WEIGHTS[n] for n in names) >= THRESHOLD
]
#: Those that hold no other one; garments alike in any of the sets are alike in one of these.
SMALLEST = [names for names in QUALIFYING if not any(set(other) < set(names) for other in QUALIFYING)]


def compatibility_score(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """Score from normalised values; two missing values agree.

    Both sides map ``norm_category`` and the attribute names to columns.
    """
    score = F.when(left["norm_category"] == right["norm_category"], CATEGORY_WEIGHT).otherwise(0)
    for name, weight in WEIGHTS.items():
        score = score + F.when(left[name] == right[name], weight).otherwise(0)
    return score


def _with_keys(df: DataFrame) -> DataFrame:
    return with_taxonomy(df).withColumns({f"k_{n}": search_key(n) for n in WEIGHTS})


def _entries(sets: list[tuple[str, ...]] = QUALIFYING) -> Column:
    """The index entries of a row: which set, and its values as one text."""
    return F.explode(
        F.array(*[
            F.struct(F.lit(i).alias("set_no"), F.concat_ws("|", *[F.col(f"k_{n}") for n in names]).alias("set_key"))
            for i, names in enumerate(sets)
        ])
    ).alias("e")


def _alike(owned: DataFrame, candidates: DataFrame, order: list[Column]) -> DataFrame:
    """The owned garments that are alike to a candidate in one of the smallest sets, six of those alike in every attribute.

    Garments alike in every attribute stand in for each other, so six suffice.
    """
    entry = ["user_id", "norm_category", "set_no", "set_key"]
    met = owned.select("*", _entries(SMALLEST)).select("*", "e.set_no", "e.set_key").drop("e")
    asked = candidates.select("*", _entries(SMALLEST)).select("user_id", "norm_category", "e.set_no", "e.set_key").distinct()
    same = ["user_id", "norm_category", *[f"k_{n}" for n in WEIGHTS]]
    first = top_k(met.join(asked, entry, "left_semi"), same, [F.col("set_no"), *order], SIMILAR_LIMIT, "_n")
    # Garments alike in every attribute meet under the same sets, each once under the first of them.
    lowest = F.min("set_no").over(Window.partitionBy(*same))
    return first.withColumn("_first", lowest).filter(F.col("set_no") == F.col("_first")).drop("_n", "_first", "set_no", "set_key")


def similar_garments(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Up to six similar owned garments per candidate, best first."""
    keys = [f"k_{n}" for n in WEIGHTS]
    order = [F.col("newest"), F.col("item_id")]
    candidates = _with_keys(candidates)
    # Only garments of an owner and category that a candidate has can be similar to one.
    asked = candidates.select("user_id", "norm_category").distinct()
    owned = _with_keys(items.filter(purchase_usable()).transform(with_taxonomy).join(asked, ["user_id", "norm_category"], "left_semi")).select(
        "user_id", "item_id", "norm_category", newest_first("created_at").alias("newest"), *keys
    )
    index = _alike(owned, candidates, order).select("*", _entries()).select("*", "e.set_no", "e.set_key").drop("e")
    index = top_k(index, ["user_id", "norm_category", "set_no", "set_key"], order, SIMILAR_LIMIT, "_n").drop("_n")
    wanted = (
        candidates
        .select("user_id", "candidate_id", "norm_category", *[F.col(k).alias(f"c_{k}") for k in keys], *keys)
        .select("*", _entries()).select("*", "e.set_no", "e.set_key").drop("e", *keys)
    )
    pairs = wanted.join(index, ["user_id", "norm_category", "set_no", "set_key"])
    # A pair can meet under several sets; keep it under exactly the one it agrees on.
    agreed = [F.col(f"c_k_{n}") == F.col(f"k_{n}") for n in WEIGHTS]
    exact = F.lit(-1)
    for i, names in enumerate(QUALIFYING):
        whole = F.lit(True)
        for name, same in zip(WEIGHTS, agreed):
            whole = whole & (same if name in names else ~same)
        exact = F.when(whole, F.lit(i)).otherwise(exact)
    score = compatibility_score(
        {"norm_category": F.col("norm_category"), **{n: F.col(f"c_k_{n}") for n in WEIGHTS}},
        {"norm_category": F.col("norm_category"), **{n: F.col(f"k_{n}") for n in WEIGHTS}},
    )
    scored = pairs.filter(F.col("set_no") == exact).select(
        "user_id", "candidate_id", "item_id", "newest", score.alias("score")
    )
    return top_k(
        scored, ["user_id", "candidate_id"], [F.col("score").desc(), *order], SIMILAR_LIMIT
    ).select("user_id", "candidate_id", "rank", "item_id", "score")


def slot_pools(items: DataFrame) -> DataFrame:
    """Per owner and slot, the first twelve usable garments, as lists.

    Twelve rotations never reach past the twelfth garment, and a rotation over a
    longer list picks the same ones, so nothing is lost.
    """
    usable = with_taxonomy(items.filter(purchase_usable())).select(
        "user_id", "slot", "item_id", newest_first("created_at").alias("newest")
    )
    bounded = top_k(usable, ["user_id", "slot"], [F.col("newest"), F.col("item_id")], ROTATIONS)
    picked = F.struct("rank", "item_id")
    return bounded.groupBy("user_id").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("slot") == s, picked))).alias(s) for s in SLOTS]
    ).select("user_id", *[F.transform(s, lambda x: x["item_id"]).alias(s) for s in SLOTS])


def _rotations(bases: list[str]) -> Column:
    def picks(i: Column) -> Column:
        chosen = [F.when(F.size(b) > 0, F.get(F.col(b), (i % F.size(b)).cast("int"))) for b in bases]
        return F.array_compact(F.array(*chosen))

    rotated = F.transform(F.sequence(F.lit(0), F.lit(ROTATIONS - 1)), picks)
    return F.array_distinct(F.filter(rotated, lambda ids: F.size(ids) >= 2))


def combination_lists(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct combinations per owner and kind of candidate slot.

    All candidates of an owner with the same kind of slot share them, so they
    are built once per (owner, kind).
    """
    kinds = candidates.select("user_id", "kind").distinct()
    built = F.when(F.lit(False), _rotations(BASE_SLOTS["other"]))
    for kind, bases in BASE_SLOTS.items():
        built = built.when(F.col("kind") == kind, _rotations(bases))
    return kinds.join(slot_pools(items), "user_id").select("user_id", "kind", built.alias("combinations"))


def with_kind(candidates: DataFrame, values: DataFrame | None = None) -> DataFrame:
    return with_taxonomy(candidates, values).withColumn("kind", base_kind("slot"))


def combinations(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Combinations of owned pieces around each candidate, one row per piece."""
    wanted = with_kind(candidates).select("user_id", "candidate_id", "kind")
    lists = combination_lists(wanted, items)
    one = exploded(
        wanted.join(lists, ["user_id", "kind"]), ["user_id", "candidate_id"], "combinations", "combination_no", "ids"
    )
    return exploded(one, ["user_id", "candidate_id", "combination_no"], "ids", "pos", "item_id")


def purchase_check(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Counts, expected wears, cost per wear and verdict per candidate.

    Category and slot of tables that lack them are found once for each different value.
    """
    untagged = [t for t in (candidates, items) if not {"norm_category", "slot"} <= set(t.columns)]
    values = taxonomy_values(*untagged) if untagged else None
    candidates, items = with_kind(candidates, values), with_taxonomy(items, values)
    wanted = candidates.select("user_id", "candidate_id", "price", "kind")
    similar = similar_garments(candidates, items).groupBy("user_id", "candidate_id").agg(
        F.count(F.lit(1)).alias("similar")
    )
    lists = combination_lists(wanted, items).select(
        "user_id", "kind", F.size("combinations").alias("n"),
        F.size(F.array_distinct(F.flatten("combinations"))).alias("pieces"),
    )
    joined = wanted.join(lists, ["user_id", "kind"], "left").join(similar, ["user_id", "candidate_id"], "left")
    n = F.coalesce("n", F.lit(0))
    alike = F.coalesce("similar", F.lit(0))
    wears = F.greatest(F.lit(5), F.least(F.lit(30), F.coalesce(first_number(n * 2), F.lit(5))))
    return joined.select(
        "user_id", "candidate_id", alike.alias("similar_items"), n.cast("bigint").alias("possible_outfits"),
        F.coalesce("pieces", F.lit(0)).cast("bigint").alias("compatible_pieces"),
        wears.cast("bigint").alias("expected_wears"),
        F.when(F.col("price") > 0, F.round(F.col("price") / wears).cast("bigint")).alias("cost_per_wear"),
        F.when(alike >= 2, "duplicate").when(n >= 4, "strong_buy").otherwise("consider").alias("verdict"),
    )
