"""Wardrobe listings: filters, detail rows, per-garment figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closetlake.functions.search import matches, with_search_text
from closetlake.functions.text import list_text
from closetlake.functions.values import cost_per_wear, first_text, is_true
from closetlake.operators.common import exploded, newest_first, top_k
from closetlake.schemas import conform

OWNER_READ_LIMIT = 150


def in_lookbook() -> Column:
    """The explicit flag, else whether the type says lookbook."""
    return F.coalesce("in_lookbook", F.col("type") == "lookbook", F.lit(False))


def purchase_usable() -> Column:
    return ~is_true("hidden_from_ai") & (F.coalesce("laundry_status", F.lit("")) != "Laundry")


def in_view(view: str) -> Column:
    """Filter of the wardrobe: all, favorite or clean garments."""
    clean = F.coalesce(F.col("laundry_status") == "Clean", F.lit(False))
    return {"all": F.lit(True), "favorite": is_true("favorite"), "clean": clean}[view]


def search_garments(items: DataFrame, query: str, view: str = "all") -> DataFrame:
    """Garments matching a search, within all, favorite or clean ones."""
    return search_views(items, {view: query}).drop("shown")


def search_views(items: DataFrame, queries: dict[str, str]) -> DataFrame:
    """Garments matching the search of each view, with the view as ``shown``; search texts are built once for all."""
    wanted = reduce(Column.__or__, [in_view(view) for view in queries])
    tests = [F.when(in_view(view) & matches("search_text", query), view) for view, query in queries.items()]
    found = with_search_text(items.filter(wanted))
    rows = exploded(found, ["*"], F.array_compact(F.array(*tests)), "_n", "shown")
    return rows.drop("_n", "search_text")


def owner_read(items: DataFrame) -> DataFrame:
    """At most 150 garments per owner, by id."""
    return top_k(items, ["user_id"], [F.col("item_id")], OWNER_READ_LIMIT, "_n").drop("_n")


def recent_garments(items: DataFrame, count: int = 4) -> DataFrame:
    return top_k(items, ["user_id"], [newest_first("created_at"), F.col("item_id")], count)


def cost_per_wear_list(items: DataFrame) -> DataFrame:
    """Priced garments with what the listing sorts by: ``sort_cost``, then newest.

    Never-worn ones sort by their full price and show no cost.
    """
    return items.filter(F.col("purchase_price") > 0).select(
        "user_id", "item_id", "title", "purchase_price", "created_at",
        F.coalesce("times_worn", F.lit(0)).alias("times_worn"),
        (F.col("purchase_price") / F.greatest(F.coalesce("times_worn", F.lit(0)), F.lit(1))).alias("sort_cost"),
        cost_per_wear("purchase_price", "times_worn").alias("cost_per_wear"),
    )


def detail_rows(items: DataFrame) -> DataFrame:
    """Labelled attributes of each garment, one row per attribute that has a value."""
    g = conform(items, "wardrobe")

    def word(c: Column) -> Column:
        return c.cast("string")

    rated = F.regexp_replace(word(F.col("rating")), r"\.0$", "")
    pairs = [
        ("Category", F.col("category")), ("Subcategory", F.col("sub_category")),
        ("Brand", F.col("brand")), ("Primary color", F.col("primary_color")),
        ("Secondary colors", list_text("secondary_colors")), ("Pattern", F.col("pattern")),
        ("Fit", F.col("fit")), ("Material", first_text("material", "fabric")),
        ("Sleeves", F.col("sleeve_type")), ("Neckline", F.col("neckline")),
        ("Season", list_text("season")), ("Occasions", list_text(F.coalesce("user_occasions", "occasion"))),
        ("Formality", F.col("formality")), ("Laundry", F.col("laundry_status")),
        ("Times worn", word(F.coalesce("times_worn", F.lit(0)))),
        ("Last worn", F.coalesce(word(F.col("last_worn")), F.lit("Never"))),
        ("Purchase year", word(F.col("purchase_year"))),
        ("Purchase price", F.when(F.col("purchase_price") != 0, word(F.round("purchase_price").cast("bigint")))),
        ("Rating", F.when(F.col("rating") != 0, F.concat(rated, F.lit("/5")))),
        ("AI visibility", F.when(is_true("hidden_from_ai"), "Hidden").otherwise("Available")),
        ("Background prepared", F.when(F.col("bg_removed"), "Yes").when(~F.col("bg_removed"), "No")),
        ("Tags", list_text("tags")),
    ]
    return labelled_rows(g, ["user_id", "item_id"], pairs).filter(F.col("value") != "")


def labelled_rows(df: DataFrame, keys: list[str], pairs: list[tuple[str, Column]]) -> DataFrame:
    """One (keys, label, value) row per pair."""
    rows = F.array(*[F.struct(F.lit(n).alias("label"), v.alias("value")) for n, v in pairs])
    return df.select(*keys, F.inline(rows))


def category_totals(items: DataFrame) -> DataFrame:
    """Garments per normalised category; expects ``norm_category``."""
    return items.groupBy("user_id", "norm_category").agg(F.count(F.lit(1)).alias("garments"))


def attribute_filter(color=None, season=None, occasion=None, category=None, laundry=None) -> Column:
    """Filter by any of the wardrobe attributes; ``None`` leaves one open."""
    test = F.lit(True)
    for name, wanted in (("primary_color", color), ("norm_category", category), ("laundry_status", laundry)):
        if wanted is not None:
            test = test & (F.col(name) == wanted)
    for name, wanted in (("season", season), ("occasion", occasion)):
        if wanted is not None:
            test = test & F.array_contains(name, wanted)
    return test
