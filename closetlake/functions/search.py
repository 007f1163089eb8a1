"""Synonym-aware garment search."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closetlake.functions.taxonomy import garment_category
from closetlake.functions.text import search_keys
from closetlake.functions.values import col

# A term stands for every word of the first group that holds it.
SYNONYM_GROUPS = [
    ["tshirt", "tshirts", "tee", "tees", "teeshirt", "teeshirts"],
    ["shoe", "shoes", "sneaker", "sneakers", "trainer", "trainers", "footwear", "sportsshoes"],
    ["watch", "watches", "accessory", "accessories"],
    ["bag", "bags", "handbag", "handbags", "purse", "purses", "accessory", "accessories"],
    ["belt", "belts", "accessory", "accessories"],
    ["jewellery", "jewelry", "jewel", "accessory", "accessories"],
    ["scarf", "scarves", "accessory", "accessories"],
    ["sunglass", "sunglasses", "eyewear", "accessory", "accessories"],
    ["trouser", "trousers", "pant", "pants", "slacks"],
    ["jacket", "jackets", "coat", "coats", "outerwear", "layer"],
]


def _synonym_map() -> Column:
    first_group: dict[str, list[str]] = {}
    for group in SYNONYM_GROUPS:
        for word in group:
            first_group.setdefault(word, group)
    entries = []
    for word, group in first_group.items():
        entries += [F.lit(word), F.array(*[F.lit(w) for w in group])]
    return F.create_map(*entries)


def _known(term) -> Column:
    return col(term).isin(sorted({word for group in SYNONYM_GROUPS for word in group}))


def aliases(term) -> Column:
    """The synonym group of a term, or just the term."""
    # The set test is hashed and most terms fail it; only the rest reach the map.
    return F.when(_known(term), F.try_element_at(_synonym_map(), col(term))).otherwise(F.array(col(term)))


def search_text(title, category, sub_category, primary_color, secondary_colors, pattern, tags, brand) -> Column:
    """All searchable values of a garment, normalised, with their synonyms."""
    empty = F.array().cast("array<string>")
    values = F.concat(
        F.array(col(title), garment_category(category, sub_category), col(category),
                col(sub_category), col(primary_color)),
        F.coalesce(col(secondary_colors), empty),
        F.array(col(pattern)),
        F.coalesce(col(tags), empty),
        F.array(col(brand)),
    )
    # A key without synonyms is its own alias.
    expanded = F.flatten(F.transform(search_keys(values), lambda k: F.when(_known(k), F.concat(F.array(k), aliases(k))).otherwise(F.array(k))))
    return F.array_join(F.array_distinct(expanded), " ")


def query_words(query: str) -> list[list[str]]:
    """For each word of a query, the texts that count as finding it."""
    words = [re.sub("[^a-z0-9]+", "", w.lower().replace("&", " and ")) for w in query.split()]
    first = {w: group for group in reversed(SYNONYM_GROUPS) for w in group}
    return [[w, *[a for a in first.get(w, []) if a != w]] for w in words if w]


def matches(haystack, query: str) -> Column:
    """Every query word, or one of its synonyms, occurs in the search text.

    The search text is bound once per row: a filter is moved below the projection
    that builds the text, where each mention would build it again.
    """

    def test(hay: Column) -> Column:
        found = F.lit(True)
        for texts in query_words(query):
            found = found & reduce(Column.__or__, [F.contains(hay, F.lit(x)) for x in texts])
        return found

    return F.exists(F.array(col(haystack)), test)


def with_search_text(garments: DataFrame) -> DataFrame:
    """Add ``search_text``; columns the table lacks count as null.

    A table that was stored with it is returned as it is.
    """
    if "search_text" in garments.columns:
        return garments

    def field(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in garments.columns else F.lit(None).cast(kind)

    return garments.withColumn(
        "search_text",
        search_text(
            field("title"), field("category"), field("sub_category"), field("primary_color"),
            field("secondary_colors", "array<string>"), field("pattern"),
            field("tags", "array<string>"), field("brand"),
        ),
    )
