"""Garment taxonomy: normalised category and outfit slot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closetlake.functions.values import col, is_true, text

# Results depend on these patterns and on their order. They match
# anywhere in the text, so "steel" holds "tee" and is a Top.
CATEGORY_PATTERNS = [
    ("Outerwear", "blazer|jacket|bomber|cardigan|shrug|coat|outerwear|overshirt|hoodie"),
    ("Top", "shirt|t[ -]?shirt|tee|top|blouse|kurta|polo|sweater|sweatshirt|tank"),
    ("One-piece", "dress|gown|jumpsuit|romper|one.?piece|co-ord"),
    ("Traditional set", "saree|sari|lehenga|salwar|anarkali|sherwani|dhoti|traditional set|kurta set"),
    ("Footwear", "shoe|sneaker|trainer|loafer|heel|sandal|boot|footwear|flat"),
    ("Accessory", "bag|belt|watch|jewel|scarf|hat|cap|headwear|eyewear|sunglass|accessor"),
    ("Bottom", "bottom|jean|trouser|pant|chino|short|skirt|legging|palazzo|jogger|cargo"),
]
DEFAULT_CATEGORY = "Top"

# Slot, categories that imply it, whole words that imply it.
SLOT_PATTERNS = [
    ("footwear", ["Footwear"], "footwear|shoes?|sneakers?|trainers?|loafers?|heels?|sandals?|boots?|flats?"),
    ("accessory", ["Accessory"], "accessor(?:y|ies)|watch|bag|belt|jewel(?:lery|ry)?|scarf|hat|cap|headwear|eyewear|sunglasses?"),
    ("layer", ["Outerwear"], "outerwear|jacket|blazer|coat|cardigan|shrug|overshirt|shacket|bomber|hoodie|parka|trench"),
    ("bottom", ["Bottom"], "bottom|pants?|trousers?|jeans?|skirts?|shorts?|leggings?|joggers?|cargo|chinos?|palazzo"),
    ("top", [], "dress shirt|shirts?|t[ -]?shirts?|tees?|tops?|blouses?|kurtas?|polos?|sweaters?|sweatshirts?|tank tops?|crop tops?"),
    ("hero", ["One-piece", "Traditional set"], "dress|gown|jumpsuit|romper|one[ -]?piece|saree|sari|lehenga|anarkali|salwar suit|kurta set|sherwani|dhoti set|traditional set|co-ord set"),
]
SLOTS = ["top", "bottom", "layer", "hero", "footwear", "accessory"]

# The slots that complete a look around a piece of each slot.
BASE_SLOTS = {
    "hero": ["footwear", "accessory"],
    "top": ["bottom", "layer", "footwear", "accessory"],
    "bottom": ["top", "layer", "footwear", "accessory"],
    "other": ["top", "bottom", "footwear", "accessory"],
}


def garment_category(category, sub_category) -> Column:
    value = F.lower(F.concat_ws(" ", text(category), text(sub_category)))
    result = F.lit(DEFAULT_CATEGORY)
    for label, pattern in reversed(CATEGORY_PATTERNS):
        result = F.when(value.rlike(pattern), label).otherwise(result)
    return result


def _whole_word(value: Column, words: str) -> Column:
    # Explicit ASCII boundaries: \b in Java also counts accented letters as word
    # characters, which would change results for accented text.
    return value.rlike(rf"(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])")


def outfit_slot(norm_category, words, body_zone, layer_role, standalone) -> Column:
    """Slot from the normalised category, the descriptive words and the roles."""
    zone, role = text(body_zone), text(layer_role)
    result = (
        F.when(zone == "feet", "footwear")
        .when((zone == "accessory") | (role == "accessory"), "accessory")
        .when(role == "outer", "layer")
        .when(zone == "lower_body", "bottom")
        .when((zone == "full_body") | is_true(standalone) | (role == "standalone"), "hero")
        .otherwise("top")
    )
    for slot, implied, pattern in reversed(SLOT_PATTERNS):
        test = _whole_word(col(words), pattern)
        if implied:
            test = col(norm_category).isin(*implied) | test
        result = F.when(test, slot).otherwise(result)
    return result


def slot_words(category, sub_category, category_role, title, tags) -> Column:
    """Category, subcategory, role, title and tags as one lower-case text."""
    listed = F.array(*[col(c) for c in (category, sub_category, category_role, title)])
    everything = F.concat(listed, F.coalesce(col(tags), F.array().cast("array<string>")))
    return F.lower(F.array_join(F.filter(everything, lambda x: x != ""), " "))


#: What category and slot depend on.
INPUTS = {
    "category": "string", "sub_category": "string", "category_role": "string", "title": "string", "tags": "array<string>",
    "body_zone": "string", "layer_role": "string", "standalone_outfit": "boolean",
}
#: Different values a dictionary may hold; it is broadcast to all tasks (some 100 bytes each).
MOST_VALUES = 500_000


def _fields(garments: DataFrame) -> dict[str, Column]:
    """The inputs of a table; columns it lacks count as null."""
    return {n: (F.col(n) if n in garments.columns else F.lit(None)).cast(kind) for n, kind in INPUTS.items()}


def _tagged(garments: DataFrame) -> DataFrame:
    # One after the other, so that the category patterns run once per row and the slot only reads the result.
    f = _fields(garments)
    words = slot_words(*[f[n] for n in ("category", "sub_category", "category_role", "title", "tags")])
    named = garments.withColumn("norm_category", garment_category(f["category"], f["sub_category"])).withColumn("_words", words)
    slot = outfit_slot(F.col("norm_category"), F.col("_words"), f["body_zone"], f["layer_role"], f["standalone_outfit"])
    return named.withColumn("slot", slot).drop("_words")


def taxonomy_values(*tables: DataFrame) -> DataFrame | None:
    """A dictionary of category and slot for the different inputs of some tables, or None if there are too many.

    Every pattern runs once for each different value, however many rows have it. Values are counted here, so that
    a table that is joined with the dictionary can broadcast it; all joins of a query share one broadcast.
    """
    rows = tables[0].select(*[c.alias(n) for n, c in _fields(tables[0]).items()]).distinct()
    for table in tables[1:]:
        rows = rows.union(table.select(*[c.alias(n) for n, c in _fields(table).items()]).distinct())
    rows = rows.distinct()
    if rows.count() > MOST_VALUES:
        return None
    # One struct, so that all uses read the same columns.
    return _tagged(rows).select(*[F.col(n).alias(f"_v_{n}") for n in INPUTS], F.struct("norm_category", "slot").alias("_tag"))


def with_taxonomy(garments: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Add ``norm_category`` and ``slot``; columns the table lacks count as null.

    With the ``taxonomy_values`` of the table they are looked up there. A table that was stored with
    them is returned as it is.
    """
    if {"norm_category", "slot"} <= set(garments.columns):
        return garments
    if values is None:
        return _tagged(garments)
    alike = [c.eqNullSafe(F.col(f"_v_{n}")) for n, c in _fields(garments).items()]
    joined = garments.join(F.broadcast(values), reduce(lambda a, b: a & b, alike), "left")
    return joined.select(*garments.columns, "_tag.norm_category", "_tag.slot")


def base_kind(slot) -> Column:
    """Which entry of ``BASE_SLOTS`` completes a piece of this slot."""
    return F.when(col(slot).isin("hero", "top", "bottom"), col(slot)).otherwise("other")
