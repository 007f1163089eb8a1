"""Looks and their pieces.

Pieces are held in long form: one row per (owner, look, position, item). The
position only orders the pieces of a look.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closetlake.functions.values import col, is_true, text
from closetlake.operators.common import top_k


def item_ids(own, outfit=None, recommendation=None) -> Column:
    """Id list of a document: own, else outfit, else recommendation.

    An empty list ends the chain; only a missing one falls through.
    """
    lists = [col(c) for c in (own, outfit, recommendation) if c is not None]
    return F.coalesce(*lists)


def explode_ids(docs: DataFrame, doc_id: str, ids: Column) -> DataFrame:
    """Long form of the id lists of documents."""
    return docs.select("user_id", doc_id, F.posexplode(ids).alias("pos", "item_id"))


def look_garments(look_items: DataFrame, items: DataFrame, fields: list[str]) -> DataFrame:
    """Pieces of each look with garment fields; ids nobody owns are dropped."""
    wanted = items.select("user_id", "item_id", *fields)
    return look_items.join(wanted, ["user_id", "item_id"])


def resolved_ids(records: DataFrame, record_items: DataFrame, look_items: DataFrame) -> DataFrame:
    """Piece ids of wear records: their own, or those of the look they point to."""
    own = record_items.select("user_id", "record_id", "pos", "item_id")
    pointing = records.join(
        record_items.select("user_id", "record_id"), ["user_id", "record_id"], "left_anti"
    ).select("user_id", "record_id", F.col("outfit_id").alias("look_id"))
    borrowed = pointing.join(look_items, ["user_id", "look_id"]).select(
        "user_id", "record_id", "pos", "item_id"
    )
    return own.unionByName(borrowed)


def record_previews(
    records: DataFrame, record_items: DataFrame, look_items: DataFrame, items: DataFrame, count: int = 4
) -> DataFrame:
    """The first ``count`` owned pieces of each record (user_id, record_id, outfit_id), as ``preview``.

    Pieces are the record's own, else those of its saved look. A record with
    none that is owned has no row.
    """
    keys = records.select("user_id", "record_id", "outfit_id")
    own = record_items.join(keys.select("user_id", "record_id"), ["user_id", "record_id"], "left_semi")
    owned = resolved_ids(keys, own, look_items).join(items.select("user_id", "item_id", "title"), ["user_id", "item_id"])
    first = top_k(owned, ["user_id", "record_id"], [F.col("pos"), F.col("item_id")], count, "thumb_no")
    # At most ``count`` entries a record reach this list.
    return first.groupBy("user_id", "record_id").agg(
        F.sort_array(F.collect_list(F.struct("thumb_no", "item_id", "title"))).alias("preview")
    )


def look_cards(looks: DataFrame, look_items: DataFrame, items: DataFrame) -> DataFrame:
    """Every look with its source label and how many of its pieces are owned."""
    owned = (
        look_items.join(items.select("user_id", "item_id"), ["user_id", "item_id"])
        .groupBy("user_id", "look_id").agg(F.count(F.lit(1)).alias("pieces"))
    )
    return (
        looks.join(owned, ["user_id", "look_id"], "left")
        .select("user_id", "look_id", source_label("lookbook", "source").alias("label"),
                F.coalesce("pieces", F.lit(0)).alias("pieces"))
    )


def thumbnails(look_items: DataFrame, items: DataFrame, count: int) -> DataFrame:
    """The first ``count`` owned pieces of each look."""
    owned = look_garments(look_items, items, ["title"])
    return top_k(owned, ["user_id", "look_id"], [F.col("pos"), F.col("item_id")], count, "thumb_no").select(
        "user_id", "look_id", "thumb_no", "item_id", "title"
    )


def source_label(lookbook, source) -> Column:
    return (
        F.when(is_true(lookbook), "Created look")
        .when(col(source) == "style_challenge", "Closet Quest")
        .otherwise("AI recommendation")
    )


def in_library(view: str) -> Column:
    """Filter of the outfit library: all, lookbook, ai or challenge."""
    made = is_true("lookbook")
    quest = text("source") == "style_challenge"
    return {
        "all": F.lit(True), "lookbook": made, "ai": ~made & ~quest, "challenge": quest,
    }[view]


def unknown_ids(look_items: DataFrame, items: DataFrame) -> DataFrame:
    """References to garments their owner does not have."""
    return look_items.join(items.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def owners_all_known(look_items: DataFrame, items: DataFrame) -> DataFrame:
    """Per owner, whether every referenced garment is owned."""
    missing = unknown_ids(look_items, items).groupBy("user_id").agg(F.count(F.lit(1)).alias("missing"))
    owners = look_items.select("user_id").distinct()
    return owners.join(missing, "user_id", "left").select(
        "user_id", F.col("missing").isNull().alias("all_known"),
        F.coalesce("missing", F.lit(0)).alias("missing_refs"),
    )


def grounded_ids(requested: DataFrame, items: DataFrame, doc_id: str) -> DataFrame:
    """Owned ids of each list, each once, at its first position."""
    distinct = requested.groupBy("user_id", doc_id, "item_id").agg(F.min("pos").alias("pos"))
    return distinct.join(items.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi").select(
        "user_id", doc_id, "pos", "item_id"
    )


def exclusive_picks(picks: DataFrame) -> DataFrame:
    """Final pieces of a look built pick by pick.

    The last pick of a slot wins. A one-piece clears top, bottom and layer, and
    each of those clears a one-piece. ``picks`` holds ``slot`` and ``pos``. Only
    six values per look are aggregated, whatever the number of picks.
    """
    from closetlake.functions.taxonomy import SLOTS

    last = picks.groupBy("user_id", "look_id").agg(
        *[F.max(F.when(F.col("slot") == s, F.struct("pos", "item_id"))).alias(s) for s in SLOTS]
    )
    hero_at = F.coalesce(F.col("hero.pos"), F.lit(-1))
    parts_at = F.greatest(*[F.coalesce(F.col(f"{s}.pos"), F.lit(-1)) for s in ("top", "bottom", "layer")])
    entries = []
    for s in SLOTS:
        keep = F.col(s).isNotNull()
        if s == "hero":
            keep = keep & (hero_at > parts_at)
        elif s in ("top", "bottom", "layer"):
            keep = keep & (F.col(f"{s}.pos") > hero_at)
        entries.append(F.when(keep, F.struct(F.lit(s).alias("slot"), F.col(f"{s}.item_id").alias("item_id"))))
    return (
        last.select("user_id", "look_id", F.explode(F.array_compact(F.array(*entries))).alias("e"))
        .select("user_id", "look_id", "e.slot", "e.item_id")
    )
