"""Sanitised inputs and grounded model results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closetlake.functions.text import clean, clean_list, strip_code_fences
from closetlake.functions.values import first_text, is_true, number, whitelisted
from closetlake.operators.common import exploded, top_k
from closetlake.operators.garments import purchase_usable
from closetlake.schemas import conform

# Fixed values of the service.
VERDICTS = ["strong_buy", "consider", "duplicate"]
MATCH_THRESHOLD = 65
MATCH_LIMIT = 6
EXAMPLE_LIMIT = 12
REASON_LIMIT = 5
RESULT_SCHEMA = """verdict string, summary string,
    similarityMatches array<struct<wardrobeItemId string, score string, reason string>>,
    outfitExamples array<struct<itemIds array<string>, explanation string>>, reasons array<string>"""

OUTFIT_SCHEMA = "wardrobeItemIds array<string>"

# Lengths that text and list fields are cut to.
_TEXT = {
    "title": 100, "category": 50, "sub_category": 50, "category_role": 40, "layer_role": 30,
    "user_restrictions": 160, "set_type": 40, "primary_color": 40, "pattern": 40, "fit": 40,
    "material": 50, "formality": 30, "laundry_status": 20,
}
_LISTS = {
    "user_occasions": (10, 40), "activity_suitability": (10, 40), "included_components": (10, 50),
    "required_components": (10, 50), "secondary_colors": (5, 30), "occasion": (10, 40), "tags": (12, 40),
}
_FLAGS = ["requires_base_layer", "standalone_outfit", "favorite", "hidden_from_ai"]


def sanitized_garments(items: DataFrame) -> DataFrame:
    """Garments as a stylist model may see them: cleaned, none hidden."""
    g = conform(items, "wardrobe")
    return g.select(
        "user_id", clean(F.col("item_id").cast("string")).alias("item_id"),
        *[clean(n, m).alias(n) for n, m in _TEXT.items()],
        *[clean_list(n, c, m).alias(n) for n, (c, m) in _LISTS.items()],
        "season", *[is_true(n).alias(n) for n in _FLAGS],
    ).filter((F.col("item_id") != "") & ~F.col("hidden_from_ai"))


def purchase_garments(items: DataFrame) -> DataFrame:
    """The shorter form for purchase checks; hidden and laundry garments drop out.

    Here empty tags stay, unlike in the stylist's form.
    """
    g = conform(items, "wardrobe")
    tags = F.transform(F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 10), lambda x: clean(x, 30))
    short = ["title", "category", "sub_category", "primary_color", "pattern"]
    return g.filter(purchase_usable()).select(
        "user_id", clean(F.col("item_id").cast("string")).alias("item_id"),
        *[clean(n, _TEXT[n]).alias(n) for n in short],
        clean(first_text("material", "fabric"), 50).alias("material"), tags.alias("tags"),
        clean("laundry_status", 20).alias("laundry_status"),
    ).filter((F.col("item_id") != "") & (F.col("laundry_status") != "Laundry"))


def sanitized_candidates(candidates: DataFrame) -> DataFrame:
    c = conform(candidates, "candidates")
    names = ["title", "category", "sub_category", "primary_color", "pattern", "material"]
    return c.select(
        "user_id", "candidate_id", *[clean(n, _TEXT[n]).alias(n) for n in names], clean("brand", 50).alias("brand")
    )


def sanitized_profiles(users: DataFrame) -> DataFrame:
    """Profile fields as a stylist model may see them."""
    u = conform(users, "users")
    p = "preferences."
    return u.select(
        "user_id", clean("gender", 30).alias("gender"), clean("profession", 60).alias("profession"),
        clean(first_text("body_type_self_reported", "ai_analysis.body_type"), 40).alias("body_type"),
        clean_list(p + "style_lean", 10, 40).alias("style_lean"),
        clean_list(p + "favorite_colors", 10, 30).alias("favorite_colors"),
        clean_list(p + "avoid_colors", 10, 30).alias("avoid_colors"),
        clean_list(p + "hard_exclusions", 12, 60).alias("hard_exclusions"),
        clean(p + "fit_preference", 30).alias("fit_preference"),
        clean(p + "styling_priority", 40).alias("styling_priority"),
        clean(p + "footwear_comfort", 30).alias("footwear_comfort"), F.col(p + "coverage_rules").alias("coverage_rules"),
    )


def _parsed(results: DataFrame, schema: str, keep: list) -> DataFrame:
    """Model output parsed after its fences are removed; ``parsed`` tells whether it is JSON.

    The parse stands in a list of one entry that is exploded, so a plan does not
    repeat it for each field. Only text that does not fit the schema is looked
    at again: JSON with fields of other types counts, and what fits is kept.
    """
    body = strip_code_fences("raw")
    read = F.from_json(body, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = results.select(*keep, "raw", F.inline_outer(F.array(F.struct(read.alias("r")))))
    whole = F.col("r._bad").isNull() | F.try_parse_json(body).isNotNull()
    valid = F.col("r").isNotNull() & (F.trim(body) != "null") & whole
    names = [c for c in rows.columns if c not in ("raw", "r")]
    return rows.select(*names, F.coalesce(valid, F.lit(False)).alias("parsed"), "r")


def parsed_results(results: DataFrame) -> DataFrame:
    """Purchase checks of the model (user_id, result_id, raw), parsed."""
    return _parsed(results, RESULT_SCHEMA, ["user_id", "result_id"])


def parsed_outfits(results: DataFrame) -> DataFrame:
    """Outfits of the model (user_id, result_id, anchor_item_id, raw), parsed."""
    return _parsed(results, OUTFIT_SCHEMA, ["user_id", "result_id", clean("anchor_item_id").alias("anchor_item_id")])


def outfit_pieces(parsed: DataFrame, items: DataFrame) -> DataFrame:
    """Known pieces of each outfit, each once at its first place; ``items`` are the garments the model was shown."""
    keys = ["user_id", "result_id", "anchor_item_id"]
    named = exploded(parsed, keys, "r.wardrobeItemIds", "pos", "item_id")
    once = named.groupBy(*keys, "item_id").agg(F.min("pos").alias("pos"))
    return _owned(once, items).select(
        "user_id", "result_id", "pos", "item_id", (F.col("item_id") == F.col("anchor_item_id")).alias("is_anchor"))


def outfit_verdicts(parsed: DataFrame, pieces: DataFrame) -> DataFrame:
    """How many pieces each outfit keeps, and why it is rejected (null: it is not)."""
    counted = pieces.groupBy("user_id", "result_id").agg(
        F.count(F.lit(1)).alias("pieces"), F.bool_or("is_anchor").alias("has_anchor"))
    n = F.coalesce("pieces", F.lit(0))
    reason = (
        F.when(~F.col("parsed"), "not JSON").when(n == 0, "no usable garments")
        .when((F.col("anchor_item_id") != "") & ~F.col("has_anchor"), "selected garment not kept")
    )
    return parsed.join(counted, ["user_id", "result_id"], "left").select(
        "user_id", "result_id", n.alias("pieces"), reason.alias("reject_reason"))


def _score(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(number(c), F.lit(0.0))))


def _owned(df: DataFrame, items: DataFrame) -> DataFrame:
    known = items.select("user_id", F.col("item_id").cast("string").alias("item_id"))
    return df.join(known, ["user_id", "item_id"], "left_semi")


def grounded_matches(parsed: DataFrame, items: DataFrame) -> DataFrame:
    """Up to six matches per result: known ids with a clamped score of 65 or more.

    ``items`` are the garments the model was shown.
    """
    rows = exploded(parsed, ["user_id", "result_id"], "r.similarityMatches", "pos", "m").select(
        "user_id", "result_id", "pos", clean("m.wardrobeItemId").alias("item_id"), _score(F.col("m.score")).alias("score"),
        clean("m.reason", 180).alias("reason"),
    ).filter(F.col("score") >= MATCH_THRESHOLD)
    return top_k(_owned(rows, items), ["user_id", "result_id"], [F.col("pos")], MATCH_LIMIT).drop("pos")


def grounded_examples(parsed: DataFrame, items: DataFrame) -> DataFrame:
    """Up to twelve examples per result with at least two known pieces, each once.

    ``items`` are the garments the model was shown.
    """
    examples = exploded(parsed, ["user_id", "result_id"], "r.outfitExamples", "example", "x")
    keys = ["user_id", "result_id", "example"]
    pieces = exploded(examples, [*keys, clean("x.explanation", 180).alias("explanation")], "x.itemIds", "pos", "item_id")
    once = pieces.groupBy(*keys, "explanation", "item_id").agg(F.min("pos").alias("pos"))
    owned = _owned(once, items)
    # Back to one row per example: no more entries than its list had in its document.
    whole = owned.groupBy(*keys, "explanation").agg(
        F.sort_array(F.collect_list(F.struct("pos", "item_id"))).alias("pieces")
    ).filter(F.size("pieces") >= 2)
    kept = top_k(whole, ["user_id", "result_id"], [F.col("example")], EXAMPLE_LIMIT, "example_no")
    return kept.select("user_id", "result_id", "example_no", "explanation", F.inline("pieces"))


def sanitized_results(parsed: DataFrame, examples: DataFrame) -> DataFrame:
    """Verdict, summary, reasons and counts of each parsed result."""
    counted = examples.groupBy("user_id", "result_id").agg(
        F.count_distinct("example_no").alias("n"), F.count_distinct("item_id").alias("pieces")
    )
    reasons = F.slice(
        F.filter(F.transform("r.reasons", lambda x: clean(x, 180)), lambda x: x != ""), 1, REASON_LIMIT
    )
    return parsed.filter("parsed").join(counted, ["user_id", "result_id"], "left").select(
        "user_id", "result_id", F.coalesce(whitelisted("r.verdict", VERDICTS, "consider")).alias("verdict"),
        clean("r.summary", 260).alias("summary"), F.coalesce(reasons, F.array().cast("array<string>")).alias("reasons"),
        F.coalesce("n", F.lit(0)).alias("possible_outfits"), F.coalesce("pieces", F.lit(0)).alias("compatible_pieces"),
    )


def checked_results(parsed: DataFrame, items: DataFrame) -> DataFrame:
    """As ``sanitized_results`` of the grounded examples, in one pass over the parsed results.

    The different ids that a result names, no more than its own document holds, are looked up in one
    join and come back as one list, against which its examples are read. ``items`` are the garments the model was shown.
    """
    keys = ["user_id", "result_id"]
    examples = F.coalesce(F.transform("r.outfitExamples", lambda x: x["itemIds"]), F.array().cast("array<array<string>>"))
    reasons = F.slice(F.filter(F.transform("r.reasons", lambda x: clean(x, 180)), lambda x: x != ""), 1, REASON_LIMIT)
    whole = F.struct(
        F.coalesce(whitelisted("r.verdict", VERDICTS, "consider")).alias("verdict"), clean("r.summary", 260).alias("summary"),
        F.coalesce(reasons, F.array().cast("array<string>")).alias("reasons"), examples.alias("examples"))
    named = F.array_distinct(F.flatten(F.filter(examples, lambda x: x.isNotNull())))
    rows = parsed.filter("parsed").select(*keys, whole.alias("whole"), F.posexplode_outer(named).alias("pos", "item_id"))
    # The result itself goes with its first id only.
    rows = rows.withColumn("whole", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("whole")))
    known = items.select("user_id", F.col("item_id").cast("string").alias("item_id"), F.lit(True).alias("known"))
    found = rows.join(known, ["user_id", "item_id"], "left").groupBy(*keys).agg(
        F.first("whole", ignorenulls=True).alias("whole"), F.collect_set(F.when(F.col("known"), F.col("item_id"))).alias("ids"))
    pieces = F.transform("whole.examples", lambda x: F.array_distinct(F.filter(x, lambda i: F.array_contains("ids", i))))
    kept = F.slice(F.filter(pieces, lambda x: F.size(x) >= 2), 1, EXAMPLE_LIMIT)
    return found.withColumn("kept", kept).select(
        *keys, "whole.verdict", "whole.summary", "whole.reasons", F.size("kept").cast("bigint").alias("possible_outfits"),
        F.size(F.array_distinct(F.flatten("kept"))).cast("bigint").alias("compatible_pieces"))


def outfit_check(look_items: DataFrame, items: DataFrame) -> DataFrame:
    """Whether each look is wearable: ``items`` holds ``slot`` and ``requires_base_layer``.

    It needs a bottom unless it has a one-piece, a base under a layer that asks
    for one, no piece twice, and owned pieces only.
    """
    owned = items.select("user_id", "item_id", "slot", "requires_base_layer")
    # One row per piece first, so that the look's own row combines small counts.
    pieces = look_items.groupBy("user_id", "look_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    facts = pieces.join(owned, ["user_id", "item_id"], "left").groupBy("user_id", "look_id").agg(
        F.bool_or(F.coalesce(F.col("slot") == "bottom", F.lit(False))).alias("bottom"),
        F.bool_or(F.coalesce(F.col("slot") == "hero", F.lit(False))).alias("hero"),
        F.bool_or(F.coalesce(F.col("slot") == "top", F.lit(False))).alias("top"),
        F.bool_or((F.coalesce("slot", F.lit("")) == "layer") & is_true("requires_base_layer")).alias("needs_base"),
        F.bool_or(F.col("n") > 1).alias("has_duplicate"), F.bool_or(F.col("slot").isNull()).alias("has_unknown"),
    )
    missing_bottom = ~F.col("hero") & ~F.col("bottom")
    missing_base = F.col("needs_base") & ~F.col("hero") & ~F.col("top")
    return facts.select(
        "user_id", "look_id", missing_bottom.alias("missing_bottom"), missing_base.alias("missing_base"),
        "has_duplicate", "has_unknown",
        (~missing_bottom & ~missing_base & ~F.col("has_duplicate") & ~F.col("has_unknown")).alias("complete"),
    )
