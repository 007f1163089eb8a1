"""Prompt fingerprints: 32-bit FNV-1a in base 36, and the prompt registry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from closetlake.functions.values import col

# Prompt id, version, release tag.
PROMPT_REGISTRY = [
    ("push_notification", 1, "admin-campaign-drafts-2026-08"),
    ("outfit_stylist", 4, "wardrobe-grounded-2026-08"),
    ("style_this", 4, "anchor-rules-2026-08"),
    ("smart_purchase", 2, "verified-combinations-2026-08"),
    ("style_check", 4, "structured-photo-review-2026-08"),
    ("selfie_analysis", 2, "profile-signals-2026-08"),
    ("garment_analysis", 4, "taxonomy-2026-08"),
    ("trip_packing", 2, "owned-items-only-2026-08"),
    ("festival_stylist", 1, "festival-launch-2026-08"),
    ("weekly_report", 2, "meaningful-insights-2026-08"),
    ("unknown", 1, "unclassified"),
]
_OFFSET, _PRIME, _WORD = 2166136261, 16777619, 4294967296


def _code_points(c: Column) -> Column:
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    return F.transform(chars, lambda x: F.ascii(x).cast("bigint"))


def _high(cp: Column) -> Column:
    return F.lit(0xD800) + F.shiftright(cp - 0x10000, 10)


def _low(cp: Column) -> Column:
    return F.lit(0xDC00) + (cp - 0x10000).bitwiseAND(F.lit(0x3FF))


def _fnv(units: Column) -> Column:
    total = F.aggregate(
        units,
        F.lit(_OFFSET).cast("bigint"),
        lambda h, u: F.pmod(h.bitwiseXOR(u) * F.lit(_PRIME), F.lit(_WORD)),
    )
    return F.lower(F.conv(total.cast("string"), 10, 36))


def prompt_hash(c) -> Column:
    """Hash over UTF-16 units: a character beyond 0xFFFF counts as its pair."""
    units = F.flatten(
        F.transform(
            _code_points(col(c)),
            lambda cp: F.when(cp > 0xFFFF, F.array(_high(cp), _low(cp))).otherwise(F.array(cp)),
        )
    )
    return _fnv(units)


def character_hash(c) -> Column:
    """Hash over characters: one beyond 0xFFFF counts as its first unit only."""
    return _fnv(
        F.transform(_code_points(col(c)), lambda cp: F.when(cp > 0xFFFF, _high(cp)).otherwise(cp))
    )


def _by_prompt(values: list, prompt_id: Column) -> Column:
    pairs = []
    for row, value in zip(PROMPT_REGISTRY, values, strict=True):
        pairs += [F.lit(row[0]), F.lit(value)]
    return F.try_element_at(F.create_map(*pairs), prompt_id)


def _registry(field: int, prompt_id: Column) -> Column:
    return _by_prompt([row[field] for row in PROMPT_REGISTRY], prompt_id)


def _fixed_stamp(text: str) -> str:
    """``prompt_hash`` of a registry entry (ASCII), known when the plan is made."""
    h, digits = _OFFSET, ""
    for c in text:
        h = (h ^ ord(c)) * _PRIME % _WORD
    while h or not digits:
        h, digit = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[digit] + digits
    return digits


def known_prompt(prompt_id) -> Column:
    """The prompt id, or ``unknown`` when the registry lacks it."""
    c = col(prompt_id)
    return F.when(c.isin(*[r[0] for r in PROMPT_REGISTRY]), c).otherwise("unknown")


def prompt_version(prompt_id) -> Column:
    return _registry(1, known_prompt(prompt_id))


def release_tag(prompt_id) -> Column:
    return _registry(2, known_prompt(prompt_id))


def prompt_stamp(prompt_id) -> Column:
    """Hash of ``id:version:release tag``; there is one per registry entry."""
    return _by_prompt([_fixed_stamp(f"{i}:{v}:{tag}") for i, v, tag in PROMPT_REGISTRY], known_prompt(prompt_id))


def request_hash(request) -> Column:
    """Hash of the request prompt; '' when there is none."""
    c = col(request)
    return F.when(c != "", prompt_hash(c)).otherwise("")


def cache_key(prompt_id, raw_key) -> Column:
    return F.concat_ws(":", prompt_stamp(prompt_id), col(raw_key))
