"""Fallback chains and small numeric helpers.

Two kinds of fallback exist in the data model and they are not the same:
a chain that skips only missing values (``coalesce``) and a chain that also
skips empty text and zero. The second kind is spelled out here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_text(*cols) -> Column:
    """First value that is neither null nor empty text."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cols])


def first_number(*cols) -> Column:
    """First value that is neither null nor zero."""
    return F.coalesce(*[F.nullif(col(c), F.lit(0)) for c in cols])


def optional(df: DataFrame, name: str) -> Column:
    """A text field of the table, null where the table lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def is_true(c) -> Column:
    """True only for an explicit true; null counts as false."""
    return F.coalesce(col(c), F.lit(False))


def text(c) -> Column:
    """Text with null read as empty."""
    return F.coalesce(col(c), F.lit(""))


def rounded_percent(part, whole, empty: int | None = 0) -> Column:
    """``round(part / whole * 100)`` as a whole number, ``empty`` when whole is 0.

    The result may pass 100; that is intended.
    """
    p, w = col(part), col(whole)
    return F.when(w > 0, F.round(p / w * 100).cast("bigint")).otherwise(
        F.lit(empty).cast("bigint")
    )


def whitelisted(c, allowed: list[str], default: str) -> Column:
    """The value when it is one of ``allowed``, else ``default``."""
    return F.when(col(c).isin(*allowed), col(c)).otherwise(F.lit(default))


def as_date(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")


def as_instant(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def cost_per_wear(price, wears) -> Column:
    """Price per wear, null unless both are above zero."""
    return F.when((col(price) > 0) & (col(wears) > 0), col(price) / col(wears))


def points(earned, score_total) -> Column:
    """Quest points: earned points, else the score, else 0 (0 falls through)."""
    return F.coalesce(first_number(earned, score_total), F.lit(0))


def exact_sum(c) -> Column:
    """Sum of numbers; those with up to six decimals are added exactly, whatever the order of the rows.

    Others (too large, or with more decimals) are added as doubles, so none is cut or fails.
    """
    x = col(c).cast("double")
    plain = x.try_cast("decimal(24,6)")
    exact = F.coalesce(plain.cast("double") == x, F.lit(False))
    parts = F.coalesce(F.sum(F.when(exact, plain)).cast("double"), F.lit(0.0)) + F.coalesce(F.sum(F.when(~exact, x)), F.lit(0.0))
    return F.when(F.count(x) > 0, parts)


def number(c) -> Column:
    """Number written as plain decimal text, surrounding white space allowed, else null."""
    plain = col(c).rlike(r"\A\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z")
    return F.when(plain, col(c).try_cast("double"))
