"""Text normalisation, cleaning and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from closetlake.functions.values import col, text

# The white space a browser strips.
_SPACE = (
    "\t\n\u000b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def strip(c) -> Column:
    """Remove leading and trailing white space of every kind, not only blanks."""
    return F.btrim(col(c), F.lit(_SPACE))


def search_key(c) -> Column:
    """Lower case, ``&`` spelled out, letters and digits only; null gives ''."""
    return _kept(_spelled_out(text(c)), "[a-z0-9]+")


def _kept(c: Column, pattern: str) -> Column:
    # The runs to keep are joined: replacing what lies between them takes several times as long.
    return F.array_join(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), "")


def _spelled_out(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("&"), F.lit(" and "))


def search_keys(values) -> Column:
    """Search keys of a list of texts, empty texts left out.

    The texts are joined by a control character they are first freed of, and
    normalised together: one pass over a row instead of one per value.
    """
    mark = "\u0001"
    kept = F.filter(col(values), lambda x: x != "")
    joined = F.array_join(F.transform(kept, lambda x: F.replace(x, F.lit(mark), F.lit(""))), mark)
    return F.split(_kept(_spelled_out(joined), f"[a-z0-9{mark}]+"), mark)


def clean(c, limit: int = 160) -> Column:
    """Text without angle brackets, stripped, cut at ``limit``; null gives ''."""
    return F.substring(strip(F.translate(text(c), "<>", "")), 1, limit)


def clean_list(c, count: int, limit: int) -> Column:
    """Cut the list to ``count`` entries, clean each, then drop the empty ones."""
    cut = F.slice(F.coalesce(col(c), F.array().cast("array<string>")), 1, count)
    return F.filter(F.transform(cut, lambda x: clean(x, limit)), lambda x: x != "")


def _capitalise_words(c: Column) -> Column:
    # A word starts where an ASCII word character follows anything else; only
    # ASCII letters are raised and the rest of the word is left as it is.
    words = F.split(c, r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")
    return F.array_join(
        F.transform(
            words,
            lambda w: F.concat(
                F.translate(F.substring(w, 1, 1), _LOWER, _LOWER.upper()),
                F.substr(w, F.lit(2)),
            ),
        ),
        "",
    )


def pretty_label(c) -> Column:
    """Underscores and hyphens to one blank, first letter of each word raised."""
    return _capitalise_words(F.regexp_replace(text(c), "[_-]+", " "))


def pretty(c) -> Column:
    """Each underscore to a blank, first letter of each word raised."""
    return _capitalise_words(F.replace(text(c), F.lit("_"), F.lit(" ")))


def list_text(c) -> Column:
    """A list as labels joined by a comma; null gives ''."""
    return F.coalesce(F.array_join(F.transform(col(c), pretty), ", "), F.lit(""))


def coverage_text(sleeveless, shorts, fitted) -> Column:
    """Three coverage switches as one sentence."""

    def part(flag, yes: str, no: str) -> Column:
        return F.when(F.coalesce(col(flag), F.lit(False)), yes).otherwise(no)

    return F.concat_ws(
        ", ",
        part(sleeveless, "Sleeveless allowed", "No sleeveless"),
        part(shorts, "Shorts allowed", "No shorts"),
        part(fitted, "Fitted allowed", "No fitted"),
    )


def coupon_code(c) -> Column:
    """Upper case with everything but letters, digits and hyphens removed."""
    return F.regexp_replace(F.upper(strip(text(c))), "[^A-Z0-9-]", "")


def _resolved(path: Column) -> Column:
    """A path from / without its ``.`` and ``..`` steps, which may be percent-encoded."""
    plain = lambda s: F.regexp_replace(s, "(?i)%2e", ".")
    steps = F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/")))

    def walked(done: Column, step: Column) -> Column:
        back = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(plain(step) == "..", back).when(plain(step) == ".", done).otherwise(F.concat(done, F.array(step)))

    kept = F.aggregate(steps, F.array().cast("array<string>"), walked)
    # A path that ends in such a step is a folder's.
    end = F.when(plain(F.element_at(steps, -1)).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("/"), F.array_join(F.concat(kept, end), "/"))


def web_url(c) -> Column:
    """The URL when it parses and is http or https, else ''.

    Scheme and host are put in lower case, user name and password stay as they are; the scheme's own port is left out and
    others lose leading zeros; an empty path becomes ``/`` and ``.`` and ``..`` steps are resolved.
    """
    value = strip(text(c))
    scheme = F.lower(F.try_parse_url(value, F.lit("PROTOCOL")))
    whole = r"^[A-Za-z]+://([^/?#]*)([^?#]*)(.*)$"
    authority, path, rest = (F.regexp_extract(value, whole, k) for k in (1, 2, 3))
    person = F.regexp_extract(authority, "^(.*@)?([^@]*)$", 1)
    place = F.lower(F.regexp_extract(authority, "^(.*@)?([^@]*)$", 2))
    host, port = F.regexp_extract(place, r"^(.*?)(?::(\d*))?$", 1), F.regexp_extract(place, r"^(.*?)(?::(\d*))?$", 2)
    number = port.try_cast("int")
    own = F.when(scheme == "http", 80).otherwise(443)
    shown = F.when(number.isNull() | (number == own), "").otherwise(F.concat(F.lit(":"), number.cast("string")))
    good = scheme.isin("http", "https") & (host != "") & ((port == "") | number.between(0, 65535))
    rooted = F.when(path == "", "/").otherwise(_resolved(path))
    return F.when(good, F.concat(scheme, F.lit("://"), person, host, shown, rooted, rest)).otherwise("")


def local_asset(c) -> Column:
    """A path directly under ./assets/, else ''."""
    ok = col(c).rlike(r"\A(?i:\./assets/[a-z0-9._-]+)\z")
    return F.when(ok, col(c)).otherwise("")


def strip_code_fences(c) -> Column:
    """Model output without Markdown fences."""
    return strip(F.regexp_replace(col(c), "```json|```", ""))


def admin_flag(attributes) -> Column:
    """True only when the JSON attribute text parses and holds ``admin: true``."""
    value = F.try_variant_get(F.try_parse_json(col(attributes)), "$.admin", "boolean")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(col(attributes)), "$.admin", "variant"))
    return F.coalesce((kind == "BOOLEAN") & value, F.lit(False))


def event_detail(feature, model, provider, status, error_message) -> Column:
    """Feature, model and provider of a call, plus why it failed."""
    reason = F.when(
        col(status) == "failure",
        F.coalesce(F.nullif(col(error_message), F.lit("")), F.lit("Failed request")),
    )
    parts = [F.nullif(col(c), F.lit("")) for c in (feature, model, provider)]
    return F.concat_ws(" · ", *parts, reason)
