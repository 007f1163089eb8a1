"""URL filter: host rules first, then a weighted vocabulary found by Aho-Corasick.

A rule names a host and the beginning of a path; it fits the host and all its
subdomains, and the longest rule that fits decides. Where none fits, the terms
of the vocabulary that stand alone in the url (no letter or digit beside them)
are weighed: a strict term alone blocks, soft terms block when ``SOFT_LIMIT``
different ones occur. One automaton per task reads each url once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closetlake.llm.common import hidden, prepare, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, beginning of the path); fixed values.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Weight of each term; terms of STRICT weight block alone.
STRICT = 3
VOCABULARY = {
    "casino": 3, "porn": 3, "xxx": 3, "viagra": 3, "adult": 3, "escort": 3, "warez": 3, "gambling": 3,
    "free": 1, "bet": 1, "bets": 1, "win": 1, "cheap": 1, "pills": 1, "ads": 1, "track": 1, "spam": 1, "farm": 1,
    "loan": 1, "loans": 1, "poker": 1, "slots": 1, "click": 1, "promo": 1, "deal": 1, "deals": 1, "replica": 1, "nude": 1,
}
SOFT_LIMIT = 2


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Both empty for a null url and one without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=tuple(RULES)) -> Column:
    """The longest fitting rule as struct (rule, verdict), or null."""
    ranked = sorted(rules, key=lambda r: len(r[1] + r[2]))
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in ranked:
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        chosen = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _automaton(vocabulary) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for term in vocabulary:
        machine.add_word(term, term)
    machine.make_automaton()
    return machine


def _is_word(c: str) -> bool:
    return c.isascii() and c.isalnum()


def terms_in(url: str | None, machine) -> list[str]:
    """Different terms that stand alone in a lower-case url."""
    found = set()
    for end, term in machine.iter(url or ""):
        start = end + 1 - len(term)
        if not (start and _is_word(url[start - 1])) and not (end + 1 < len(url) and _is_word(url[end + 1])):
            found.add(term)
    return sorted(found)


def judged(pages: DataFrame, rules=tuple(RULES), vocabulary=None, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict``, ``strict_terms``, ``soft_terms`` (comma-joined) and ``weight``.

    ``weight`` adds up the different terms found. Null and empty urls have no host, path or
    term, so they are allowed unless a rule says otherwise. Columns of these names are replaced.
    """
    weights = dict(vocabulary or VOCABULARY)
    pages = pages.drop("host", "path", "rule", "verdict", "strict_terms", "soft_terms", "weight")

    def find(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = _automaton(weights)
        for series in urls:
            yield pd.Series([terms_in(u, machine) for u in series], dtype=object)

    host, path = host_and_path()
    rule, terms, hard, soft = hidden(pages, "found_rule", "found_terms", "found_strict", "found_soft")
    rows = pages.withColumns({"host": host, "path": path})
    rows = rows.withColumn(rule, rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn(terms, F.pandas_udf(find, "array<string>")(F.translate("url", UPPER, LOWER)))
    strict = F.array(*[F.lit(t) for t, w in sorted(weights.items()) if w >= STRICT]).cast("array<string>")
    rows = rows.withColumn(hard, F.array_intersect(terms, strict)).withColumn(soft, F.array_except(terms, strict))
    blocked = (F.size(hard) > 0) | (F.size(soft) >= soft_limit)
    weight = reduce(lambda a, b: a + b, [F.when(F.array_contains(terms, t), w).otherwise(0) for t, w in sorted(weights.items())])
    return rows.withColumns({
        "rule": F.col(f"{rule}.rule"),
        "verdict": F.coalesce(f"{rule}.verdict", F.when(blocked, F.lit("block")).otherwise("allow")),
        "strict_terms": F.array_join(hard, ","), "soft_terms": F.array_join(soft, ","), "weight": weight,
    }).drop(rule, terms, hard, soft)


def op1_url_filter(spark, sf_dir):
    """Verdict on every page's url."""
    pages = table(prepare(spark), sf_dir, "pages").select("page_id", "url")
    return judged(pages).select("page_id", "host", "path", "rule", "verdict", "strict_terms", "soft_terms", "weight")


OP1_SQL = f"""
WITH vocabulary(term, weight) AS (VALUES {", ".join(f"('{t}', {w})" for t, w in VOCABULARY.items())}),
rules(verdict, name, start) AS (VALUES {", ".join(str(r) for r in RULES)}),
rest AS (
  SELECT page_id, row_number() OVER () AS id, translate(url, '{UPPER}', '{LOWER}') AS low,
    CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT id, page_id, low, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rest),
fitting AS (
  SELECT p.id, arg_max(r.name || r.start, length(r.name || r.start)) AS rule, arg_max(r.verdict, length(r.name || r.start)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.name OR ends_with(p.host, '.' || r.name)) AND starts_with(p.path, r.start) GROUP BY p.id),
terms AS (
  SELECT p.id, coalesce(string_agg(v.term, ',' ORDER BY v.term) FILTER (weight >= {STRICT}), '') AS strict_terms,
    coalesce(string_agg(v.term, ',' ORDER BY v.term) FILTER (weight < {STRICT}), '') AS soft_terms,
    count(*) FILTER (weight >= {STRICT}) AS n_strict, count(*) FILTER (weight < {STRICT}) AS n_soft, sum(weight)::INTEGER AS weight
  FROM parts p JOIN vocabulary v ON regexp_matches(p.low, '(^|[^a-z0-9])' || v.term || '([^a-z0-9]|$)') GROUP BY p.id)
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.verdict, CASE WHEN t.n_strict > 0 OR t.n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(t.strict_terms, '') AS strict_terms, coalesce(t.soft_terms, '') AS soft_terms, coalesce(t.weight, 0)::INTEGER AS weight
FROM parts p LEFT JOIN fitting f USING (id) LEFT JOIN terms t USING (id)
"""
