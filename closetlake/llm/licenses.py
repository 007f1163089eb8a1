"""License scan: Aho-Corasick over words, shunting-yard over licence expressions.

Notice phrases and identifier tags are sequences of words; one automaton reads
each text once (as its words with single spaces) and gives all places. Where a
tag (``SPDX-License-Identifier``, ``License-Expression``) occurs, what follows it
in its line is parsed as an expression of identifiers with ``AND``, ``OR``, ``WITH``
and parentheses. Operators bind in the order WITH, AND, OR.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closetlake.llm.common import hidden, prepare, table

#: Base phrases and labels; fixed values.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Phrases that the method adds.
MORE = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "bsd license": "bsd",
    "mozilla public license": "mpl", "isc license": "isc", "creative commons attribution": "cc-by",
    "boost software license": "bsl", "eclipse public license": "epl", "released into the public domain": "public-domain",
    "cc0 1 0": "cc0", "all rights reserved": "proprietary",
}
TAGS = ("spdx license identifier", "license expression")
#: Beginnings of identifiers and their labels, the longest that fits decides; fixed values.
FAMILIES = {
    "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "apache": "apache", "mit": "mit", "bsd": "bsd", "mpl": "mpl", "isc": "isc",
    "cc-by": "cc-by", "cc0": "cc0", "epl": "epl", "bsl": "bsl", "unlicense": "public-domain", "0bsd": "bsd", "zlib": "zlib",
}
PERMISSIVE = {"apache", "mit", "bsd", "isc", "cc0", "bsl", "zlib", "public-domain"}
#: Share of doubt that one more piece of evidence leaves: a phrase, a tagged expression.
PHRASE_DOUBT, TAG_DOUBT = 0.2, 0.02

#: Upper to lower case; every other ASCII character that is no digit or letter to a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TAGGED = re.compile(r"(?i)(?:spdx[-\s]license[-\s]identifier|license[-\s]expression)\s*:\s*([^\r\n]*)")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*")
_BINDS = {"WITH": 3, "AND": 2, "OR": 1}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def postfix(expression: str) -> list[str] | None:
    """The expression's parts in postfix order (shunting-yard), or None if it is not well formed.

    Text after a complete expression (a comment's end, say) is left out.
    """
    out, operators, operand_next = [], [], True
    for token in _TOKEN.findall(expression):
        upper = token.upper()
        if upper in _BINDS:
            if operand_next:
                return None
            while operators and operators[-1] != "(" and _BINDS[operators[-1]] >= _BINDS[upper]:
                out.append(operators.pop())
            operators.append(upper)
            operand_next = True
        elif token == "(":
            if not operand_next:
                break
            operators.append(token)
        elif token == ")":
            if operand_next or "(" not in operators:
                return None
            while operators[-1] != "(":
                out.append(operators.pop())
            operators.pop()
        elif operand_next:
            out.append(token)
            operand_next = False
        else:
            break
    if operand_next or "(" in operators:
        return None
    return out + operators[::-1]


def family(identifier: str) -> str:
    low = identifier.lower()
    return max((f for f in FAMILIES if low == f or low.startswith((f + "-", f + "."))), key=len, default="")


def evaluate(parts: list[str]) -> tuple[set[str], bool]:
    """Labels of a postfix expression and whether its terms can be met by permissive licences only."""
    stack: list[tuple[set[str], bool]] = []
    for part in parts:
        if part == "WITH":
            stack.pop()  # an exception adds to what its licence permits and has no label
        elif part in ("AND", "OR"):
            b, a = stack.pop(), stack.pop()
            stack.append((a[0] | b[0], (a[1] and b[1]) if part == "AND" else (a[1] or b[1])))
        else:
            label = FAMILIES.get(family(part), "")
            stack.append(({label} - {""}, label in PERMISSIVE))
    return stack[0]


def _automaton():
    machine = ahocorasick.Automaton()
    phrases = BASE | MORE | dict.fromkeys(TAGS, "")
    for phrase, label in phrases.items():
        machine.add_word(f" {phrase} ", (phrase, label))
    machine.make_automaton()
    return machine


def scan(text: str | None, machine) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permissive."""
    words = words_of(text)
    line = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
    base, more, starts, pieces, tagged = set(), set(), [], 0, False
    for end, (phrase, label) in machine.iter(line):
        if phrase in BASE:
            base.add(label)
            starts.append(end - len(phrase) - 1)
            pieces += 1
        elif phrase in MORE:
            more.add(label)
            pieces += 1
        else:
            tagged = True
    expressions, permissive = [], None
    if tagged:
        for found in _TAGGED.findall(text):
            parts = postfix(found)
            if parts:
                labels, free = evaluate(parts)
                more |= labels
                expressions.append(" ".join(parts))
                permissive = free if permissive is None else permissive and free
    first = last = None
    if starts:
        # A place's word number is the number of spaces before it.
        first, last = (line.count(" ", 0, at) for at in (min(starts), max(starts)))
    score = 1 - PHRASE_DOUBT ** pieces * TAG_DOUBT ** len(expressions)
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), score, expressions, permissive


_FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permissive boolean"
_NAMES = [f.split()[0] for f in _FOUND.split(", ")]


def scanned(docs: DataFrame) -> DataFrame:
    """Add what ``scan`` finds in ``text``; a null text counts as empty.

    ``labels`` and ``base_labels`` are empty where nothing is found, ``first_word`` and
    ``last_word`` null; ``permissive`` is null without an expression. Columns of these names in ``docs`` are replaced.
    """

    def find(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = _automaton()
        for series in texts:
            rows = pd.DataFrame([scan(t, machine) for t in series], columns=_NAMES)
            yield rows.astype({"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64", "score": "float64", "permissive": "boolean"})

    docs = docs.drop(*_NAMES)
    [found] = hidden(docs, "found")
    return docs.withColumn(found, F.pandas_udf(find, _FOUND)("text")).select(*docs.columns, f"{found}.*")


def op7_license_scan(spark, sf_dir):
    """Licence phrases and labels of every document."""
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    return scanned(docs).select("doc_id", *_NAMES)
