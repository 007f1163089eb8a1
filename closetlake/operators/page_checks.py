"""Checks over a table of pages, and the document search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closetlake.functions.text import strip

# Wording that public pages must not hold.
FORBIDDEN = ["Cloudflare", "Firestore", "Firebase", "API key", "server function", "custom claim", "account UID", "prompt hash"]
_LD = r'<script type="application/ld\+json">([\s\S]*?)</script>'
_QUESTION = r'<details class="faq-item"><summary>(.*?)</summary>'


def head_checks(pages: DataFrame, expected: str, image: str) -> DataFrame:
    """Per page: canonical link, robots rule, share images, heading, JSON-LD.

    ``expected`` is the column with the canonical address of the page.
    """
    html = F.col("html")
    blocks = F.regexp_extract_all(html, F.lit(_LD), F.lit(1))
    return pages.select(
        "page_id",
        F.contains(html, F.concat(F.lit('<link rel="canonical" href="'), F.col(expected), F.lit('"'))).alias("canonical_ok"),
        html.rlike(r'<meta name="robots" content="index,follow[^"\n]*"').alias("robots_ok"),
        F.contains(html, F.lit(f'property="og:image" content="{image}"')).alias("og_image_ok"),
        F.contains(html, F.lit(f'name="twitter:image" content="{image}"')).alias("twitter_image_ok"),
        (F.regexp_count(html, F.lit(r"<h1\b")) == 1).alias("one_heading"),
        F.forall(blocks, lambda b: F.try_parse_json(b).isNotNull()).alias("json_ld_ok"),
    )


def forbidden_wording(pages: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Pages that hold a forbidden wording, in any case."""
    quoted = ["\\Q" + w.replace("\\E", "\\E\\\\E\\Q") + "\\E" for w in words or FORBIDDEN]
    pattern = "(?i)" + "|".join(quoted)
    return pages.filter(F.col("html").rlike(pattern)).select("page_id")


def question_checks(pages: DataFrame) -> DataFrame:
    """Per page: do visible questions equal the ones in the structured data?

    Counts must agree, the structured names must be distinct and as many as the
    visible questions, and each must have an answer.
    """
    visible = F.size(F.regexp_extract_all("html", F.lit(_QUESTION), F.lit(1)))
    graph = F.from_json(
        F.regexp_extract("html", _LD, 1),
        "`@graph` array<struct<`@type`: string, mainEntity: array<struct<name: string, acceptedAnswer: struct<text: string>>>>>",
    )["@graph"]
    faq = F.get(F.filter(graph, lambda e: e["@type"] == "FAQPage"), 0)["mainEntity"]
    found = pages.select("page_id", visible.alias("visible"), faq.alias("faq"))
    listed = F.coalesce(F.size("faq"), F.lit(0))
    names = F.size(F.array_distinct(F.transform("faq", lambda q: q["name"])))
    answered = F.forall("faq", lambda q: F.coalesce(q["acceptedAnswer"]["text"] != "", F.lit(False)))
    return found.filter((F.col("visible") > 0) | F.col("faq").isNotNull()).select(
        "page_id", F.col("visible").cast("bigint").alias("visible_questions"), F.greatest(listed, F.lit(0)).cast("bigint").alias("listed_questions"),
        F.coalesce((listed == F.col("visible")) & (names == F.col("visible")) & answered, F.lit(False)).alias("questions_ok"),
    )


def missing_from_sitemap(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    return pages.join(sitemap, pages["url"] == sitemap["loc"], "left_anti").select("page_id", "url")


def document_search(documents: DataFrame, query: str) -> DataFrame:
    """Each document with whether it is shown for a query; '' shows all."""
    wanted = F.lower(strip(F.lit(query)))
    shown = (wanted == "") | F.contains(F.lower("text"), wanted)
    return documents.select("doc_id", F.col("source").alias("group"), F.coalesce(shown, F.lit(False)).alias("visible"))


def visible_groups(found: DataFrame) -> DataFrame:
    """Groups with whether any of their documents is shown."""
    return found.groupBy("group").agg(F.bool_or("visible").alias("visible"), F.count_if("visible").alias("shown"))


def search_is_empty(found: DataFrame) -> DataFrame:
    """One row: whether the search shows nothing at all."""
    return found.agg((~F.coalesce(F.bool_or("visible"), F.lit(False))).alias("empty"))
