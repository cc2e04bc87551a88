"""Page and line filters. A null body counts as empty, a null URL as ""."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import lexicons as X
from webloom.functions.text import contains_any, hits, let, plain_marks, word_count, words


def parsable_type(content_type: Column) -> Column:
    return F.coalesce(F.lower(content_type).rlike("html|text/plain|xml"), F.lit(False))


def long_enough(body: Column, least_bytes: int = 30) -> Column:
    return F.octet_length(F.coalesce(body, F.lit(""))) >= least_bytes


def low_quality(body: Column, url: Column) -> Column:
    """Too short, a no-results page, a bare challenge, a search page, a news index or mostly navigation."""
    text = F.coalesce(body, F.lit(""))
    low, n = F.lower(text), word_count(text)
    u = F.lower(F.coalesce(url, F.lit("")))
    blocked = hits(low, X.BLOCK_PHRASES)
    return (
        (n < 15)
        | contains_any(F.substring(low, 1, 500), X.NO_RESULT_PHRASES)
        | ((blocked >= 1) & (n < 500) & ((blocked >= 2) | (n < 100)))
        | F.contains(u, F.lit("special:search"))
        | F.contains(u, F.lit("wikidata.org/w/index.php?search"))
        | (F.contains(u, F.lit("news.google.com")) & ~F.contains(u, F.lit("/articles/")) & ~F.contains(u, F.lit("/stories/")))
        | (hits(low, X.AGGREGATOR_PHRASES) >= 3)
        | ((hits(low, X.NAV_PHRASES) >= 3) & (n < 100))
    )


def result_listing(url: Column, body: Column) -> Column:
    """A search URL whose lines (of more than 10 bytes, more than 5 of them) are over 70 % shorter than 100 bytes."""
    lines = F.filter(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: F.octet_length(x) > 10)
    short = F.size(F.filter(lines, lambda x: F.octet_length(x) < 100))
    return contains_any(F.lower(F.coalesce(url, F.lit(""))), X.SERP_URL_PARTS) & (F.size(lines) > 5) & (short / F.greatest(F.size(lines), F.lit(1)) > 0.7)


def english(language: Column, body: Column) -> Column:
    """The stated language begins with en; without one, two of five common words within the first 500 characters."""
    head = words(F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 500)))
    common = F.array(*[F.lit(w) for w in ("the", "is", "and", "of", "to")])
    stated = F.nullif(language, F.lit(""))
    return F.when(stated.isNotNull(), F.lower(stated).startswith("en")).otherwise(F.size(F.array_intersect(head, common)) >= 2)


def relevant(query: Column, title: Column, body: Column) -> Column:
    """Enough distinctive query terms (over 2 bytes): with two or more, at least max(2, 30 %) of them in title or body."""
    terms = F.array_distinct(
        F.transform(F.filter(F.split(F.lower(query), r"\s+"), lambda w: F.octet_length(w) > 2), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    )
    terms = F.filter(terms, lambda t: t != "")
    doc = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))))

    def enough(x: Column) -> Column:
        n = F.size(x["t"])
        return (n < 2) | (F.size(F.filter(x["t"], lambda t: F.contains(x["d"], t))) >= F.greatest(F.lit(2), F.ceil(0.3 * n)))

    return let(F.struct(terms.alias("t"), doc.alias("d")), enough)


def code_line(line: Column) -> Column:
    t = F.trim(line)
    starts = t.rlike("^(?:" + "|".join(re.escape(p) for p in X.CODE_STARTS) + ")")
    marks = F.length(F.regexp_replace(t, r"[^{}();#=<>\[\]]", ""))
    dense = (F.octet_length(t) > 20) & (marks / F.greatest(F.octet_length(t), F.lit(1)) > 0.15)
    stack = t.startswith("at ") & F.contains(t, F.lit("(")) & F.contains(t, F.lit(":"))
    return starts | dense | stack


def call_to_action(line: Column) -> Column:
    return contains_any(F.lower(F.trim(line)), X.CTA_PHRASES)


def navigation_line(line: Column) -> Column:
    t = F.trim(line)
    return (F.octet_length(t) < 3) | (F.size(F.split(t, " > ")) >= 3)


def footnote_line(line: Column) -> Column:
    return F.trim(line).rlike(r"^\^\s*(?:$|[A-Za-z](?: |$)|[A-Z\"'])")


def retrieved_line(line: Column) -> Column:
    low = F.lower(F.trim(line))
    first = F.regexp_extract(low, r"^.*?retrieved (\s*\S*)", 1)
    dated = F.ltrim(first).rlike("^(?:" + "|".join(X.MONTH_NAMES) + "|20|19)")
    return (F.contains(low, F.lit("retrieved ")) & dated) | (F.contains(low, F.lit("archived")) & F.contains(low, F.lit("from the original")))


def without_reference_brackets(text: Column) -> Column:
    """[1], [2, 3], [] and editorial remarks go, other brackets stay."""
    marks = "|".join(re.escape(m) for m in X.EDITORIAL_MARKERS)
    return F.regexp_replace(text, r"(?i)\[\s*(?:[0-9,\- ]*|" + marks + r")\s*\]", "")


def clean_body(text: Column) -> Column:
    """Lines of code, calls to action, navigation, footnotes and archive remarks dropped, brackets and marks cleaned."""
    kept = F.filter(
        F.split(text, "\r?\n"), lambda x: ~(code_line(x) | call_to_action(x) | navigation_line(x) | footnote_line(x) | retrieved_line(x))
    )
    return plain_marks(F.array_join(F.transform(kept, without_reference_brackets), "\n"))


def clean_page(body: Column, marker: Column, least: int = 200) -> Column:
    """At least `least` characters and, if a marker is given, the marker in any case."""
    text = F.coalesce(body, F.lit(""))
    wanted = F.coalesce(F.lower(marker), F.lit(""))
    return (F.length(text) >= least) & ((wanted == "") | F.contains(F.lower(text), wanted))
