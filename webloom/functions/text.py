"""Tokenizers, sentence splitters and other text expressions; all stay inside the JVM.

Lengths named `bytes` are octets, others code points. A null text gives null or an empty array as stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.lexicons import EMBED_STOPWORDS, SUMMARY_STOPWORDS

# white space of every script, no-break spaces included
WHITE = r"[\s\x0b\x85\p{Z}]"
BREAK = r"[^\p{L}\p{N}]+"
BREAK_KEEP_APOSTROPHE = r"[^\p{L}\p{N}']+"


def let(value: Column, body) -> Column:
    """body(value) with value computed once; inside a lambda an outer expression would be computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def _in(x: Column, words: list[str]) -> Column:
    return x.isin(*words)


def index_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits under 40 bytes, in order."""
    return F.filter(F.split(F.lower(text), BREAK), lambda x: (x != "") & (F.octet_length(x) < 40))


def summary_tokens(text: Column) -> Column:
    """Words of two bytes or more without stop words, apostrophes kept."""
    return F.filter(F.split(F.lower(text), BREAK_KEEP_APOSTROPHE), lambda x: (F.octet_length(x) >= 2) & ~_in(x, SUMMARY_STOPWORDS))


def embed_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BREAK_KEEP_APOSTROPHE), lambda x: (F.octet_length(x) > 1) & ~_in(x, EMBED_STOPWORDS))


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(text, WHITE + "+"), lambda x: x != ""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE + "+"), lambda x: x != "")


def key_phrases(text: Column, most: int = 20) -> Column:
    """Sentences of 5 to 50 words, the first `most`."""
    parts = F.transform(F.split(text, "[.!?]"), lambda x: strip(x))
    return F.slice(F.filter(parts, lambda x: word_count(x).between(5, 50)), 1, most)


def snippet(text: Column, query: Column, longest: int = 1500) -> Column:
    """The sentence with most query words, the one before and the two after; the text's start where nothing can be scored."""
    terms = F.filter(F.split(F.lower(query), r"\s+"), lambda w: F.octet_length(w) > 2)
    parts = F.filter(F.transform(F.split(text, "[.!?\n]"), lambda x: strip(x)), lambda x: F.octet_length(x) > 20)

    def around(x: Column) -> Column:
        ps, best = x["p"], F.greatest(F.array_position(x["s"], F.array_max(x["s"])).cast("int"), F.lit(1))
        start = F.greatest(best - 1, F.lit(1))
        return F.array_join(F.slice(ps, start, best + 3 - start), ". ")

    scored = let(F.struct(parts.alias("p"), terms.alias("t")), lambda x: F.struct(x["p"].alias("p"), F.transform(x["p"], lambda s: F.size(F.filter(x["t"], lambda t: F.contains(F.lower(s), t)))).alias("s")))
    joined = let(scored, around)
    cut = let(joined, lambda j: F.when(F.octet_length(j) > longest, F.concat(F.substring(j, 1, longest), F.lit("..."))).otherwise(j))
    return F.when((F.size(terms) <= 0) | (F.size(parts) <= 0), F.substring(text, 1, longest)).otherwise(cut)


def chunk_sentences(text: Column) -> Column:
    """Sentences ending in . ! or ? before white space."""
    return F.filter(F.split(text, r"(?<=[.!?])(?=[ \n\r])"), lambda x: strip(x) != "")


def clean_for_inference(text: Column) -> Column:
    """Without bracketed parts; one level of double blanks and blanks before commas and points closed."""
    bare = F.replace(F.regexp_replace(text, r"\[[^\]]*\]", ""), F.lit("  "), F.lit(" "))
    return F.trim(F.replace(F.replace(bare, F.lit(" ,"), F.lit(",")), F.lit(" ."), F.lit(".")))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token arrays as sets; 1 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union <= 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def plain_marks(text: Column) -> Column:
    """Plain quotes and dashes; no-break, zero-width and control characters become blanks."""
    straight = F.translate(text, "‘’“”–— ​﻿", "''\"\"--   ")
    return F.regexp_replace(straight, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", " ")


def hits(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases the text contains."""
    total = F.lit(0)
    for p in phrases:
        total = total + F.contains(text, F.lit(p)).cast("int")
    return total


def contains_any(text: Column, phrases: list[str]) -> Column:
    import re

    return text.rlike("|".join(re.escape(p) for p in phrases))


def truncated(text: Column, most: int) -> Column:
    """The first code points of a text, as models read no more."""
    return F.substring(text, 1, most)


def iso_time(at: Column) -> Column:
    """2025-06-01T00:00:00Z of a timestamp, in UTC."""
    return F.concat(F.date_format(F.to_utc_timestamp(at.cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
