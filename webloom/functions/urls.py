"""URL and host expressions. A URL that can't be parsed has the host "unknown" and itself as normal form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.lexicons import DOUBLE_SUFFIXES


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")), F.lit("unknown")))


def organisation(domain: Column) -> Column:
    """The last two labels, three under the known double suffixes."""
    parts = F.split(domain, r"\.")
    n = F.size(parts)
    two = F.array_join(F.slice(parts, -2, 2), ".")
    three = F.array_join(F.slice(parts, -3, 3), ".")
    return F.when(n <= 2, domain).when(two.isin(*DOUBLE_SUFFIXES), three).otherwise(two)


def frontier_form(url: Column) -> Column:
    """No fragment; no final slash beyond the third slash."""
    bare = F.regexp_replace(url, "#.*$", "")
    slashes = F.length(bare) - F.length(F.replace(bare, F.lit("/"), F.lit("")))
    return F.when(bare.endswith("/") & (slashes > 3), F.regexp_replace(bare, "/$", "")).otherwise(bare)


def label_form(url: Column) -> Column:
    """Lower case, no fragment, scheme, one www. and final slashes; "/" stays."""
    low = F.regexp_replace(F.lower(F.trim(url)), "#.*$", "")
    bare = F.regexp_replace(F.regexp_replace(low, "^https?://", ""), r"^www\.", "")
    return F.when(F.length(bare) <= 1, bare).otherwise(F.regexp_replace(bare, "/+$", ""))


def feed_form(url: Column) -> Column:
    """As label_form with a single final slash cut and lower case applied last."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^https?://", ""), r"^www\.", "")
    return F.lower(F.regexp_replace(bare, "/$", ""))


def simple_query_encoding(text: Column) -> Column:
    """Blank to +, and & = ? # to their escapes; nothing else."""
    out = F.replace(text, F.lit(" "), F.lit("+"))
    for mark, code in (("&", "%26"), ("=", "%3D"), ("?", "%3F"), ("#", "%23")):
        out = F.replace(out, F.lit(mark), F.lit(code))
    return out


def host_suffixes(domain: Column) -> Column:
    """The host and every parent of it with two labels or more: a.b.c -> [a.b.c, b.c]."""
    parts = F.split(domain, r"\.")
    n = F.size(parts)
    return F.when(n < 2, F.array(domain)).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, i, n), ".")))
