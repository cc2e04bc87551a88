"""Labels and multipliers of queries, domains and dates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import lexicons as X
from webloom.functions.text import contains_any, hits
from webloom.functions.urls import host_suffixes, organisation


def query_type(query: Column) -> Column:
    """The type with most signals in the query; ties in the order News, Research, Technical, Factual; none: General."""
    q = F.lower(query)
    n, r, t, f = (hits(q, s) for s in (X.NEWS_SIGNALS, X.RESEARCH_SIGNALS, X.TECHNICAL_SIGNALS, X.FACTUAL_SIGNALS))
    top = F.greatest(n, r, t, f)
    return F.when(top == 0, "General").when(n == top, "News").when(r == top, "Research").when(t == top, "Technical").otherwise("Factual")


def topics(query: Column) -> dict[str, Column]:
    q = F.lower(query)
    pairs = {"technical": X.TECHNICAL_TOPICS, "scientific": X.SCIENTIFIC_TOPICS, "medical": X.MEDICAL_TOPICS, "news": X.NEWS_TOPICS}
    return {k: contains_any(q, v) for k, v in pairs.items()}


def reformulations(query: Column, year: int, most: int = 6) -> Column:
    """The query and up to five variants: synonyms, "what is", the bare statement, and one word more for a topic."""
    q = F.lower(query)
    n = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
    none = F.array().cast("array<string>")
    out = F.array(query)
    for term, others in X.SYNONYMS:
        for other in others:
            variant = F.replace(q, F.lit(term), F.lit(other))
            out = F.concat(out, F.when(F.contains(q, F.lit(term)) & (variant != q) & ~F.array_contains(out, variant), F.array(variant)).otherwise(none))
    raise_what = (n <= 3) & ~q.startswith("what") & ~q.startswith("how")
    out = F.concat(out, F.when(raise_what, F.array(F.concat(F.lit("what is "), q))).otherwise(none))
    stated = F.replace(F.replace(F.replace(q, F.lit("why "), F.lit("")), F.lit("how "), F.lit("")), F.lit("what is "), F.lit(""))
    asks = ~F.contains(q, F.lit("?")) & (n >= 2) & q.rlike("^(?:why|how|what)")
    out = F.concat(out, F.when(asks & ~F.array_contains(out, stated), F.array(stated)).otherwise(none))
    t = topics(query)
    for name, words in (("technical", ["documentation", "tutorial"]), ("scientific", ["research paper"]), ("medical", ["clinical study"]), ("news", [str(year)])):
        out = F.concat(out, F.when(t[name], F.array(*[F.concat(q, F.lit(f" {w}")) for w in words])).otherwise(none))
    return F.slice(out, 1, most)


def reformulated(queries: DataFrame, id_col: str, text_col: str, year: int, most: int = 6) -> DataFrame:
    """(id, position, variant), the query itself first.

    Synonyms come as a small table exploded beside each query, so the plan doesn't grow with their number.
    """
    pairs = [(t, s) for t, others in X.SYNONYMS for s in others]
    table = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(s).alias("s")) for t, s in pairs])
    q = F.lower(F.col(text_col))
    n = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
    swaps = F.filter(F.transform(F.filter(table, lambda p: F.contains(q, p["t"])), lambda p: F.replace(q, p["t"], p["s"])), lambda v: v != q)
    fixed = F.array_distinct(F.concat(F.array(F.col(text_col)), swaps))
    none = F.array().cast("array<string>")
    what = F.when((n <= 3) & ~q.startswith("what") & ~q.startswith("how"), F.array(F.concat(F.lit("what is "), q))).otherwise(none)
    stated = F.replace(F.replace(F.replace(q, F.lit("why "), F.lit("")), F.lit("how "), F.lit("")), F.lit("what is "), F.lit(""))
    asks = ~F.contains(q, F.lit("?")) & (n >= 2) & q.rlike("^(?:why|how|what)")
    t = topics(F.col(text_col))
    more = [
        F.when(t[name], F.array(*[F.concat(q, F.lit(f" {w}")) for w in ws])).otherwise(none)
        for name, ws in (("technical", ["documentation", "tutorial"]), ("scientific", ["research paper"]), ("medical", ["clinical study"]), ("news", [str(year)]))
    ]
    base = F.concat(fixed, what)
    base = F.concat(base, F.when(asks & ~F.array_contains(base, stated), F.array(stated)).otherwise(none), *more)
    return queries.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.posexplode(F.slice(base, 1, most)).alias("position", "variant"))


def tier_table(spark: SparkSession) -> DataFrame:
    """(suffix, tier): the default table of domain authority, to be replaced by the caller's own."""
    return spark.createDataFrame([(d, t) for t, ds in X.TIER_DOMAINS.items() for d in ds], "suffix string, tier int")


def with_tier(df: DataFrame, domain_col: str, tiers: DataFrame, out: str = "source_tier") -> DataFrame:
    """Add the tier of a domain: 1 for official suffixes, else the best tier of the host or a parent of it, else 4.

    Only distinct domains meet the tier table; the table joins on equality of suffixes, so it may be of any size.
    """
    d = df.select(F.lower(F.col(domain_col)).alias("__d")).where("__d is not null").distinct()
    listed = d.select("__d", F.explode(host_suffixes(F.col("__d"))).alias("suffix")).join(tiers, "suffix").groupBy("__d").agg(F.min("tier").alias("__t"))
    joined = df.withColumn("__k", F.lower(F.col(domain_col))).join(listed, F.col("__k") == F.col("__d"), "left")
    official = F.col("__k").rlike("(?:" + "|".join(s.replace(".", r"\.") for s in X.TIER1_SUFFIXES) + ")$")
    return joined.withColumn(out, F.when(official, 1).otherwise(F.coalesce(F.col("__t"), F.lit(4))).cast("int")).drop("__k", "__d", "__t")


def authority(tier: Column) -> Column:
    return F.when(tier == 1, 1.2).when(tier == 2, 1.1).when(tier == 3, 1.0).otherwise(0.94)


def freshness(published: Column, kind: Column, as_of: datetime | str) -> Column:
    """exp(-rate * whole days of age), rate .1 for News, .005 for Research, .01 else; within [.01, 1]; unknown date .8."""
    days = F.greatest(F.lit(0), F.floor((F.unix_timestamp(F.to_timestamp(F.lit(str(as_of)))) - F.unix_timestamp(published.cast("timestamp"))) / 86400))
    rate = F.when(kind == "News", 0.1).when(kind == "Research", 0.005).otherwise(0.01)
    return F.when(published.isNull(), 0.8).otherwise(F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.exp(-rate * days))))


def boost(score: Column, authority_value: Column, fresh: Column, kind: Column) -> Column:
    """score * (1 + wa * (authority - 1)) * (1 - wf + wf * freshness) with the weights of the query type."""
    pick = lambda n, r, t, f, g: F.when(kind == "News", n).when(kind == "Research", r).when(kind == "Technical", t).when(kind == "Factual", f).otherwise(g)
    wa, wf = pick(0.2, 0.4, 0.3, 0.25, 0.2), pick(0.4, 0.1, 0.1, 0.15, 0.2)
    return score * (1 + wa * (authority_value - 1)) * (1 - wf + wf * fresh)


def official_domains(query: Column) -> Column:
    """Sorted distinct official domains of the entities named in a query."""
    q = F.lower(query)
    table = F.array(*[F.struct(F.lit(e).alias("e"), F.array(*map(F.lit, ds)).alias("d")) for e, ds in X.OFFICIAL_DOMAINS])
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(table, lambda r: F.contains(q, r["e"])), lambda r: r["d"]))))


def named_in_query(query: Column, domain: Column) -> Column:
    label = F.split(organisation(F.lower(domain)), r"\.")[0]
    return (F.octet_length(label) >= 3) & F.contains(F.lower(query), label)


def canonical(domain: Column, officials: Column) -> Column:
    d = F.lower(domain)
    return F.exists(officials, lambda o: (d == o) | (organisation(d) == o) | d.endswith(F.concat(F.lit("."), o)))


def primary_source_boost(query: Column, domain: Column) -> Column:
    """2.5 where the query names the domain, 1.8 where it is an official one of an entity named; both multiply."""
    return F.when(named_in_query(query, domain), 2.5).otherwise(1.0) * F.when(canonical(domain, official_domains(query)), 1.8).otherwise(1.0)


def link_relevance(anchor: Column, url: Column, query: Column) -> Column:
    """Share of query words in the anchor plus half the share in the URL's path."""
    q = F.array_distinct(F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != ""))
    in_anchor = F.size(F.array_intersect(q, F.split(F.lower(anchor), r"[^\p{L}\p{N}]+")))
    in_path = F.size(F.array_intersect(q, F.split(F.lower(F.regexp_replace(url, "^[a-z]+://[^/]*", "")), r"[^\p{L}\p{N}]+")))
    n = F.greatest(F.size(q), F.lit(1))
    return in_anchor / n + 0.5 * in_path / n
