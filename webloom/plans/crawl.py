"""Crawling over tables: pages are a table, fetching is a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import frontier_form, host
from webloom.session import stage_table
from webloom.sources.feeds import next_page


def fetch(pages: DataFrame, wanted: DataFrame, url: str = "url") -> DataFrame:
    """The pages of the wanted URLs."""
    return pages.join(wanted.select(url).distinct(), url, "left_semi")


def crawl(pages: DataFrame, seeds: DataFrame, max_depth: int = 2, max_pages: int | None = None, allowed: DataFrame | None = None, url: str = "url", links: str = "links") -> DataFrame:
    """(url, depth): pages reached from the seeds, each once at its least depth.

    Internal links are followed at any depth, external ones from depth 0 only. One join a depth; each level
    is staged, so lineage doesn't grow and a lost executor costs one level. allowed: URLs that robots rules
    permit (all if None). max_pages stops before a level that would pass it, keeping its smallest URLs.
    """
    edges = pages.select(frontier_form(F.col(url)).alias("src"), F.explode(links).alias("l")).select("src", frontier_form(F.col("l.url")).alias("url"), F.col("l.is_external").alias("external"))
    known = pages.select(frontier_form(F.col(url)).alias("url")).distinct()
    if allowed is not None:
        known = known.join(allowed.select(frontier_form(F.col("url")).alias("url")).distinct(), "url", "left_semi")
    level = seeds.select(frontier_form(F.col(url)).alias("url")).distinct().join(known, "url", "left_semi")
    seen = None
    for depth in range(max_depth + 1):
        now = level.withColumn("depth", F.lit(depth))
        if seen is not None:
            now = now.join(seen.select("url"), "url", "left_anti")
        if max_pages is not None:
            left = max_pages - (0 if seen is None else seen.count())
            now = now.orderBy("url").limit(max(0, left))
        now = stage_table(now, f"crawl-{depth}")
        seen = now if seen is None else seen.unionByName(now)
        if depth == max_depth or now.isEmpty():
            break
        out = edges.join(now.select(F.col("url").alias("src")), "src", "left_semi")
        out = out if depth == 0 else out.where(~F.coalesce(F.col("external"), F.lit(False)))
        level = out.select("url").distinct().join(known, "url", "left_semi")
    return seen


def paginate(pages: DataFrame, start: str, max_pages: int = 10, url: str = "url") -> DataFrame:
    """(position, page...): the pages that follow a start by its URL pattern, as far as they exist."""
    wanted, at = [], start
    while at and len(wanted) < max_pages:
        wanted.append((len(wanted), at))
        at = next_page(at)
    spark = pages.sparkSession
    return spark.createDataFrame(wanted, "position int, __u string").join(pages, F.col("__u") == F.col(url)).drop("__u")


def robots_allowed(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """urls with allowed and crawl_delay of their host's rules (host, allowed_prefixes, denied_prefixes, crawl_delay); hosts without rules allow everything.

    The longest matching prefix decides, an allowing one on a tie.
    """
    path = F.regexp_replace(F.regexp_replace(F.col(url), "#.*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*", "")
    known = rules.select(F.col("host").alias("__h"), "allowed_prefixes", "denied_prefixes", "crawl_delay")
    joined = urls.withColumn("__host", host(F.col(url))).join(known, F.col("__host") == F.col("__h"), "left").withColumn("__p", path)
    longest = lambda c: F.coalesce(F.array_max(F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda p: F.startswith(F.col("__p"), p)), lambda p: F.length(p))), F.lit(-1))
    a, d = longest(F.col("allowed_prefixes")), longest(F.col("denied_prefixes"))
    return joined.withColumn("allowed", (d <= 0) | (a >= d)).drop("__host", "__h", "__p", "allowed_prefixes", "denied_prefixes")


def follow_pages(pages: DataFrame, start: str, max_pages: int = 10, url: str = "url", links: str = "links") -> DataFrame:
    """(position, page...): a page and those after it, by a link whose rel says next, else by the URL's pattern; at most max_pages lookups of one row."""
    wanted, at = [], start
    while at and len(wanted) < max_pages and at not in [u for _, u in wanted]:
        wanted.append((len(wanted), at))
        here = pages.where(F.col(url) == at).select(F.get(F.filter(links, lambda x: F.array_contains(F.split(F.lower(F.coalesce(x["rel"], F.lit(""))), r"\s+"), "next")), F.lit(0))["url"].alias("n")).first()
        at = (here.n if here is not None and here.n else None) or next_page(at)
    return pages.sparkSession.createDataFrame(wanted, "position int, __u string").join(pages, F.col("__u") == F.col(url)).drop("__u")
