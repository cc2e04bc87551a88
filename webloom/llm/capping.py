"""Limits for dominant contributors: a largest count, or a largest share of what is kept.

A share limit is solved by water-filling over the sorted contributor counts of a scope: the largest level
c for which every contributor cut to c holds at most `max_share` of all that is kept. The counts are
aggregated to a histogram of counts first (at most about sqrt(2n) distinct counts in a scope of n rows),
so prefix sums run over that, never over rows. Each contributor's best rows by score are kept; ranks come
from exact_rank, which cuts groups that hold more than a thousandth of all rows into cells.

Defined results: null and NaN scores come last, ties go to the smaller id; a null contributor is one
contributor of its own; a null scope is a scope. A share that no level can meet (fewer contributors than
1/max_share) is met as nearly as whole rows allow: one row of each is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.operators.group_rank import exact_rank


def host_of(name: Column) -> Column:
    """One name for all spellings of a host: lower case, no outer blanks, scheme, path, port, final dot or leading www."""
    host = F.lower(F.regexp_replace(name, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    host = F.regexp_replace(F.regexp_replace(host, "^[a-z][a-z0-9+.-]*://", ""), "[/?#].*$", "")
    host = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":\d*$", "")
    return F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.(?=.)", "")


def ranked(df: DataFrame, scope: list[str], contributor: str, score: str, tie: str) -> DataFrame:
    return exact_rank(df, [*scope, contributor], score, tie, out="rank_in_contributor")


def over_count(df: DataFrame, scope: list[str], contributor: str, score: str, tie: str, max_count: int) -> DataFrame:
    """The rows that must go: all but the max_count best of each contributor in each scope."""
    return ranked(df, scope, contributor, score, tie).where(F.col("rank_in_contributor") > max_count)


def share_levels(df: DataFrame, scope: list[str], contributor: str, max_share: float) -> DataFrame:
    """(scope..., level): the most rows a contributor may keep so that no share passes max_share."""
    counts = df.groupBy(*scope, contributor).agg(F.count(F.lit(1)).alias("n"))
    hist = counts.groupBy(*scope, "n").agg(F.count(F.lit(1)).alias("k"))
    up = Window.partitionBy(*scope).orderBy("n")
    below = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    hist = hist.withColumns(
        {
            "filled": F.coalesce(F.sum(F.col("n") * F.col("k")).over(below), F.lit(0)),
            "open": F.sum("k").over(rest),
            "prev": F.coalesce(F.max("n").over(below), F.lit(0)),
        }
    )
    # between two neighbouring counts the kept total is filled + open * level; level <= share * total bounds the level
    slope = 1 - max_share * F.col("open")
    bound = F.when(slope <= 1e-12, F.col("n").cast("double")).otherwise(F.floor(max_share * F.col("filled") / slope + 1e-9))
    level = F.least(F.col("n").cast("double"), bound)
    fits = hist.where(level > F.col("prev")).withColumn("level", level.cast("long"))
    best = fits.groupBy(*scope).agg(F.max("level").alias("level"))
    every = counts.select(*scope).distinct()
    on = [every[c].eqNullSafe(best[c]) for c in scope]
    return every.join(best, on, "left").select(*[every[c] for c in scope], F.coalesce("level", F.lit(1)).alias("level"))


def capped_by_share(df: DataFrame, scope: list[str], contributor: str, score: str, tie: str, max_share: float) -> DataFrame:
    """The kept rows, with rank_in_contributor and level."""
    rows = ranked(df, scope, contributor, score, tie)
    levels = share_levels(df, scope, contributor, max_share)
    renamed = levels.select(*[F.col(c).alias(f"__{c}") for c in scope], F.col("level").alias("__level"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in scope]
    kept = rows.join(renamed, on, "left").where(F.col("rank_in_contributor") <= F.col("__level"))
    return kept.withColumn("level", F.col("__level")).drop("__level", *[f"__{c}" for c in scope])
