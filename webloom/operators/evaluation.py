"""Ranking quality and crawl coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.urls import label_form


def relevance(ranked: DataFrame, labels: DataFrame, query: str = "query_id", url: str = "url", rank: str = "rank", grade: str = "grade") -> DataFrame:
    """(query, rank, rel): 1 where a label of grade 1 or more has the row's normalised URL. Only labelled queries."""
    known = labels.select(F.col(query), label_form(F.col(url)).alias("k"), F.col(grade).alias("g")).groupBy(query, "k").agg(F.max("g").alias("g"))
    rows = ranked.join(known.select(query).distinct(), query, "left_semi").withColumn("k", label_form(F.col(url)))
    return rows.join(known, [query, "k"], "left").select(query, rank, F.when(F.coalesce("g", F.lit(0)) > 0, 1).otherwise(0).alias("rel"))


def metrics(rel: DataFrame, k_ndcg: int = 10, k_precision: int = 5, query: str = "query_id", rank: str = "rank") -> DataFrame:
    """(query, dcg, ndcg, precision): the ideal is built from the relevant rows present in the ranked list."""
    w = Window.partitionBy(query).orderBy(F.desc("rel"), rank)
    both = rel.withColumn("ideal_rank", F.row_number().over(w))
    gain = lambda r: F.sum(F.when(F.col(r) <= k_ndcg, F.col("rel") / F.log2(F.col(r) + 1)).otherwise(0.0))
    out = both.groupBy(query).agg(gain(rank).alias("dcg"), gain("ideal_rank").alias("idcg"), (F.sum(F.when(F.col(rank) <= k_precision, F.col("rel")).otherwise(0)) / k_precision).alias("precision"))
    return out.select(query, "dcg", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"), "precision")


def coverage(pages: DataFrame, tier: str, clean: str, blocked: str) -> DataFrame:
    """(tier, pages, clean, coverage) with the total in the row of null tier, and the blocked subset as tier "(blocked)"."""
    flags = pages.select(F.col(tier).alias("tier"), F.col(clean).cast("int").alias("c"), F.coalesce(F.col(blocked), F.lit(False)).alias("b"))
    agg = [F.count(F.lit(1)).alias("pages"), F.sum("c").alias("clean"), F.avg("c").alias("coverage")]
    every = flags.rollup("tier").agg(*agg)
    return every.unionByName(flags.where("b").agg(*agg).select(F.lit("(blocked)").alias("tier"), "pages", "clean", "coverage"))


def means(metrics_: DataFrame) -> DataFrame:
    """(queries, mean_ndcg, mean_precision); no row's value is null where nothing was judged."""
    return metrics_.agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("mean_ndcg"), F.coalesce(F.avg("precision"), F.lit(0.0)).alias("mean_precision"))


def answers(results: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, rank, url): the result URLs of tool answers in order; an answer that is no such JSON has none."""
    parsed = F.from_json(F.col(json_col), "struct<results:array<struct<url:string>>>")
    return results.select(F.col(id_col).alias("id"), F.posexplode(parsed["results"]["url"]).alias("p", "url")).where("url is not null").select("id", (F.col("p") + 1).alias("rank"), "url")


def scored_runs(asked: DataFrame, ranked: DataFrame, labels: DataFrame, query: str = "query_id") -> DataFrame:
    """Metrics of every query asked; a call that failed or found nothing scores 0."""
    got = metrics(relevance(ranked, labels, query), query=query)
    return asked.select(query).distinct().join(got, query, "left").fillna(0.0, ["dcg", "ndcg", "precision"])


def tier_label(tier: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(tier)), F.lit("")), F.lit("untiered"))
