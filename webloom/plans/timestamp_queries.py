"""Queries over the date strings of data layers, news entries and archive captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators.timestamps import normalise_timestamps
from webloom.registry import Registry
from webloom.tables import load

registry = Registry()


@registry.query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date string that names one day or instant, as whole milliseconds of UTC."""
    layers = load(spark, sf_dir, "data_layers").select(
        "domain",
        F.inline(
            F.array(
                F.struct(F.lit("structured_article").alias("src"), F.col("layer_id").alias("rec_id"), F.col("structured_article.date").alias("value")),
                F.struct(F.lit("hydration").alias("src"), F.col("layer_id").alias("rec_id"), F.col("hydration.published").alias("value")),
            )
        ),
    )
    news = load(spark, sf_dir, "news_entries").select("domain", F.lit("news_entry").alias("src"), F.col("news_id").alias("rec_id"), F.col("publication_date").alias("value"))
    cdx = load(spark, sf_dir, "cdx_snapshots").select("domain", F.lit("cdx_snapshot").alias("src"), F.col("snap_id").alias("rec_id"), F.col("timestamp").alias("value"))
    sites = load(spark, sf_dir, "sites")
    return normalise_timestamps(layers.unionByName(news), sites).unionByName(normalise_timestamps(cdx, sites, digits="cdx"))
