"""From raw fetches to index candidates: type gate, duplicates, extraction, quality and language filters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.hashing import content_hash, simhash_frame
from webloom.functions.urls import host
from webloom.operators import dedup, filters, text_index
from webloom.sources import extract, responses
from webloom.tables import spread


def ingest(fetches: DataFrame, fetch_id: str = "fetch_id", url: str = "url", body: str = "body", at: str = "fetched_at", english_only: bool = False, url_ttl_seconds: int = 3600) -> DataFrame:
    """(id, url, domain, title, body_text, confidence, language): one row for each page worth indexing.

    Cheap native filters come before the extractor, so Python only sees pages that can be kept: parsable
    type, real content by its class, and of the three-level check over the raw pages (URL, equal, near) the unique ones.
    """
    typed = fetches.where(filters.parsable_type(F.col("content_type")) & F.col(body).isNotNull())
    real = typed.where(responses.classify(F.col("status"), F.col(body), F.col(url)) == "real_content")
    keyed = real.select(F.col(fetch_id).cast("long").alias("id"), F.col(url).alias("url"), F.col(body).alias("body"), F.col(at).alias("at"))
    prints = simhash_frame(spread(keyed.select("id", "body")), "id", "body")
    narrow = keyed.select("id", "url", "at", content_hash(F.col("body")).alias("content")).join(prints, "id")
    verdicts = dedup.three_level(narrow, "id", "url", "at", "content", "fp", url_ttl_seconds)
    fresh = keyed.join(verdicts.where("verdict = 'unique'"), "id")
    got = extract.extracted(spread(fresh.select("id", "url", "body")), "id", "body", "url")
    kept = got.where(filters.long_enough(F.col("body_text")) & ~filters.low_quality(F.col("body_text"), F.col("url")) & ~filters.result_listing(F.col("url"), F.col("body_text")))
    if english_only:
        kept = kept.where(filters.english(F.col("language"), F.col("body_text")))
    return kept.select("id", "url", host(F.col("url")).alias("domain"), "title", "body_text", "confidence", "language")


def ingest_into(fetches: DataFrame, index_path: str, pages_path: str, **options) -> DataFrame:
    """Ingest a batch: its pages are appended to the page table and, as one segment, to the text index; returns the pages."""
    pages = ingest(fetches, **options)
    folder = f"{pages_path}/batch={uuid.uuid4().hex}"
    pages.write.parquet(folder)
    stored = pages.sparkSession.read.parquet(folder)
    text_index.append(stored, "id", ["title", "body_text"], index_path)
    return stored
