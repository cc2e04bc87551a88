"""Tables kept between runs: postings, vectors, caches with a time to live, denylists, reports.

All are Parquet or JSON-lines folders. Replacing writes go to a new folder named by the caller, so a failed
job never damages the old one.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.operators.retrieval import postings


def write_index(docs: DataFrame, id_col: str, fields: list[str], path: str, partitions: int | None = None) -> None:
    """Postings sorted by term within files, so that a lookup reads few row groups."""
    p = postings(docs, id_col, fields)
    p = p.repartition(partitions, "term") if partitions else p.repartition("term")
    p.sortWithinPartitions("term").write.mode("append").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """One row a key, the latest by `at`; of equal times the new one."""
    both = old.withColumn("__n", F.lit(0)).unionByName(new.withColumn("__n", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc("__n"))
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__n")


def delete(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def load_vectors(spark: SparkSession, path: str, vec_col: str, dim: int) -> DataFrame:
    """Vectors of the right length only."""
    return spark.read.parquet(path).where(F.size(vec_col) == dim)


def evict(rows: DataFrame, at: str, tie: str, cap: int | None = None, cutoff: int | None = None) -> DataFrame:
    """Entries stored after the cutoff, the newest `cap` of them."""
    live = rows if cutoff is None else rows.where(F.col(at) > cutoff)
    return live if cap is None else live.orderBy(F.desc(at), tie).limit(cap)


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, entries)."""
    parts = [df.agg(F.count(F.lit(1)).alias("entries")).select(F.lit(n).alias("table"), "entries") for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def append_denylist(spark: SparkSession, path: str, rows: list[dict]) -> None:
    spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").write.mode("append").text(path)


def load_denylist(spark: SparkSession, path: str) -> DataFrame:
    """(domain, reason, at); malformed lines are skipped."""
    return spark.read.schema("domain string, reason string, at string").option("mode", "DROPMALFORMED").json(path).where("domain is not null")


def to_page(extracted: DataFrame, crawl: DataFrame) -> DataFrame:
    """Canonical pages: extraction joined to the crawl row by id, metadata in one struct. crawl: id, content_type, status, response_time_ms, fetched_at."""
    both = extracted.join(crawl, "id")
    return both.select(
        "id", "url", "title", "author", "published", "body_text", "headings", "links", "tables",
        F.struct(
            "language", "description", "content_type", F.col("status").alias("status_code"), "response_time_ms",
            F.octet_length("body_text").cast("long").alias("content_length"), F.col("confidence").alias("extraction_confidence"),
            F.struct("og_title", "og_type", "og_site_name").alias("open_graph"),
        ).alias("metadata"),
        F.substring(F.sha2("body_text", 256), 1, 16).alias("content_hash"), F.col("fetched_at").alias("crawled_at"),
    )


def markdown_report(coverage: list[dict], ranking: list[dict]) -> str:
    """A short report of coverage by tier and ranking quality by query."""
    lines = ["# Report", "", "| tier | clean | pages | coverage |", "|---|---|---|---|"]
    lines += [f"| {r['tier'] or 'all'} | {r['clean']} | {r['pages']} | {r['coverage']:.4f} |" for r in coverage]
    lines += ["", "| query | nDCG@10 | P@5 |", "|---|---|---|"] + [f"| {r['query_id']} | {r['ndcg']:.4f} | {r['precision']:.4f} |" for r in ranking]
    if ranking:
        lines.append(f"| mean | {sum(r['ndcg'] for r in ranking) / len(ranking):.4f} | {sum(r['precision'] for r in ranking) / len(ranking):.4f} |")
    return "\n".join(lines) + "\n"


def save_dedup_state(urls: DataFrame, contents: DataFrame, fingerprints: DataFrame, path: str) -> None:
    """urls: (url, at); contents: (hash, url); fingerprints: (fp, url). Written as one folder a state."""
    for name, df in (("urls", urls), ("contents", contents), ("fingerprints", fingerprints)):
        df.write.mode("errorifexists").parquet(f"{path}/{name}")


def load_dedup_state(spark: SparkSession, path: str, now_seconds: int, ttl_seconds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three states, expired URLs left out; a ttl of 0 keeps all."""
    urls, contents, fps = (spark.read.parquet(f"{path}/{n}") for n in ("urls", "contents", "fingerprints"))
    if ttl_seconds:
        urls = urls.where(F.lit(now_seconds) - F.unix_timestamp("at") <= ttl_seconds)
    return urls, contents, fps


def flush(new: DataFrame, path: str, key: str, at: str = "stored_at") -> None:
    """Append one batch of cache entries; of a key's entries in the batch the latest stays. Readers take the latest over all batches (`newest_entries`)."""
    order = Window.partitionBy(key).orderBy(F.desc(at))
    new.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r").write.mode("append").parquet(path)


def newest_entries(spark: SparkSession, path: str, key: str, at: str = "stored_at", cutoff: int | None = None) -> DataFrame:
    """The latest entry of every key, none stored at or before the cutoff (a loaded cache)."""
    rows = spark.read.parquet(path)
    latest = Window.partitionBy(key).orderBy(F.desc(at))
    live = rows if cutoff is None else rows.where(F.col(at) > cutoff)
    return live.withColumn("__r", F.row_number().over(latest)).where("__r = 1").drop("__r")


class WriteBehind:
    """Pending batches of cache tables, flushed on commit and when the block ends, also by an error."""

    def __init__(self, paths: dict[str, tuple[str, str]]) -> None:
        self.paths = paths
        self.pending: dict[str, list[DataFrame]] = {name: [] for name in paths}

    def put(self, name: str, rows: DataFrame) -> None:
        self.pending[name].append(rows)

    def commit(self) -> dict[str, int]:
        """How many batches of every table were written."""
        done = {}
        for name, batches in self.pending.items():
            path, key = self.paths[name]
            for rows in batches:
                flush(rows, path, key)
            done[name] = len(batches)
            self.pending[name] = []
        return done

    def __enter__(self) -> WriteBehind:
        return self

    def __exit__(self, *error: object) -> None:
        self.commit()


def flush_stream(stream: DataFrame, path: str, checkpoint: str, seconds: int | None = 30):
    """A running query that appends a stream to a cache table every `seconds` (None: what is there, once)."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def put_queries(cache: DataFrame, new: DataFrame, now: int, ttl_seconds: int = 14_400, cap: int = 100) -> DataFrame:
    """The query cache after new answers: those without results are not taken, expired ones go, the newest `cap` stay. Columns id, results, cached_at (seconds)."""
    both = cache.unionByName(new.where("results > 0")).where(F.lit(now) - F.col("cached_at") <= ttl_seconds)
    latest = Window.partitionBy("id").orderBy(F.desc("cached_at"))
    return both.withColumn("__r", F.row_number().over(latest)).where("__r = 1").drop("__r").orderBy(F.desc("cached_at"), "id").limit(cap)


def hit_counts(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """(hits, misses, entries) of a cache for a stream of lookups."""
    known = cache.select(F.col(key).alias("__k")).distinct()
    looked = wanted.select(F.col(key)).join(known, F.col(key) == F.col("__k"), "left")
    counts = looked.agg(F.count("__k").alias("hits"), (F.count(F.lit(1)) - F.count("__k")).alias("misses"))
    return counts.join(known.agg(F.count(F.lit(1)).alias("entries")))


def enqueue(jobs: DataFrame, path: str) -> None:
    """Append jobs (url, priority, queued_at) to a queue table."""
    jobs.select("url", F.col("priority").cast("int").alias("priority"), F.col("queued_at").cast("timestamp").alias("queued_at")).write.mode("append").parquet(path)


def queue_stats(spark: SparkSession, path: str) -> DataFrame:
    """(priority, jobs, oldest) of a queue table."""
    return spark.read.parquet(path).groupBy("priority").agg(F.count(F.lit(1)).alias("jobs"), F.min("queued_at").alias("oldest"))
