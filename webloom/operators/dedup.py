"""Three-level duplicate check (URL within a time to live, equal content, near-equal fingerprint) and caches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.hashing import content_hash, hamming
from webloom.session import stage_table

BANDS = 4


def url_duplicates(rows: DataFrame, url: str, at: str, tie: str, ttl_seconds: int) -> DataFrame:
    """rows with `duplicate`: the URL was taken up less than or exactly ttl seconds before (0: ever).

    A pause beyond the ttl always starts anew, so runs between such pauses are independent; the rows of a
    run are walked in order in Arrow batches with one number of state, and the runs of one busy URL spread over
    tasks. A null URL is a URL of its own; a null time is no duplicate and takes nothing up.
    """
    seconds = F.unix_timestamp(F.col(at).cast("timestamp"))
    w = Window.partitionBy(url).orderBy(at, tie)
    if ttl_seconds == 0:
        return rows.withColumn("duplicate", F.row_number().over(w) > 1)
    keyed = rows.select(F.col(url).cast("string").alias("__u"), F.col(tie).alias("__tie"), seconds.alias("__s")).where("__s is not null")
    hour = Window.partitionBy("__u").orderBy("__s", "__tie")
    gap = F.col("__s") - F.lag("__s").over(hour)
    run = keyed.withColumn("__new", F.coalesce(gap > ttl_seconds, F.lit(True)).cast("int")).withColumn("__run", F.sum("__new").over(hour))
    kind = dict(keyed.dtypes)["__tie"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for b in batches:
            out = []
            for key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                again = last is not None and last[:2] == key[:2] and key[2] - last[2] <= ttl_seconds
                out.append(again)
                last = last if again else key
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.bool_())], names=["__u", "__tie", "duplicate"])

    ordered = run.select("__u", "__run", "__tie", "__s").repartition("__u", "__run").sortWithinPartitions("__u", "__run", "__s", "__tie")
    flags = ordered.mapInArrow(walk, f"__u string, __tie {kind}, duplicate boolean")
    joined = rows.join(flags, rows[url].cast("string").eqNullSafe(flags["__u"]) & rows[tie].eqNullSafe(flags["__tie"]), "left")
    return joined.withColumn("duplicate", F.coalesce("duplicate", F.lit(False))).drop("__u", "__tie")


def exact_duplicates(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, original): every document whose text an earlier id already has. Null texts are no duplicates."""
    h = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), content_hash(F.col(text)).alias("h"))
    first = h.groupBy("h").agg(F.min("id").alias("original"))
    return h.join(first, "h").where(F.col("id") != F.col("original")).select("id", "original")


def near_pairs(fps: DataFrame, bits: int = 3, width: int = 60) -> DataFrame:
    """(fp_a, fp_b, distance): pairs of distinct fingerprints at most `bits` apart, with no pair lost.

    With bits + 1 bands at least one is equal (pigeonhole), so fingerprints meet on (band, value). Equal
    fingerprints are collapsed to one before, so copies never multiply.
    """
    bands = bits + 1
    each = width // bands
    f = fps.select("fp").distinct()
    parts = F.array(*[F.struct(F.lit(b).alias("band"), F.shiftrightunsigned("fp", b * each).bitwiseAND(F.lit((1 << (each if b < bands - 1 else width - each * b)) - 1)).alias("value")) for b in range(bands)])
    listed = f.select("fp", F.inline(parts))
    a, b = listed.withColumnRenamed("fp", "fp_a"), listed.withColumnRenamed("fp", "fp_b")
    met = a.join(b, ["band", "value"]).where(F.col("fp_a") < F.col("fp_b")).withColumn("distance", hamming(F.col("fp_a"), F.col("fp_b"))).where(F.col("distance") <= bits)
    return met.select("fp_a", "fp_b", "distance").distinct()


def near_duplicates(fps: DataFrame, bits: int = 3, width: int = 60) -> DataFrame:
    """(id, class_id, links): one row a document with the smallest id of its fingerprint's class and the number of other fingerprints near it."""
    reps = fps.groupBy("fp").agg(F.min("id").alias("class_id"))
    pairs = near_pairs(fps, bits, width)
    both = pairs.select(F.col("fp_a").alias("fp")).unionAll(pairs.select(F.col("fp_b").alias("fp"))).groupBy("fp").agg(F.count(F.lit(1)).alias("links"))
    return fps.join(reps, "fp").join(both, "fp", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def three_level(docs: DataFrame, row: str, url: str, at: str, content: str, fp: str, ttl_seconds: int, bits: int = 3) -> DataFrame:
    """(row, verdict): url, exact, near or unique, as if the rows came in order of (at, row) and only unique ones were registered.

    What a row is judged against depends on the verdicts before it, so verdicts are settled in rounds. In each round
    the earliest unique and the earliest unsettled row of every content and of every fingerprint with its near ones, and
    the latest of both in a URL's run of visits, tell which rows hit a unique one and which need wait for nobody: these
    are settled. Only such group values meet the rows, never pairs of rows. A round settles at least the first of
    every chain of rows that depend on one another; a URL's runs end at pauses beyond the ttl. A null URL, content,
    or fingerprint matches nothing; a null time comes first.
    """
    seconds = F.coalesce(F.unix_timestamp(F.col(at).cast("timestamp")), F.lit(0))
    base = docs.select(F.col(row).cast("long").alias("id"), F.col(url).alias("url"), seconds.alias("at"), F.col(content).alias("content"), F.col(fp).cast("long").alias("fp"))
    if ttl_seconds:
        own = Window.partitionBy("url").orderBy("at", "id")
        base = base.withColumn("new", F.coalesce(F.col("at") - F.lag("at").over(own) > ttl_seconds, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(own)).drop("new")
    else:
        base = base.withColumn("run", F.lit(0).cast("long"))
    left = stage_table(base, "dedup-rows")
    near = near_pairs(left.select("fp").where("fp is not null"), bits).select("fp_a", "fp_b")
    self_ = left.select("fp").where("fp is not null").distinct().select(F.col("fp").alias("fp_a"), F.col("fp").alias("fp_b"))
    near = stage_table(near.unionAll(near.select(F.col("fp_b").alias("fp_a"), F.col("fp_a").alias("fp_b"))).unionAll(self_), "dedup-near")
    me, never = F.struct("at", "id"), F.lit(None).cast("struct<at:bigint,id:bigint>")
    first = lambda flag: F.min(F.when(F.col("kept") == flag, F.struct("at", "id")))
    kept = left.limit(0)
    settled: list[DataFrame] = []
    while True:
        pool = left.withColumn("kept", F.lit(0)).unionByName(kept.withColumn("kept", F.lit(1)))
        by_content = pool.where("content is not null").groupBy("content").agg(first(1).alias("c1"), first(0).alias("c0"))
        by_fp = pool.where("fp is not null").groupBy("fp").agg(first(1).alias("k1"), first(0).alias("k0"))
        by_near = near.join(by_fp, F.col("fp_b") == F.col("fp")).groupBy("fp_a").agg(F.min("k1").alias("f1"), F.min("k0").alias("f0"))
        before = Window.partitionBy("url", "run").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
        latest = lambda flag: F.max(F.when(F.col("kept") == flag, F.struct("at", "id"))).over(before)
        seen = pool.withColumns({"u1": F.when(F.col("url").isNotNull(), latest(1)).otherwise(never), "u0": F.when(F.col("url").isNotNull(), latest(0)).otherwise(never)}).where("kept = 0")
        both = seen.join(by_content, "content", "left").join(by_near, F.col("fp") == F.col("fp_a"), "left")
        fresh = (lambda c: F.col(c).isNotNull()) if ttl_seconds == 0 else (lambda c: F.col("at") - F.col(f"{c}.at") <= ttl_seconds)
        earlier = lambda c: F.coalesce(F.col(c) < me, F.lit(False))
        verdict = (
            F.when(F.coalesce(fresh("u1"), F.lit(False)), "url").when(F.coalesce(fresh("u0"), F.lit(False)), "wait")
            .when(earlier("c1"), "exact").when(earlier("c0"), "wait")
            .when(earlier("f1"), "near").when(earlier("f0"), "wait").otherwise("unique")
        )
        judged = stage_table(both.select("id", "url", "at", "content", "fp", "run", verdict.alias("verdict")), "dedup-round")
        settled.append(judged.where("verdict <> 'wait'").select(F.col("id").alias(row), "verdict"))
        kept = kept.unionByName(judged.where("verdict = 'unique'").drop("verdict"))
        left = judged.where("verdict = 'wait'").drop("verdict")
        if left.isEmpty():
            break
        kept = stage_table(kept, "dedup-kept")
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def register(events: pd.DataFrame, ttl_seconds: int, bits: int = 3) -> list[str]:
    """Verdict of every event in order: url, exact, near or unique; only unique ones are registered.

    events: url, at (seconds), content, fp. The straight form of the check for small ordered streams.
    """
    seen: dict[str, float] = {}
    hashes: dict[str, str] = {}
    fingerprints: list[int] = []
    out = []
    for url, at, content, fp in events[["url", "at", "content", "fp"]].itertuples(index=False):
        if url in seen and (ttl_seconds == 0 or at - seen[url] <= ttl_seconds):
            out.append("url")
        elif content in hashes:
            out.append("exact")
        elif any(((fp ^ f) & (2**64 - 1)).bit_count() <= bits for f in fingerprints):
            out.append("near")
        else:
            out.append("unique")
            seen[url] = at
            hashes[content] = url
            fingerprints.append(fp)
    return out


def cache_split(wanted: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of a content-addressed cache; duplicate keys of the cache count once."""
    known = cache.dropDuplicates([key])
    return wanted.join(known, key), wanted.select(key).distinct().join(known.select(key), key, "left_anti")


def newest(cache: DataFrame, at: str, tie: str, cap: int, min_at: int | None = None) -> DataFrame:
    """The `cap` newest entries, none older than min_at; one global top-k without a single-task sort."""
    live = cache if min_at is None else cache.where(F.col(at) > min_at)
    return live.orderBy(F.desc(at), tie).limit(cap)


def fresh(at: Column, now: Column, ttl_seconds: int) -> Column:
    return F.lit(True) if ttl_seconds == 0 else (F.unix_timestamp(now) - F.unix_timestamp(at) <= ttl_seconds)
