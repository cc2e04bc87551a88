"""A mixture of sources in target shares of tokens, small sources repeated up to a cap.

The total is given or the largest at which every source that has documents and a target can give its
share within its cap. Sainte-Laguë apportionment (highest quotients w / (2k + 1)) turns the target into
whole blocks of equal tokens for each source, never more than the source can give, and again splits a
source's blocks over shards of its documents in proportion to their tokens. Within a shard the documents
lie in a seeded random order on a line of tokens, and the first blocks of that line are taken: whole
rounds first, then a part. A document belongs to the part if its middle does. Documents longer than a block
lie on a line of their own and are drawn first; the short ones fill what those leave, so that a share is
missed by less than a block where a shard has short documents.

Only one row a source reaches the driver. Shards, whose number follows the tokens (SHARD_TOKENS each), are
apportioned inside Spark: the seats that a shard surely has and the few quotients near the threshold follow from
the source's sums, and an exact rank of those quotients decides. The document table stays distributed, a hot
source is spread over its shards, and token counts are computed once and staged.

Defined results: source names ignore case and outer blanks; null sources, sources without target and
documents without tokens take no part; a target without documents is reported with share 0 and its weight
goes to the others in proportion.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm import tokens as T
from webloom.operators.group_rank import exact_rank
from webloom.session import stage_table

SHARD_TOKENS = 4_000_000
BLOCK_TOKENS = 512
MAX_TARGETS = 100_000


def source_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def sainte_lague(weights: dict, seats: int, caps: dict | None = None) -> dict:
    """Seats by highest quotients w / (2k + 1), none beyond its cap; ties to the smaller key.

    Most seats are dealt at once from the divisor's lower bound, the last few one by one, so the time
    doesn't grow with the seats.
    """
    caps = caps or {}
    live = {k: w for k, w in weights.items() if w > 0 and caps.get(k, seats) > 0}
    got = dict.fromkeys(weights, 0)
    if not live or seats <= 0:
        return got
    limit = lambda k, n: min(n, caps.get(k, n))
    # the largest divisor step t with sum of floor(w * t + 1/2) <= seats, found by bisection from below
    lo, hi = 0.0, (seats + len(live)) / min(live.values())
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(limit(k, int(w * mid + 0.5)) for k, w in live.items()) <= seats:
            lo = mid
        else:
            hi = mid
    safe = lo * (1 - 1e-12)
    for k, w in live.items():
        got[k] = limit(k, max(0, int(w * safe + 0.5)))
    left = seats - sum(got.values())
    heap = [(-w / (2 * got[k] + 1), k) for k, w in live.items() if got[k] < caps.get(k, seats)]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, k = heapq.heappop(heap)
        got[k] += 1
        left -= 1
        if got[k] < caps.get(k, seats):
            heapq.heappush(heap, (-live[k] / (2 * got[k] + 1), k))
    return got


def shard_seats(shards: DataFrame, block: int) -> DataFrame:
    """(source, shard, given): the seats of a source dealt to its shards by Sainte-Lague over their tokens, none beyond its blocks.

    shards: source, shard, t (tokens), seats (of the whole source, at most its tokens / block). With N shards,
    scaling the quotas by 1 - 1.5 N / seats deals too few seats and by 1 + 1.5 N / seats enough, so only about
    3 N quotients are in doubt; they are ranked exactly, in cells where a source has many shards.
    """
    sums = shards.groupBy("source").agg(F.sum("t").alias("all_t"), F.count(F.lit(1)).alias("n"))
    x = F.col("seats") * F.col("t") / F.col("all_t")
    margin = 1.5 * F.col("n") / F.greatest(F.col("seats"), F.lit(1))
    most = F.ceil(F.col("t") / block)
    band = shards.join(sums, "source").withColumns({"low": F.greatest(F.lit(0), F.least(most, F.floor(x * (1 - margin) - 0.5))).cast("long"), "high": F.least(most, F.ceil(x * (1 + margin)) + 1).cast("long")})
    doubtful = band.where((F.col("high") > F.col("low")) & (F.col("seats") > 0)).select("source", "shard", "t", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("j"))
    ranked = exact_rank(doubtful.select("source", "shard", (F.col("t") / (2 * F.col("j") + 1)).alias("quotient")), ["source"], "quotient", "shard", out="place")
    left = band.groupBy("source").agg((F.first("seats") - F.sum("low")).alias("left"))
    won = ranked.join(left, "source").where(F.col("place") <= F.col("left")).groupBy("source", "shard").agg(F.count(F.lit(1)).alias("won"))
    return band.join(won, ["source", "shard"], "left").select("source", "shard", (F.col("low") + F.coalesce("won", F.lit(0))).alias("given"))


def _count(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [T.count(t.as_py(), tokenizer) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])


def token_sizes(docs: DataFrame, id_col: str = "doc_id", tokenizer: str = T.RANKS) -> DataFrame:
    """(doc_id, source, n_tokens) of every document with a source and a text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), source_name(F.col("source")).alias("source"), "text").where("source is not null and text is not null")
    return rows.mapInArrow(lambda it: _count(it, tokenizer), "doc_id long, source string, n_tokens long").where("n_tokens > 0")


@dataclass(frozen=True)
class Mixture:
    documents: DataFrame
    report: list[dict]


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, block: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, tokenizer: str = T.RANKS) -> Mixture:
    """documents: (doc_id, source, n_tokens, repeats >= 1), and one report row a target."""
    wanted = targets.select(source_name(F.col("source")).alias("source"), F.col("target_weight").cast("double").alias("w"), F.col("max_repeats").cast("long").alias("cap"))
    wanted = wanted.where("source is not null").groupBy("source").agg(F.sum("w").alias("w"), F.max("cap").alias("cap"))
    rows = wanted.limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    weight = {r.source: max(0.0, r.w or 0.0) for r in rows}
    cap = {r.source: max(0, r.cap if r.cap is not None else 1) for r in rows}
    sizes = stage_table(token_sizes(docs, tokenizer=tokenizer), "mix-sizes")
    sums = sizes.groupBy("source").agg(F.sum("n_tokens").alias("t")).where(F.col("source").isin(list(weight)) if weight else F.lit(False))
    all_tokens = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    total_of = {r.source: r.t for r in sums.collect()}
    live = {s: w for s, w in weight.items() if w > 0 and cap[s] > 0 and total_of.get(s)}
    norm = sum(live.values())
    reach = min((cap[s] * total_of[s] * norm / w for s, w in live.items()), default=0.0)
    total = reach if total_tokens is None else total_tokens
    quota = sainte_lague(live, round(total / block), {s: cap[s] * total_of[s] // block for s in live})
    parts = [(s, *divmod(quota[s] * block, total_of[s])) for s in live]
    sources = docs.sparkSession.createDataFrame([(s, int(whole), round(rest / block)) for s, whole, rest in parts], "source string, whole long, seats long")
    shards = max(1, round(all_tokens / shard_tokens))
    sharded = sizes.join(sources, "source").withColumns({"shard": F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(shards)).cast("int"), "long": F.col("n_tokens") > block})
    own = sharded.groupBy("source", "shard").agg(F.sum("n_tokens").alias("t"), F.first("seats").alias("seats"))
    # one row a shard; written once, since report and documents both read it
    given = stage_table(shard_seats(own, block).select("source", "shard", (F.col("given") * block).alias("part")), "mix-shards")
    # all windows share one exchange by (source, shard)
    lines = sharded.join(given, ["source", "shard"])
    line = Window.partitionBy("source", "shard", "long").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("source", "shard")
    size = F.col("n_tokens")
    lines = lines.withColumns({"t": F.sum("n_tokens").over(every), "tl": F.sum(F.when(F.col("long"), size).otherwise(0)).over(every)})
    lines = lines.withColumn("before", F.coalesce(F.sum("n_tokens").over(line), F.lit(0)))
    within = lambda part: F.when(F.col("before") + size / 2 <= part, 1).otherwise(0)
    # documents longer than a block have a line of their own; what they miss or pass their part by, the short ones make up
    lines = lines.withColumn("long_taken", F.when(F.col("long"), within(F.round(F.col("part") * F.col("tl") / F.col("t")))).otherwise(0))
    lines = lines.withColumn("drawn_long", F.sum(size * F.col("long_taken")).over(every))
    taken = F.when(F.col("long"), F.col("long_taken")).otherwise(within(F.greatest(F.lit(0), F.col("part") - F.col("drawn_long"))))
    out = lines.withColumn("repeats", (F.col("whole") + taken).cast("long")).where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")
    got = {r.source: r for r in out.groupBy("source").agg(F.count(F.lit(1)).alias("d"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("t"), F.max("repeats").alias("m")).collect()}
    drawn = sum(r.t for r in got.values())
    all_weight = sum(weight.values()) or 1.0
    report = [
        {
            "source": s,
            "target_share": weight[s] / all_weight,
            "share_of_available": live.get(s, 0.0) / norm if norm else 0.0,
            "tokens_available": int(total_of.get(s, 0)),
            "quota_tokens": int(quota.get(s, 0) * block),
            "documents": int(got[s].d) if s in got else 0,
            "tokens": int(got[s].t) if s in got else 0,
            "share": got[s].t / drawn if s in got else 0.0,
            "most_repeats": int(got[s].m) if s in got else 0,
            "max_repeats": int(cap[s]),
        }
        for s in sorted(weight)
    ]
    return Mixture(out, report)


REPORT_DDL = "source string, target_share double, share_of_available double, tokens_available long, quota_tokens long, documents long, tokens long, share double, most_repeats long, max_repeats long"


def report_frame(spark: SparkSession, report: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r.values()) for r in report], REPORT_DDL)
