"""Stateful pieces over event streams: time-to-live deduplication, domain governor, rates, queues, windows, progressive results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def unique_within(stream: DataFrame, key: str, at: str, ttl: str = "1 hour") -> DataFrame:
    """A stream without repeats of a key within a time to live, by event time; state is dropped behind the watermark."""
    return stream.withWatermark(at, ttl).dropDuplicatesWithinWatermark([key])


def ttl_unique(stream: DataFrame, key: str, at: str, ttl_seconds: int) -> DataFrame:
    """(key, at) of the visits that take a key up: the first, and each more than ttl_seconds after the last taken up.

    State a key: the second of its last take-up; it times out with the time to live.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = sorted(t for b in batches for t in b["s"])
        taken = []
        for t in times:
            if last is None or t - last > ttl_seconds:
                taken.append(t)
                last = t
        if last is not None:
            state.update((int(last),))
        yield pd.DataFrame({"key": [k[0]] * len(taken), "at_seconds": taken})

    rows = stream.select(F.col(key).cast("string").alias("key"), F.unix_timestamp(F.col(at).cast("timestamp")).alias("s"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, at_seconds long", "last long", "append", "NoTimeout")


# Limits of the domain governor.
PACE_LEAST, PACE_MOST, PACE_BASE = 50, 30_000, 500
HARD, SOFT = ("captcha", "banned"), ("soft_block", "js_challenge", "rate_limited", "waf_403")


class _Governor:
    """Pace, breaker and budget of one domain, an event at a time."""

    def __init__(self, budget: int = 1000, failures: int = 5, cooldown: float = 300.0, base: int = PACE_BASE) -> None:
        self.budget, self.failures, self.cooldown, self.base = budget, failures, cooldown, base
        self.delay, self.bad, self.opened, self.denied, self.used = base, 0, None, False, 0

    def step(self, at: float, kind: str) -> tuple[str, int, str]:
        if self.denied:
            return "denied", self.delay, "open"
        if self.used >= self.budget:
            return "over_budget", self.delay, "closed"
        if self.opened is not None and at - self.opened < self.cooldown:
            return "wait", self.delay, "open"
        half, self.opened = self.opened is not None, None
        self.used += 1
        if kind in HARD:
            self.denied = True
        elif kind in SOFT:
            self.delay, self.bad = min(PACE_MOST, self.delay * 2), self.bad + 1
            if self.bad >= self.failures or half:
                self.opened = at
        else:
            self.delay, self.bad = max(PACE_LEAST, self.delay - self.base // 4), 0
        return "admit", self.delay, "open" if self.opened is not None or self.denied else "closed"


def govern(events: list[tuple[float, str]], **options) -> list[tuple[str, int, str]]:
    """(admission, delay ms, breaker) of every event in order; events: (seconds, class).

    Real content shortens the delay by a quarter of the base, a soft signal doubles it, within limits. After
    `failures` soft signals in a row the breaker opens for `cooldown` seconds, then one attempt decides; a
    hard ban denies for good; the budget caps attempts.
    """
    state = _Governor(**options)
    return [state.step(at, kind) for at, kind in events]


def _walked(rows: DataFrame, key: str, new_state, step, out: dict[str, pa.DataType], ddl: str) -> DataFrame:
    """rows (key, tie, s, value) of each key in order of (s, tie), one row of `step` each; batches pass by with one state, so no key is held in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, own = None, object()
        for b in batches:
            got = []
            for k, s, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if k != own:
                    state, own = new_state(), k
                got.append(step(state, s, v))
            cols = list(zip(*got, strict=True)) if got else [[]] * len(out)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(cols, out.values(), strict=True)]], names=[key, "tie", *out])

    return rows.repartition(key).sortWithinPartitions(key, "s", "tie").mapInArrow(run, ddl)


def governed(events: DataFrame, domain: str, at: str, kind: str, tie: str, **options) -> DataFrame:
    """(domain, tie, admission, delay_ms, breaker): each domain's events replayed in order."""
    rows = events.select(F.col(domain).cast("string").alias("domain"), F.col(tie).cast("long").alias("tie"), F.unix_timestamp(F.col(at).cast("timestamp")).cast("double").alias("s"), F.col(kind).alias("kind"))
    out = {"admission": pa.string(), "delay_ms": pa.int32(), "breaker": pa.string()}
    return _walked(rows, "domain", lambda: _Governor(**options), lambda g, s, k: g.step(s, k), out, "domain string, tie long, admission string, delay_ms int, breaker string")


def governor_stream(stream: DataFrame, domain: str, at: str, kind: str, base: int = PACE_BASE, failures: int = 5) -> DataFrame:
    """(domain, events, delay_ms, failures): the pace of each domain after every micro-batch, kept in state."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, delay, bad = state.get if state.exists else (0, base, 0)
        for b in batches:
            for kind_of in b.sort_values("s")["kind"]:
                n += 1
                delay, bad = (min(PACE_MOST, delay * 2), bad + 1) if kind_of in SOFT else (max(PACE_LEAST, delay - base // 4), 0)
        state.update((int(n), int(delay), int(bad)))
        yield pd.DataFrame({"domain": [k[0]], "events": [n], "delay_ms": [delay], "failures": [bad]})

    rows = stream.select(F.col(domain).cast("string").alias("domain"), F.unix_timestamp(F.col(at).cast("timestamp")).alias("s"), F.col(kind).alias("kind"))
    return rows.groupBy("domain").applyInPandasWithState(step, "domain string, events long, delay_ms long, failures long", "n long, delay long, bad long", "update", "NoTimeout")


def verdict(kind: Column) -> Column:
    return F.when(kind.isin(*HARD), "permanent").when(kind.isin(*SOFT), "soft").otherwise("none")


def rate(events: DataFrame, key: str, at: str, seconds: int = 1) -> DataFrame:
    """events with in_window: how many of the key's events lie in the seconds up to each."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count(F.lit(1)).over(w))


def queue_order(jobs: DataFrame, priority: str, at: str, tie: str, most: int) -> DataFrame:
    """The next jobs: priority descending, then first come."""
    return jobs.orderBy(F.desc(priority), at, tie).limit(most)


def backoff_seconds(errors: Column) -> Column:
    return F.pow(F.lit(2), F.least(errors, F.lit(6))).cast("long")


def frontier(urls: DataFrame, domain: str, depth: str, arrival: str, per_domain: int = 50) -> DataFrame:
    """urls with priority 1 / (depth + 1) + authority + .2 / (n + 1), n = earlier URLs of the domain; at most per_domain of a domain."""
    from webloom.functions.lexicons import FRONTIER_BONUS

    n = F.row_number().over(Window.partitionBy(domain).orderBy(arrival)) - 1
    bonus = F.lit(0.0)
    for value, parts in reversed(FRONTIER_BONUS):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(F.lower(F.col(domain)), F.lit(p))
        bonus = F.when(hit, value).otherwise(bonus)
    return urls.withColumn("n", n).where(F.col("n") < per_domain).withColumn("priority", 1 / (F.col(depth) + 1) + bonus + 0.2 / (F.col("n") + 1)).drop("n")


def ledger(costs: DataFrame, account: str, at: str, tie: str, cost: str, cap: float) -> DataFrame:
    """costs with accepted and spent: a cost is reserved if it still fits under the cap; refunds are negative costs."""
    def step(spent: list[float], at: int, c: float) -> tuple[bool, float]:
        fits = c <= 0 or spent[0] + c <= cap + 1e-9
        spent[0] = max(0.0, spent[0] + c) if fits else spent[0]
        return fits, round(spent[0], 6)

    rows = costs.select(F.col(account).cast("string").alias("account"), F.col(tie).alias("tie"), F.unix_micros(F.col(at).cast("timestamp")).alias("s"), F.col(cost).cast("double").alias("cost"))
    kind = dict(costs.dtypes)[tie]
    return _walked(rows, "account", lambda: [0.0], step, {"accepted": pa.bool_(), "spent": pa.float64()}, f"account string, tie {kind}, accepted boolean, spent double")


def jitter(text: str) -> float:
    """A number in [0, 1) that depends on the text alone (64-bit FNV-1a)."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    return (h >> 11) / 2**53


def tumbling(events: DataFrame, at: str, width: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums of fixed windows; with a watermark on the input the same plan streams."""
    w = F.window(F.col(at), width)
    return events.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "events", "total")


def sessions(events: DataFrame, user: str, at: str, gap: str = "30 minutes") -> DataFrame:
    w = F.session_window(F.col(at), gap)
    return events.groupBy(user, w.alias("w")).agg(F.count(F.lit(1)).alias("events")).select(user, F.col("w.start").alias("session_start"), "events")


def progressive(partial: DataFrame, refined: DataFrame) -> DataFrame:
    """Early and final results in one frame, told apart by `stage`."""
    return partial.withColumn("stage", F.lit("partial")).unionByName(refined.withColumn("stage", F.lit("refined")), allowMissingColumns=True)


def queue_ticks(jobs: DataFrame, priority: str, at: str, tie: str, per_tick: int = 3, most: int = 1000) -> DataFrame:
    """jobs with `tick`: the first `most` by priority, then first come, are taken per_tick at a time."""
    first = queue_order(jobs, priority, at, tie, most)
    # at most `most` rows are left, which one task orders
    order = Window.orderBy(F.desc(priority), at, tie)
    return first.withColumn("tick", F.floor((F.row_number().over(order) - 1) / per_tick))


def requeued(jobs: DataFrame, errors: str, at: str, lowest: int = 0) -> DataFrame:
    """Failed jobs as they come back: not before 2^min(errors, 6) seconds, with the lowest priority."""
    seconds = backoff_seconds(F.col(errors))
    return jobs.where(F.col(errors) > 0).withColumns({"not_before": F.timestamp_seconds(F.unix_timestamp(F.col(at).cast("timestamp")) + seconds), "priority": F.lit(lowest)})


def retry_delays(attempts: int, backoff_ms: int = 500) -> list[int]:
    """Milliseconds before each retry: backoff * 2^(n - 1)."""
    return [backoff_ms * 2 ** (n - 1) for n in range(1, attempts + 1)]


def retried(status: Column) -> Column:
    """Whether a response is asked for again: server errors, no answer, and 429, but no other 4xx."""
    return status.isNull() | (status >= 500) | (status == 429)


def meter(costs: DataFrame, account: str, cost: str, cap: float) -> DataFrame:
    """(account, spent, remaining): what is left is never below 0."""
    spent = F.greatest(F.lit(0.0), F.sum(F.col(cost).cast("double")))
    return costs.groupBy(account).agg(F.round(spent, 6).alias("spent")).withColumn("remaining", F.greatest(F.lit(0.0), F.round(F.lit(cap) - F.col("spent"), 6)))


def staged(frames: dict[str, DataFrame], started: float, deadline_seconds: float, now: float) -> DataFrame:
    """Frames in the order given, each row with stage, seq and whether the deadline had passed when it was emitted."""
    out = None
    for seq, (stage, rows) in enumerate(frames.items()):
        one = rows.withColumns({"stage": F.lit(stage), "seq": F.lit(seq), "past_deadline": F.lit(now - started > deadline_seconds)})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


class ProgressLog(StreamingQueryListener):
    """Keeps the progress of running streams and passes it on to subscribers."""

    def __init__(self, most: int = 100) -> None:
        super().__init__()
        self.most, self.seen, self.subscribers = most, [], []

    def subscribe(self, call) -> None:
        self.subscribers.append(call)

    def _tell(self, what: str, detail: dict) -> None:
        self.seen = [*self.seen, (what, detail)][-self.most :]
        for call in self.subscribers:
            call(what, detail)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._tell("started", {"name": event.name})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self._tell("progress", {"batch": event.progress.batchId, "rows": event.progress.numInputRows})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._tell("idle", {})

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._tell("ended", {"error": event.exception})
