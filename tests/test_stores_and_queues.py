"""Caches, queues, budgets, retries, robots, paging and progress on literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from webloom.config import Config, Governor
from webloom.functions import text
from webloom.models import inferred
from webloom.operators import evaluation
from webloom.plans import crawl
from webloom.sources import extract, stores
from webloom.streaming import events as E


def test_write_behind(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "key string, value double, stored_at long")
    path = str(tmp_path / "embeddings")
    with pytest.raises(RuntimeError), stores.WriteBehind({"embeddings": (path, "key")}) as pending:
        pending.put("embeddings", make([("a", 1.0, 5), ("a", 2.0, 7), ("b", 3.0, 1)]))
        assert pending.commit() == {"embeddings": 1}
        pending.put("embeddings", make([("a", 4.0, 9), ("c", 5.0, 2)]))
        raise RuntimeError("the flush still happens")
    got = {r.key: r.value for r in stores.newest_entries(spark, path, "key").collect()}
    assert got == {"a": 4.0, "b": 3.0, "c": 5.0}
    assert {r.key for r in stores.newest_entries(spark, path, "key", cutoff=1).collect()} == {"a", "c"}


def test_flush_stream_and_progress(spark, tmp_path):
    log = E.ProgressLog()
    told = []
    log.subscribe(lambda what, detail: told.append(what))
    spark.streams.addListener(log)
    spark.createDataFrame([("a", 1), ("b", 2)], "key string, v long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, v long").parquet(str(tmp_path / "in"))
    q = stores.flush_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), None)
    assert q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    spark.streams.removeListener(log)
    assert all(isinstance(what, str) for what in told)


def test_query_cache(spark):
    old = spark.createDataFrame([(i, 3, 100 + i) for i in range(5)], "id long, results int, cached_at long")
    new = spark.createDataFrame([(3, 2, 200), (9, 0, 201), (10, 1, 202)], "id long, results int, cached_at long")
    got = stores.put_queries(old, new, now=203, ttl_seconds=101, cap=3)
    assert [r.id for r in got.orderBy(F.desc("cached_at")).collect()] == [10, 3, 4]
    counts = stores.hit_counts(spark.createDataFrame([(1,), (1,), (7,), (None,)], "id long"), old, "id").first()
    assert (counts.hits, counts.misses, counts.entries) == (2, 2, 5)


def test_queue(spark, tmp_path):
    jobs = spark.createDataFrame([(f"u{i}", i % 2, f"2025-01-01 00:00:{i:02d}", i % 3) for i in range(7)], "url string, priority int, queued_at string, errors int")
    stores.enqueue(jobs, str(tmp_path / "q"))
    stores.enqueue(jobs.limit(1), str(tmp_path / "q"))
    assert {r.priority: r.jobs for r in stores.queue_stats(spark, str(tmp_path / "q")).collect()} == {0: 5, 1: 3}
    ticks = {r.url: r.tick for r in E.queue_ticks(jobs, "priority", "queued_at", "url").collect()}
    assert ticks == {"u1": 0, "u3": 0, "u5": 0, "u0": 1, "u2": 1, "u4": 1, "u6": 2}
    back = {r.url: str(r.not_before) for r in E.requeued(jobs, "errors", "queued_at").collect()}
    assert back["u1"] == "2025-01-01 00:00:03" and back["u2"] == "2025-01-01 00:00:06" and "u0" not in back


def test_budgets_and_retries(spark):
    m = {r.a: (r.spent, r.remaining) for r in E.meter(spark.createDataFrame([("x", 3.0), ("x", 4.5), ("y", -2.0)], "a string, c double"), "a", "c", 5.0).collect()}
    assert m == {"x": (7.5, 0.0), "y": (0.0, 5.0)}
    assert E.retry_delays(4, 500) == [500, 1000, 2000, 4000] and E.retry_delays(0) == []
    rows = spark.createDataFrame([(None,), (200,), (404,), (429,), (503,)], "s int")
    assert [r.s for r in rows.where(E.retried(F.col("s"))).collect()] == [None, 429, 503]
    assert Governor(1, 5.0, -1, 0).clamped() == Governor(50, 0.999, 0, 1) and Config().crawl.time_limit_seconds == 120 and Config().governor.clamped() == Config().governor
    staged = E.staged({"partial": rows.limit(1), "refined": rows}, 0.0, 3.0, 4.0)
    assert staged.count() == 6 and staged.where("past_deadline").count() == 6 and {r.seq for r in staged.select("seq").distinct().collect()} == {0, 1}


def test_robots(spark):
    rules = spark.createDataFrame([("a.example", ["/x/open"], ["/x", ""], 2.0)], "host string, allowed_prefixes array<string>, denied_prefixes array<string>, crawl_delay double")
    urls = spark.createDataFrame([("https://a.example/x/open/1",), ("https://a.example/x/1",), ("https://a.example/y",), ("https://b.example/x",)], "url string")
    got = {r.url: (r.allowed, r.crawl_delay) for r in crawl.robots_allowed(urls, rules).collect()}
    assert got == {"https://a.example/x/open/1": (True, 2.0), "https://a.example/x/1": (False, 2.0), "https://a.example/y": (True, 2.0), "https://b.example/x": (True, None)}


def test_following_pages(spark):
    link = "array<struct<url:string,rel:string>>"
    rows = [("https://s/a", [("https://s/other", None), ("https://s/b", "next")]), ("https://s/b", [("https://s/c?page=2", "Next nofollow")]), ("https://s/c?page=2", []), ("https://s/c?page=3", None)]
    pages = spark.createDataFrame(rows, f"url string, links {link}")
    assert [r.url for r in crawl.follow_pages(pages, "https://s/a").orderBy("position").collect()] == ["https://s/a", "https://s/b", "https://s/c?page=2", "https://s/c?page=3"]
    assert crawl.follow_pages(pages, "https://s/a", 2).count() == 2 and crawl.follow_pages(pages, "https://s/none").count() == 0


def test_benchmark_helpers(spark):
    answers = spark.createDataFrame([(1, json.dumps({"results": [{"url": "https://a"}, {"url": None}, {"url": "https://b"}]})), (2, "no json"), (3, None)], "id long, j string")
    assert [(r.id, r["rank"], r.url) for r in evaluation.answers(answers, "id", "j").orderBy("rank").collect()] == [(1, 1, "https://a"), (1, 3, "https://b")]
    labels = spark.createDataFrame([(1, "https://a", 1), (2, "https://z", 1)], "query_id long, url string, grade int")
    ranked = spark.createDataFrame([(1, "https://a", 1)], "query_id long, url string, rank int")
    got = {r.query_id: (r.ndcg, r.precision) for r in evaluation.scored_runs(spark.createDataFrame([(1,), (2,), (3,)], "query_id long"), ranked, labels).collect()}
    assert got == {1: (1.0, 0.2), 2: (0.0, 0.0), 3: (0.0, 0.0)}
    m = evaluation.means(spark.createDataFrame([(1.0, 0.4), (0.5, 0.2)], "ndcg double, precision double")).first()
    assert (m.queries, m.mean_ndcg, round(m.mean_precision, 6)) == (2, 0.75, 0.3)
    assert [r.t for r in spark.createDataFrame([(" SPA",), ("",), (None,)], "x string").select(evaluation.tier_label(F.col("x")).alias("t")).collect()] == ["spa", "untiered", "untiered"]


def test_small_text_forms(spark):
    r = spark.sql("SELECT timestamp'2025-06-01 01:02:03.9' AS t, 'aé漢字' AS s").select(text.iso_time(F.col("t")).alias("i"), text.truncated(F.col("s"), 3).alias("c")).first()
    assert r.i == "2025-06-01T01:02:03Z" and r.c == "aé漢"


def test_data_layers_can_be_left_out():
    page = '<html><head><script type="application/ld+json">{"@type":"Article","articleBody":"%s"}</script></head><body><p>Short.</p></body></html>' % ("The whole text of the piece stands here. " * 20)
    assert extract.extract(page, "https://a.example/")["extractor"] == "structured" and "whole text" not in extract.extract(page, "https://a.example/", False)["body_text"]


def test_inference_in_batches(spark):
    class Judge:  # local, so that it travels by value
        labels = ["contradiction", "entailment", "neutral"]

        def logits(self, pairs):
            return [[3.0, 0.0, 0.0] if "not" in b else [0.0, 3.0, 0.0] if a == b else [0.1, 0.1, 0.2] for a, b in pairs]

    pairs = spark.createDataFrame([(1, "a b", "a b"), (2, "a b", "not a b"), (3, "a", None), (4, "a b", "a b")], "id long, a string, b string")
    got = {r.id: r.label for r in inferred(pairs, "a", "b", Judge()).collect()}
    assert got == {1: "entailment", 2: "contradiction", 4: "entailment"} and inferred(pairs, "a", "b", None).count() == 0
