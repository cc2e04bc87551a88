"""The kept text index, the three-level duplicate check, the ranking funnel and the tools over the smallest tables."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from webloom.operators import dedup, ranking, retrieval, text_index
from webloom.plans import tools

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    docs = [(1, "The red harbour", "a storm hit the harbour and the storm left"), (2, "Storm", "harbour and mill"), (3, None, "the mill is old"), (4, "", None)]
    text_index.append(spark.createDataFrame(docs[:2], "id long, title string, text string"), "id", ["title", "text"], path)
    text_index.append(spark.createDataFrame(docs[2:], "id long, title string, text string"), "id", ["title", "text"], path)
    return spark.createDataFrame(docs, "id long, title string, text string"), text_index.read(spark, path)


def ids(frame):
    return [r.doc for r in frame.orderBy("rank").collect()]


def test_index_equals_the_scan(spark, index):
    docs, kept = index
    q = spark.createDataFrame([(1, "storm harbour"), (2, "old"), (3, "nothing here"), (4, "")], "q long, t string")
    want = {(r.q, r.id): (r.score, r["rank"]) for r in retrieval.bm25(docs, q, "id", ["title", "text"], "q", "t").collect()}
    assert {(r.q, r.id): (r.score, r["rank"]) for r in kept.search_all(q, "q", "t", id_col="id").collect()} == want
    one = {r.doc: r.score for r in kept.search("storm harbour").collect()}
    assert one == {i: s for (k, i), (s, _) in want.items() if k == 1}


def test_query_parts(index):
    _, kept = index
    assert ids(kept.search("+storm +mill")) == [2] and ids(kept.search("harbour -storm")) == []
    assert ids(kept.search('"hit the harbour"')) == [1] and ids(kept.search('"harbour the"')) == [] and set(ids(kept.search('"the storm left" mill'))) == {1}
    assert ids(kept.search("title:storm")) == [2] and ids(kept.search("text:storm")) == [1] and ids(kept.search("mill -title:storm")) == [3]
    assert ids(kept.search("")) == [] == ids(kept.search("-storm")) == ids(kept.search("unknownword"))
    assert len(ids(kept.search("harbour", k=1))) == 1


def test_kept_index_is_built_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a storm")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    path = text_index.kept_for(spark, stored, "doc_id", ["text"], str(tmp_path))
    assert text_index.exists(spark, path) and text_index.kept_for(spark, stored, "doc_id", ["text"], str(tmp_path)) == path
    assert ids(text_index.read(spark, path).search("storm")) == [1]


@pytest.mark.parametrize("ttl", [0, 50])
def test_three_levels_as_in_order(spark, ttl):
    rng = random.Random(ttl)
    rows = [(i, rng.choice(["u1", "u2", "u3", "u4", None]), rng.randrange(0, 400), f"c{rng.randrange(12)}") for i in range(120)]
    fps = {f"c{k}": rng.choice([0, 7, 1 << 40, 0xFFFF << k, (0xFFFF << k) ^ 1]) for k in range(12)}
    df = spark.createDataFrame([(i, u, c, fps[c], t) for i, u, t, c in rows], "id long, url string, content string, fp long, s long").withColumn("at", F.timestamp_seconds("s"))
    got = {r.id: r.verdict for r in dedup.three_level(df, "id", "url", "at", "content", "fp", ttl).collect()}
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    events = pd.DataFrame([(f"null-{i}" if u is None else u, t, c, fps[c]) for i, u, t, c in order], columns=["url", "at", "content", "fp"])
    want = dict(zip([r[0] for r in order], dedup.register(events, ttl), strict=True))
    assert got == want and len(set(want.values())) == 4
    assert dedup.three_level(df.limit(0), "id", "url", "at", "content", "fp", ttl).count() == 0


def test_three_levels_of_one_hot_page(spark):
    df = spark.range(3000).select("id", F.lit("u").alias("url"), F.lit("c").alias("content"), F.lit(5).cast("long").alias("fp"), F.timestamp_seconds("id").alias("at"))
    got = dedup.three_level(df, "id", "url", "at", "content", "fp", 0).groupBy("verdict").count().collect()
    assert {r.verdict: r["count"] for r in got} == {"unique": 1, "url": 2999}


def test_funnel_stages(spark):
    text = "The council of the town met on Monday to talk about the storm and the harbour. The repair of the harbour wall costs 100 million pounds now."
    other = "A storm hit the harbour wall of the town on Sunday night again. The repair of the harbour wall costs 500 million pounds now."
    rows = [(1, i, f"https://s{i}.example/p", f"s{i}.example", f"Storm in the harbour {i}", text if i % 2 else other, None, 1 + i % 4, 5.0 - i, None, i + 1, None) for i in range(6)]
    rows += [(1, 90, "https://x.example/q", "x.example", "Other matters", "Nothing of it stands here at all.", None, 1, 9.0, None, 1, None), (9, 91, "https://y.example", "y.example", "t", "b", None, 1, 1.0, None, 1, None)]
    c = spark.createDataFrame(rows, "query_id long, cand_id long, url string, domain string, title string, body_text string, published_date timestamp, source_tier int, bm25_score double, vector_score double, bm25_rank long, vector_rank long")
    q = spark.createDataFrame([(1, "storm harbour repair"), (2, "no candidates")], "query_id long, query_text string")
    got = ranking.funnel(c, q, "2025-06-01 00:00:00").orderBy("position").collect()
    # near copies fall out, so one of each text stays
    assert len(got) == 2 and {r.verification for r in got} == {"Verified"} and all(r.contradictions >= 1 and r.coverage == 2.0 and r.total_pages == 6 for r in got)
    assert [r.position for r in got] == [1, 2] and ranking.funnel(c.limit(0), q, "2025-06-01 00:00:00").count() == 0
    hits = spark.createDataFrame([(1, "https://s1.example/p", 3.0, 7), (1, "https://s1.example/p", 2.0, 9)], "query_id long, url string, score double, rank int")
    ranked = {r.cand_id: (r.bm25_rank, r.vector_rank) for r in ranking.with_hybrid_ranks(c, hits, hits.limit(0)).collect()}
    assert ranked[1] == (7, None) and ranked[2] == (None, None) and len(ranked) == 8
    assert {r.cand_id for r in ranking.over_budget(c, "query_id", "cand_id", 2).collect()} == {0, 1, 91}


def test_index_first(spark):
    hits = spark.createDataFrame([(1, i, f"u{i}", f"t{i}", 2.0, i, "2025-05-31 20:00:00") for i in range(1, 4)] + [(2, 9, "u9", "t9", 2.0, 1, "2025-05-01 00:00:00")], "query_id long, doc_id long, url string, title string, score double, rank int, indexed_at string").withColumn("indexed_at", F.to_timestamp("indexed_at"))
    got = ranking.index_first(hits, 2, "2025-06-01 00:00:00").collect()
    assert [(r.query_id, r.place) for r in got] == [(1, 1), (1, 2)] and ranking.index_first(hits, 4, "2025-06-01 00:00:00").count() == 0


def test_every_tool_answers(spark):
    t = tools.Tools(spark, DIR)
    page = t.table("site_pages").where("size(links) > 0").orderBy("page_id").first().url
    fetched = t.table("crawled_pages").where("body like '%<p>%'").orderBy("fetch_id").first().url
    given = {"query": "storm harbour report", "topic": "climate budget", "claim": "the budget of the town", "urls": [fetched], "url": page, "text": "the storm in the harbour"}
    for name, tool in tools.TOOLS.items():
        args = {k: given[k] for k in tool.required} | ({"url": fetched} if name == "extract" else {})
        rows = t.call(name, args)
        assert rows.columns and tools.to_json(rows).count() == rows.count(), name
    deep = t.call("follow_links", {"url": page, "depth": 2})
    assert {r.depth for r in deep.select("depth").distinct().collect()} <= {1, 2} and deep.count() >= t.call("follow_links", {"url": page}).count()


def test_ingest_into_an_index(spark, tmp_path):
    from webloom.plans import ingest

    para = "<p>The council of the town met on Monday to talk about the storm and the harbour, and it asked the builders for a new plan before winter.</p>"
    page = lambda extra: f"<html><body><article><h1>Storm</h1>{para * 5}<p>{extra}</p></article></body></html>"
    other = "<html><body><article>" + "".join(f"<p>The mill number {i} of the valley was painted by its owner {i * 7} years ago, and its wheel still turns when the river is high.</p>" for i in range(6)) + "</article></body></html>"
    rows = [(1, "https://a.example/1", page("It is dear."), "text/html", 200, 0), (2, "https://a.example/1", page("It is dear."), "text/html", 200, 60), (3, "https://a.example/2", page("It is dear."), "text/html", 200, 90), (4, "https://a.example/3", other, "text/html", 200, 95), (5, "https://a.example/4", "{}", "image/png", 200, 99), (6, "https://a.example/5", None, "text/html", 200, 99)]
    fetches = spark.createDataFrame(rows, "fetch_id long, url string, body string, content_type string, status int, s long").withColumn("fetched_at", F.timestamp_seconds("s"))
    kept = ingest.ingest_into(fetches, str(tmp_path / "index"), str(tmp_path / "pages"))
    assert sorted(r.id for r in kept.collect()) == [1, 4]
    assert ids(text_index.read(spark, str(tmp_path / "index")).search("harbour storm")) == [1]
    ingest.ingest_into(fetches.where("fetch_id = 4").withColumn("fetch_id", F.lit(40).cast("long")), str(tmp_path / "index"), str(tmp_path / "pages"))
    assert set(ids(text_index.read(spark, str(tmp_path / "index")).search("mill"))) == {4, 40}


def test_staged_tables_can_be_dropped(spark):
    import os

    from webloom import session

    mark = session.staged_mark()
    df = session.stage_table(spark.range(5), "drop")
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 5 and os.path.exists(path)
    assert session.drop_staged(spark, mark) == 1 and not os.path.exists(path)
