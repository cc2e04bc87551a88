"""The fifteen tool functions over a folder's tables, each giving a DataFrame; to_json makes responses.

Nothing here fetches from a network: pages are the table site_pages, candidates rank_candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.functions.text import index_tokens, snippet
from webloom.operators import enrich, entities, ranking, retrieval, synthesis, text_index, verification
from webloom.plans import crawl as C
from webloom.session import shared_dir, stage_table
from webloom.sources import extract
from webloom.streaming.events import progressive
from webloom.tables import load

AS_OF = "2025-06-01 00:00:00"


@dataclass(frozen=True)
class Tool:
    name: str
    text: str
    required: dict[str, type]
    optional: dict[str, object]

    def bind(self, given: dict) -> dict:
        """Checked arguments with defaults; unknown names are refused."""
        out = dict(self.optional)
        for name, kind in self.required.items():
            if not isinstance(given.get(name), kind) or given[name] in ("", []):
                raise ValueError(f"{self.name}: {name} must be a non-empty {kind.__name__}")
        for name, value in given.items():
            if name not in self.required and name not in self.optional:
                raise ValueError(f"{self.name}: unknown argument {name}")
            if name in self.optional and isinstance(self.optional[name], int) and (not isinstance(value, int) or value < 1):
                raise ValueError(f"{self.name}: {name} must be a positive whole number")
            out[name] = value
        return out

    def schema(self) -> dict:
        kinds = {str: "string", int: "integer", list: "array"}
        props = {n: {"type": kinds[k]} for n, k in self.required.items()} | {n: {"type": kinds.get(type(v), "string"), "default": v} for n, v in self.optional.items()}
        return {"name": self.name, "description": self.text, "inputSchema": {"type": "object", "properties": props, "required": list(self.required)}}


TOOLS = {
    t.name: t
    for t in (
        Tool("instant_search", "Rank snippets by query terms, no crawl", {"query": str}, {"max_results": 5}),
        Tool("quick_search", "Index search ranked by text score", {"query": str}, {"max_results": 10}),
        Tool("streaming_search", "Early results, then the ranked ones", {"query": str}, {"max_results": 10}),
        Tool("deep_research", "Query variants, two waves, full ranking", {"query": str}, {"max_pages": 500, "depth": 3, "time_limit": 120}),
        Tool("explore_topic", "Broad research on a topic", {"topic": str}, {"breadth": 3}),
        Tool("verify_claim", "Independent sources for a claim", {"claim": str}, {"min_sources": 5}),
        Tool("compare_sources", "Extract several pages side by side", {"urls": list}, {"aspect": ""}),
        Tool("fetch_page", "A page with a preview", {"url": str}, {}),
        Tool("extract", "Structured extraction of a page", {"url": str}, {}),
        Tool("follow_links", "Links of a page that match a pattern", {"url": str}, {"pattern": "", "depth": 1}),
        Tool("paginate", "The pages after a page", {"url": str}, {"max_pages": 10}),
        Tool("search_index", "Documents of the index with their age", {"query": str}, {"max_results": 20}),
        Tool("find_similar", "Documents similar to a text", {"text": str}, {"top_k": 10}),
        Tool("get_entities", "Entities of a text", {"text": str}, {}),
        Tool("get_link_graph", "Outgoing and incoming links of a page", {"url": str}, {"depth": 1}),
    )
}


PAGES_A_SECOND = 8


class Tools:
    """The tools over the tables of a folder. Searches use the kept text index of the documents, built at the first of them."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> None:
        self.spark, self.dir, self.as_of = spark, sf_dir, as_of
        self._index: text_index.TextIndex | None = None

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.dir, name)

    def call(self, name: str, given: dict) -> DataFrame:
        return getattr(self, name)(**TOOLS[name].bind(given))

    def index(self) -> text_index.TextIndex:
        if self._index is None:
            self._index = text_index.read_kept(self.spark, text_index.kept_for(self.spark, self.table("documents"), "doc_id", ["title", "text"], shared_dir(self.spark)))
        return self._index

    def _with_texts(self, hits: DataFrame) -> DataFrame:
        """hits (doc, score, rank, at most a few hundred) with their documents; ranks stay as they are."""
        docs = self.table("documents").withColumnRenamed("doc_id", "doc")
        return hits.join(docs, "doc").select(F.col("doc").alias("doc_id"), "url", "title", "domain", "text", "crawled_at", "score", "rank")

    def _search(self, query: str, k: int) -> DataFrame:
        return self._with_texts(self.index().search(query, k=k))

    def _answers(self, hits: DataFrame, query: str) -> DataFrame:
        return hits.select(
            "rank", "url", "title", snippet(F.col("text"), F.lit(query), 1500).alias("content"), "score", F.round(ranking.fast_confidence(F.col("score")), 4).alias("confidence"), F.lit("Unverified").alias("verification"),
        )

    def instant_search(self, query: str, max_results: int = 5) -> DataFrame:
        """Of the index's best hits those with most query terms in title and text."""
        c = self._search(query, 10 * max_results)
        s = c.withColumn("score", ranking.instant(c, F.lit(query), F.col("title"), F.col("text")))
        return s.where("score > 0").orderBy(F.desc("score"), "rank").limit(max_results).select("url", "title", snippet(F.col("text"), F.lit(query), 300).alias("content"), F.round("score", 6).alias("score"))

    def quick_search(self, query: str, max_results: int = 10) -> DataFrame:
        return self._answers(self._search(query, max_results), query)

    def streaming_search(self, query: str, max_results: int = 10) -> DataFrame:
        early = self.instant_search(query, min(5, max_results))
        return progressive(early, self.quick_search(query, max_results))

    def _research(self, queries: list[str], max_pages: int, depth: int, time_limit: int) -> DataFrame:
        """The ten best of each query through the whole funnel, queries numbered from 0.

        Seeds are the index's hits of every form of a query; the links of the first query's seeds are followed to
        `depth` over the page table, as many pages as max_pages and the time limit (PAGES_A_SECOND) allow. What the
        index holds is ranked by it, the pages reached come without ranks.
        """
        asked = self.spark.createDataFrame(list(enumerate(queries)), "id long, q string")
        forms = enrich.reformulated(asked, "id", "q", int(self.as_of[:4])).select((F.col("id") * 100 + F.col("position")).cast("long").alias("form"), F.col("variant").alias("query_text"))
        budget = max(1, min(max_pages, PAGES_A_SECOND * time_limit))
        hits = self.index().search_all(forms, "form", "query_text", k=max(1, budget // 6), id_col="doc")
        best = hits.groupBy(F.floor(F.col("form") / 100).alias("query_id"), "doc").agg(F.max("score").alias("bm25_score"))
        place = Window.partitionBy("query_id").orderBy(F.desc("bm25_score"), "doc")
        first = best.withColumn("bm25_rank", F.row_number().over(place).cast("long")).where(F.col("bm25_rank") <= budget)
        docs = self.table("documents").select(F.col("doc_id").alias("doc"), "url", "title", F.col("text").alias("body_text"), F.col("crawled_at").alias("published_date"), "domain")
        rows = first.join(docs, "doc").select("query_id", "url", "title", "body_text", "published_date", "domain", "bm25_score", "bm25_rank")
        if depth > 1:
            rows = stage_table(rows, "research-seeds")
            mine = rows.where("query_id = 0").select("url")
            pages = self.table("site_pages").select("url", "links", "title", "body_text", "published_date", "domain", "crawled_at")
            reached = C.crawl(pages, mine, depth - 1, budget).select("url").distinct().join(mine, "url", "left_anti")
            newest = pages.join(reached, "url", "left_semi").groupBy("url").agg(*[F.max_by(c, "crawled_at").alias(c) for c in ("title", "body_text", "published_date", "domain")])
            rows = rows.unionByName(newest.withColumn("query_id", F.lit(0).cast("long")), allowMissingColumns=True)
        key = F.xxhash64("query_id", "url", "title", "body_text")
        rows = rows.withColumns({"cand_id": key, "vector_rank": F.lit(None).cast("long"), "vector_score": F.lit(None).cast("double")}).dropDuplicates(["cand_id"])
        rows = enrich.with_tier(rows, "domain", enrich.tier_table(self.spark))
        return ranking.funnel(rows, asked.select(F.col("id").alias("query_id"), F.col("q").alias("query_text")), self.as_of).drop("cand_id")

    def deep_research(self, query: str, max_pages: int = 500, depth: int = 3, time_limit: int = 120) -> DataFrame:
        """The ten best of a search in several wordings and of the pages its results lead to."""
        return self._research([query], max_pages, depth, time_limit).drop("query_id")

    def explore_topic(self, topic: str, breadth: int = 3) -> DataFrame:
        """Research on a topic and on the `breadth` words that most of its best documents share."""
        best = self._search(topic, 20)
        said = best.select(F.explode(F.array_distinct(F.filter(index_tokens(F.col("text")), lambda w: F.length(w) >= 6))).alias("w")).where(~F.contains(F.lit(topic.lower()), F.col("w")))
        aspects = [topic, *(r.w for r in said.groupBy("w").count().orderBy(F.desc("count"), "w").limit(breadth).collect())]
        found = self._research([topic, *(f"{topic} {w}" for w in aspects[1:])], 200, 2, 60)
        named = found.withColumn("aspect", F.element_at(F.array(*map(F.lit, aspects)), (F.col("query_id") + 1).cast("int")))
        w = Window.partitionBy("url").orderBy(F.desc("score"), "query_id", "position")
        return named.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "query_id")

    def verify_claim(self, claim: str, min_sources: int = 5) -> DataFrame:
        hits = self._search(claim, 2 * min_sources)
        sources = F.size(F.collect_set(urls.organisation(urls.host(F.col("url")))).over(Window.partitionBy()))
        told = hits.withColumn("sources", sources)
        return told.select(
            "rank", "url", "title", snippet(F.col("text"), F.lit(claim), 1500).alias("content"), "score", "sources", F.when(F.col("sources") >= min_sources, "Verified").otherwise("Insufficient").alias("status")
        )

    def compare_sources(self, urls: list[str], aspect: str = "") -> DataFrame:
        pages = self.table("crawled_pages").where(F.col("url").isin(urls))
        got = extract.extracted(pages, "fetch_id", "body", "url")
        return got.select("url", "title", "published", "author", "confidence", F.length("body_text").alias("chars"), snippet(F.col("body_text"), F.lit(aspect), 500).alias("on_aspect"), F.lit(aspect).alias("aspect"))

    def fetch_page(self, url: str) -> DataFrame:
        return self.table("site_pages").where(F.col("url") == url).select("url", "title", F.substring("body_text", 1, 2000).alias("preview"), F.col("metadata.status_code").alias("status"))

    def extract(self, url: str) -> DataFrame:
        return extract.extracted(self.table("crawled_pages").where(F.col("url") == url), "fetch_id", "body", "url")

    def _edges(self) -> DataFrame:
        return self.table("site_pages").select(F.col("url").alias("src"), F.posexplode("links").alias("place", "l")).select("src", "place", F.col("l.url").alias("dst"), F.col("l.anchor_text").alias("anchor_text"), F.col("l.is_external").alias("is_external"))

    def follow_links(self, url: str, pattern: str = "", depth: int = 1) -> DataFrame:
        """The first 50 links that match, nearest first: of the page, then of the pages they lead to, to the depth asked for."""
        edges = self._edges()
        hit = F.contains("dst", F.lit(pattern)) | F.contains(F.lower("anchor_text"), F.lit(pattern.lower()))
        level, out = self.spark.createDataFrame([(url,)], "src string"), None
        for d in range(1, depth + 1):
            now = edges.where(hit).join(level, "src", "left_semi").groupBy("dst").agg(F.min("place").alias("place"), F.min_by("anchor_text", F.struct("src", "place")).alias("anchor_text"), F.min("is_external").alias("is_external")).withColumn("depth", F.lit(d))
            now = now if out is None else now.join(out.select("dst"), "dst", "left_anti")
            now = now.orderBy("place", "dst").limit(50)
            out = now if out is None else out.unionByName(now)
            level = now.select(F.col("dst").alias("src"))
        return out.orderBy("depth", "place", "dst").limit(50).select("depth", F.col("place").alias("position"), F.col("dst").alias("url"), "anchor_text", "is_external")

    def paginate(self, url: str, max_pages: int = 10) -> DataFrame:
        return C.paginate(self.table("site_pages"), url, max_pages).select("position", "url", "title", F.substring("body_text", 1, 500).alias("preview"))

    def search_index(self, query: str, max_results: int = 20) -> DataFrame:
        age = F.floor((F.unix_timestamp(F.to_timestamp(F.lit(self.as_of))) - F.unix_timestamp("crawled_at")) / 3600)
        return self._search(query, max_results).select("rank", "url", "title", "domain", "score", age.alias("age_hours"), (age > 24).alias("stale"))

    def vectors(self) -> DataFrame:
        """Feature-hash embeddings of the documents, computed once and kept beside the index."""
        docs = self.table("documents")
        return text_index.kept_table(self.spark, docs, "vectors", shared_dir(self.spark), lambda: retrieval.hash_embedding(docs, "doc_id", "text", 64))

    def find_similar(self, text: str, top_k: int = 10) -> DataFrame:
        one = self.spark.createDataFrame([(0, text)], "doc_id long, text string")
        vec = retrieval.hash_embedding(one, "doc_id", "text", 64).first()["embedding"]
        near = retrieval.nearest(self.vectors(), [(0, list(vec))], "doc_id", "embedding", top_k)
        return near.join(self.table("documents").select("doc_id", "url"), "doc_id").select("rank", "doc_id", "url", F.round("similarity", 6).alias("similarity"))

    def get_entities(self, text: str) -> DataFrame:
        return entities.entities(self.spark.createDataFrame([(0, text)], "id long, text string"), "id", "text").select("name", "type")

    def get_link_graph(self, url: str, depth: int = 1) -> DataFrame:
        """Links out of and into a page, and on to the depth asked for; at most 100 a direction and depth."""
        e = self._edges().select("src", "dst", "anchor_text", "is_external").distinct()
        out = None
        for direction, here, there in (("out", "src", "dst"), ("in", "dst", "src")):
            level, seen = self.spark.createDataFrame([(url,)], f"{here} string"), None
            for d in range(1, depth + 1):
                now = e.join(level, here, "left_semi").orderBy(here, there, "anchor_text").limit(100).select("src", "dst", "anchor_text", "is_external", F.lit(direction).alias("direction"), F.lit(d).alias("depth"))
                out = now if out is None else out.unionByName(now)
                before = level.select(F.col(here).alias("n"))
                seen = before if seen is None else seen.unionByName(before)
                level = now.select(F.col(there).alias("n")).distinct().join(seen, "n", "left_anti").select(F.col("n").alias(here))
        return out

    def summarise(self, query: str, k: int = 5) -> DataFrame:
        """The best sentences of a quick search's results."""
        r = self.quick_search(query).withColumns({"scope": F.lit(0).cast("long"), "q": F.lit(query)})
        return synthesis.summaries(r, "scope", "q", "content", "url", "title", "rank", k)

    def checked(self, query: str) -> DataFrame:
        """Claims of a search's results with the organisations behind them."""
        hits = self._search(query, 20).withColumn("scope", F.lit(0).cast("long"))
        return verification.claims(verification.phrases(hits, "scope", "url", "text", "rank"))


def to_json(rows: DataFrame) -> DataFrame:
    """(value): one JSON object a row."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def cached_answer(spark: SparkSession, cache: DataFrame, vector: list[float], now: str, least: float = 0.92, ttl_seconds: int = 14_400) -> DataFrame:
    """The unexpired cached query most similar to a vector, if similar enough. cache: id, embedding, cached_at."""
    live = cache.where(F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp("cached_at") <= ttl_seconds)
    return retrieval.nearest(live, [(0, vector)], "id", "embedding", 1).where(F.col("similarity") > least)
