"""Stages of the ranking funnel over frames of (query_id, candidate, ...).

The wide candidate frame stays put; stages carry a narrow score and join text back only where a stage reads
it. The greedy stages run per query over at most the rows the funnel leaves (50, 30).
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.hashing import simhash_of
from webloom.functions.text import let, snippet
from webloom.operators import enrich, filters
from webloom.operators.retrieval import candidate_fusion
from webloom.session import stage_table

STAGE1, STAGE3 = 50, 30


def top(df: DataFrame, keys: list[str], score: str, tie: str, k: int, out: str = "rank") -> DataFrame:
    """The k best rows of a group, ties to the smaller `tie`; the limit is pushed below the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), tie)
    return df.withColumn(out, F.row_number().over(order)).where(F.col(out) <= k)


def fused(candidates: DataFrame, query: str = "query_id", tie: str = "cand_id", k: int = STAGE1) -> DataFrame:
    """Stage 1: fusion of ranks, the best k of a query."""
    s = candidate_fusion(F.col("bm25_rank"), F.col("vector_rank"), F.col("bm25_score"), F.col("vector_score"))
    return top(candidates.withColumn("score", F.round(s, 9)), [query], "score", tie, k)


def boosted(rows: DataFrame, query_text: str, domain: str, published: str, tier: str, as_of: str) -> DataFrame:
    """Stage 3: authority, freshness and primary-source multipliers on `score`."""
    kind = enrich.query_type(F.col(query_text))
    fresh = enrich.freshness(F.col(published), kind, as_of)
    s = enrich.boost(F.col("score"), enrich.authority(F.col(tier)), fresh, kind) * enrich.primary_source_boost(F.col(query_text), F.col(domain))
    return rows.withColumns({"query_type": kind, "score": s})


def anchored(score: Column, query: Column, title: Column, body: Column) -> Column:
    """Half the score where no query word of four bytes or more is in the title or the first 500 characters."""
    terms = F.filter(F.split(F.lower(query), r"\s+"), lambda w: F.octet_length(w) >= 4)
    head = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 500))
    t = F.lower(F.coalesce(title, F.lit("")))
    text = F.struct(t.alias("t"), head.alias("h"), terms.alias("w"))
    missing = let(text, lambda x: (F.size(x["w"]) > 0) & ~F.exists(x["w"], lambda w: F.contains(x["t"], w) | F.contains(x["h"], w)))
    return F.when(missing, score * 0.5).otherwise(score)


def floor_scores(rows: DataFrame, query: str, score: str, tie: str, least: float, top_k: int) -> DataFrame:
    """Rows of at least `least`, if top_k of a query reach it; else its top_k best. Queries of top_k rows or fewer stay."""
    w = Window.partitionBy(query)
    counted = rows.withColumns({"__n": F.count(F.lit(1)).over(w), "__ok": F.sum((F.col(score) >= least).cast("int")).over(w), "__r": F.row_number().over(w.orderBy(F.desc(score), tie))})
    keep = (F.col("__n") <= top_k) | ((F.col("__ok") >= top_k) & (F.col(score) >= least)) | ((F.col("__ok") < top_k) & (F.col("__r") <= top_k))
    return counted.where(keep).drop("__n", "__ok", "__r")


def instant(results: DataFrame, query: Column, title: Column, text: Column) -> Column:
    """Share of query terms (over two bytes) found in title and snippet."""
    terms = F.filter(F.split(F.lower(query), r"\s+"), lambda w: F.octet_length(w) > 2)
    doc = F.lower(F.concat_ws(" ", title, text))
    return let(F.struct(terms.alias("w"), doc.alias("d")), lambda x: F.size(F.filter(x["w"], lambda t: F.contains(x["d"], t))) / F.greatest(F.size(x["w"]), F.lit(1)))


def fast_confidence(bm25: Column) -> Column:
    """min(.1 * score, .95), .5 without a score."""
    return F.coalesce(F.least(bm25 * 0.1, F.lit(0.95)), F.lit(0.5))


def confidence(verification: Column, tier: Column) -> Column:
    base = F.when(verification == "Verified", 0.9).when(verification == "Partial", 0.7).when(verification == "Contested", 0.3).otherwise(0.5)
    step = F.when(tier == 1, 0.1).when(tier == 2, 0.05).when(tier == 3, 0.0).otherwise(-0.05)
    return F.greatest(F.lit(0.1), F.least(F.lit(0.99), base + step))


def _vector_similarity(a, b) -> float:
    if a is None or b is None or len(a) != len(b):
        return 0.0
    na, nb = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
    return sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb) if na * nb > 1e-10 else 0.0


def diverse(rows: Iterable[dict], per_domain: int = 2, bits: int = 3, balance: float = 0.7, k: int = 10) -> list[int]:
    """Indexes of the kept rows, in order: no near copy, at most per_domain of a host, no row too like the kept ones.

    rows: mappings with domain, score, body_hash, embedding (or None), best first. A row too like the kept
    ones is only passed over once three are kept. A missing score counts as 0.
    """
    kept: list[int] = []
    seen = list(rows)
    per: dict = {}
    for i, r in enumerate(seen):
        if len(kept) >= k:
            break
        h = r.get("body_hash")
        if h is not None and any(seen[j].get("body_hash") is not None and ((int(h) ^ int(seen[j]["body_hash"])) & (2**64 - 1)).bit_count() <= bits for j in kept):
            continue
        if per.get(r.get("domain"), 0) >= per_domain:
            continue
        if len(kept) >= 3 and r.get("embedding") is not None:
            like = max((_vector_similarity(r["embedding"], seen[j].get("embedding")) for j in kept), default=0.0)
            score = r.get("score")
            score = 0.0 if score is None or score != score else score
            if balance * score - (1 - balance) * max(0.0, like) < 0:
                continue
        kept.append(i)
        per[r.get("domain")] = per.get(r.get("domain"), 0) + 1
    return kept


def diversified(rows: DataFrame, query: str, row: str, k: int = 10, funnel: int = STAGE3, **options) -> DataFrame:
    """(query, row, position): the greedy selection over each query's best `funnel` rows."""
    narrow = top(rows.select(query, row, "domain", F.when(~F.isnan("score"), F.col("score")).alias("score"), "body_hash", "embedding"), [query], "score", row, funnel)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        recs = [{n: (None if isinstance(v, float) and v != v else v) for n, v in r.items()} for r in pdf.to_dict("records")]
        kept = diverse(recs, k=k, **options)
        return pd.DataFrame({query: [recs[i][query] for i in kept], row: [recs[i][row] for i in kept], "position": range(1, len(kept) + 1)})

    types = dict(rows.dtypes)
    return narrow.groupBy(query).applyInPandas(pick, f"{query} {types[query]}, {row} {types[row]}, position int")


def marginal_relevance(relevance: list[float], similarity, balance: float, k: int) -> list[int]:
    """Greedy selection by balance * relevance - (1 - balance) * greatest similarity to the chosen; ties to the first."""
    left, chosen = list(range(len(relevance))), []
    while left and len(chosen) < k:
        best = max(left, key=lambda i: (balance * relevance[i] - (1 - balance) * max((similarity(i, j) for j in chosen), default=0.0), -i))
        chosen.append(best)
        left.remove(best)
    return chosen


def subtopic_order(texts: list[str], scores: list[float], query: str) -> list[int]:
    """Order that favours new content bigrams: score * (1 + .1 * unseen bigrams), greedily; two rows or fewer stay."""
    import re

    if len(texts) <= 2:
        return list(range(len(texts)))
    asked = set(query.lower().split())
    topics = []
    for t in texts:
        w = [x for x in re.split(r"[^\w]|_", t.lower()) if len(x.encode()) >= 3 and x not in asked]
        topics.append(set(zip(w, w[1:], strict=False)))
    left, seen, order = list(range(len(texts))), set(), []
    while left:
        best = max(left, key=lambda i: (scores[i] * (1 + 0.1 * len(topics[i] - seen)), -i))
        left.remove(best)
        seen |= topics[best]
        order.append(best)
    return order


def reordered(rows: DataFrame, query: str, query_text: str, row: str, text: str, score: str, k: int = STAGE3) -> DataFrame:
    """(query, row, position): subtopic order of each query's best k rows."""
    narrow = top(rows.select(query, query_text, row, text, score), [query], score, row, k)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        order = subtopic_order(pdf[text].fillna("").tolist(), pdf[score].fillna(0.0).tolist(), pdf[query_text].iloc[0] or "")
        return pd.DataFrame({query: pdf[query].iloc[order].tolist(), row: pdf[row].iloc[order].tolist(), "position": range(1, len(order) + 1)})

    types = dict(rows.dtypes)
    return narrow.groupBy(query).applyInPandas(run, f"{query} {types[query]}, {row} {types[row]}, position int")


MIN_SCORE, MIN_ORGS = 0.35, 3


def boosted_stage(candidates: DataFrame, queries: DataFrame, as_of: str, k: int = 10, least: float = MIN_SCORE) -> DataFrame:
    """Stages 0 to 3 of the funnel: gate, fusion, score floor, boosts, the best 30, anchor penalty; columns of the candidates with query_text, query_type, score, rank.

    candidates: query_id, cand_id, url, domain, title, body_text, published_date, source_tier, scores and
    ranks. queries: query_id, query_text. Candidates of unknown queries are left out.
    """
    asked = candidates.join(queries.select("query_id", "query_text"), "query_id")
    gated = asked.where(filters.relevant(F.col("query_text"), F.col("title"), F.col("body_text")))
    gated = gated.withColumn("total_pages", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    floored = floor_scores(fused(gated).drop("rank"), "query_id", "score", "cand_id", least, k)
    stage3 = top(boosted(floored, "query_text", "domain", "published_date", "source_tier", as_of), ["query_id"], "score", "cand_id", STAGE3)
    final = stage3.withColumn("score", F.round(anchored(F.col("score"), F.col("query_text"), F.col("title"), F.col("body_text")), 9)).drop("rank")
    return top(final, ["query_id"], "score", "cand_id", STAGE3)


def checked_stage(stage3: DataFrame, fuzzy: bool = True, min_orgs: int = MIN_ORGS) -> tuple[DataFrame, DataFrame]:
    """Stage 4: (query_id, url, verification, claims, contradictions) of every URL with any, and (query_id, unique_orgs, coverage, echo_risk) of every query."""
    from webloom.operators import verification as V

    said = V.phrases(stage3, "query_id", "url", "body_text", "rank")
    claims = V.claims(said, fuzzy).groupBy("scope", F.col("source_url").alias("url")).agg(F.count(F.lit(1)).alias("claims"), F.max((F.col("verification") == "Verified").cast("int")).alias("sure"))
    against = V.numeric_contradictions(V.number_claims(said))
    sides = against.select("scope", F.explode(F.array_distinct(F.array("source_a", "source_b"))).alias("url")).groupBy("scope", "url").agg(F.count(F.lit(1)).alias("contradictions"))
    both = claims.join(sides, ["scope", "url"], "full_outer")
    status = F.when(F.col("sure") == 1, "Verified").when(F.col("claims") > 0, "Partial").when(F.col("contradictions") > 0, "Contested").otherwise("Unverified")
    per_url = both.select(F.col("scope").alias("query_id"), "url", status.alias("verification"), F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("contradictions", F.lit(0)).alias("contradictions"))
    echo = V.echo_chamber(stage3, "query_id", "url", min_orgs)
    return per_url, echo.select(F.col("scope").alias("query_id"), F.col("orgs").alias("unique_orgs"), (F.col("orgs") / min_orgs).alias("coverage"), "echo_risk")


def chosen(stage3: DataFrame, k: int = 10) -> DataFrame:
    """Stages 5 and 6: (query_id, cand_id, position): the diverse selection of each query's at most 30 rows, reordered by new subtopics."""
    narrow = stage3.select("query_id", "cand_id", "query_text", "rank", "domain", "score", "body_text", "embedding")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [{n: (None if isinstance(v, float) and v != v else v) for n, v in r.items()} for r in pdf.sort_values("rank").to_dict("records")]
        for r in rows:
            r["body_hash"] = simhash_of(r["body_text"])
        kept = diverse(rows, k=k)
        order = subtopic_order([rows[i]["body_text"] or "" for i in kept], [rows[i]["score"] or 0.0 for i in kept], rows[0]["query_text"] or "")
        return pd.DataFrame({"query_id": [rows[i]["query_id"] for i in kept], "cand_id": [rows[kept[j]]["cand_id"] for j in order], "position": range(1, len(kept) + 1)})

    types = dict(stage3.dtypes)
    return narrow.groupBy("query_id").applyInPandas(pick, f"query_id {types['query_id']}, cand_id {types['cand_id']}, position int")


def funnel(candidates: DataFrame, queries: DataFrame, as_of: str, k: int = 10, rerank=None) -> DataFrame:
    """The whole ranking: gate, fusion, floor, boosts, anchor penalty, cross-document checks, diversity, subtopics, result assembly.

    rerank: a function of the fused rows that replaces their score (a model); none by default. Stages 4 to 6 see at
    most 30 rows a query. A row without an own embedding counts as unlike all others.
    """
    if "embedding" not in candidates.columns:
        candidates = candidates.withColumn("embedding", F.lit(None).cast("array<float>"))
    stage3 = boosted_stage(candidates, queries, as_of, k)
    # at most 30 rows a query, which four plans read
    stage3 = stage_table(stage3 if rerank is None else rerank(stage3), "funnel")
    per_url, per_query = checked_stage(stage3)
    best = stage3.join(chosen(stage3, k), ["query_id", "cand_id"]).join(per_url, ["query_id", "url"], "left").join(per_query, "query_id")
    status = F.coalesce("verification", F.lit("Unverified"))
    return best.select(
        "query_id", "cand_id", "position", "url", "title", "query_type", "source_tier", F.round("score", 6).alias("score"), status.alias("verification"),
        F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("contradictions", F.lit(0)).alias("contradictions"), F.round(confidence(status, F.col("source_tier")), 2).alias("confidence"),
        F.round("coverage", 6).alias("coverage"), "echo_risk", "total_pages", F.col("published_date").alias("freshness"), snippet(F.col("body_text"), F.col("query_text"), 1500).alias("content"),
    )


def with_hybrid_ranks(candidates: DataFrame, text_hits: DataFrame, vector_hits: DataFrame, query: str = "query_id", url: str = "url") -> DataFrame:
    """candidates with bm25_rank, bm25_score, vector_rank, vector_score from two result lists (query, url, score, rank) over all documents.

    Ranks are those of the whole lists, so candidates may have gaps; what neither list holds stays without ranks, and
    a URL that comes twice in a list counts at its best place.
    """
    side = lambda hits, name: hits.groupBy(query, url).agg(F.min("rank").alias(f"{name}_rank"), F.max("score").alias(f"{name}_score"))
    bare = candidates.drop("bm25_rank", "bm25_score", "vector_rank", "vector_score")
    return bare.join(side(text_hits, "bm25"), [query, url], "left").join(side(vector_hits, "vector"), [query, url], "left")


def over_budget(candidates: DataFrame, query: str, tie: str, k: int) -> DataFrame:
    """What is answered when the time is over: the first k of a query as they came, confidence .5, coverage .3."""
    first = candidates.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(tie))).where(F.col("rank") <= k)
    return first.withColumns({"confidence": F.lit(0.5), "verification": F.lit("Unverified"), "coverage": F.lit(0.3)})


def index_first(hits: DataFrame, k: int, as_of: str, hours: int = 24, least: float = 0.5) -> DataFrame:
    """(query_id, ...): the answers of queries of which the index alone holds k fresh ones; other queries have no rows.

    hits: query_id, doc_id, url, title, score, rank, indexed_at. Fresh: younger than `hours` at as_of, a score above `least`.
    """
    age = F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp("indexed_at")
    fresh = hits.where((age < hours * 3600) & (F.col("score") > least))
    w = Window.partitionBy("query_id")
    counted = fresh.withColumns({"n": F.count(F.lit(1)).over(w), "place": F.row_number().over(w.orderBy("rank"))})
    return counted.where((F.col("n") >= k) & (F.col("place") <= k)).select(
        "query_id", "place", "doc_id", "url", "title", F.col("title").alias("content"), "score", F.lit(0.7).alias("confidence"), F.lit("Partial").alias("verification"), F.lit(0.7).alias("coverage")
    )
