"""Extractive summaries: sentence graph, weighted PageRank, query relevance, diverse selection."""

from __future__ import annotations

import re
from collections import Counter
from math import log, sqrt

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.lexicons import SUMMARY_STOPWORDS
from webloom.functions.text import summary_tokens, word_count

_STOP = frozenset(SUMMARY_STOPWORDS)
_BREAK = re.compile(r"[^\w']|_")
MOST_SENTENCES = 200


def tokens(text: str) -> list[str]:
    return [w for w in (x.lower() for x in _BREAK.split(text) if len(x.encode()) >= 2) if w not in _STOP]


def sentences(text: str | None) -> list[str]:
    """Sentences of three words or more; a short last word with one point is an abbreviation and ends none."""
    out, start = [], 0
    text = text or ""
    for m in re.finditer(r"[.!?]", text):
        part = text[start : m.end()].strip()
        ws = part.split()
        if ws and len(ws[-1].encode()) <= 4 and ws[-1].endswith(".") and ws[-1].count(".") == 1:
            continue
        if len(ws) >= 3:
            out.append(part)
            start = m.end()
    rest = text[start:].strip()
    if len(rest.split()) >= 3:
        out.append(rest)
    return out


def _cosine(a: dict, b: dict) -> float:
    if len(a) > len(b):
        a, b = b, a
    d = sum(v * b[k] for k, v in a.items() if k in b)
    n = sqrt(sum(v * v for v in a.values())) * sqrt(sum(v * v for v in b.values()))
    return d / n if n > 1e-10 else 0.0


def page_rank(edges: list[dict[int, float]], damping: float = 0.85, rounds: int = 30, tolerance: float = 1e-4) -> list[float]:
    n = len(edges)
    score = [1.0 / n] * n
    out = [sum(e.values()) for e in edges]
    for _ in range(rounds):
        new = [(1 - damping) / n + damping * sum(w * score[j] / out[j] for j, w in edges[i].items() if out[j] > 0) for i in range(n)]
        moved = max(abs(a - b) for a, b in zip(new, score, strict=True))
        score = new
        if moved < tolerance:
            break
    return score


def summarise(docs: list[tuple[str, str, str]], query: str, k: int = 5) -> list[tuple[str, float, str, str]]:
    """(sentence, score, url, title) of the k chosen sentences; docs: (body, url, title) in order."""
    split = [sentences(b) for b, _, _ in docs]
    df = Counter(w for s in split for w in {t for x in s for t in tokens(x)})
    every = [(s, u, t) for ss, (_, u, t) in zip(split, docs, strict=True) for s in ss if len(s.split()) >= 5 and len(s.encode()) >= 20][:MOST_SENTENCES]
    if not every:
        return []
    n_docs = max(1, len(docs))
    toks = [tokens(s) for s, _, _ in every]

    def vector(words: list[str]) -> dict[str, float]:
        total = max(1, len(words))
        return {w: c / total * (log(n_docs / df[w]) + 1 if w in df else 1.0) for w, c in Counter(words).items()}

    vec = [vector(t) for t in toks]
    edges: list[dict[int, float]] = [{} for _ in every]
    for i in range(len(every)):
        for j in range(i + 1, len(every)):
            s = _cosine(vec[i], vec[j])
            if s > 0.05:
                edges[i][j] = edges[j][i] = s
    rank = page_rank(edges)
    known = {w for t in toks for w in t}
    asked = vector(tokens(query))
    asked = {w: v for w, v in asked.items() if w in known}
    near = [_cosine(v, asked) for v in vec]
    top = lambda xs: [x / max(xs) if max(xs) > 0 else 0.0 for x in xs]
    rank, near = top(rank), top(near)
    sets = [set(t) for t in toks]
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    chosen, out = [], []
    for _ in range(min(k, len(every))):
        best, best_score = -1, float("-inf")
        for i in range(len(every)):
            if i in chosen:
                continue
            fact = 0.05 if re.search(r"[0-9]", every[i][0]) else 0.0
            s = 0.6 * near[i] + 0.4 * rank[i] + fact - 0.3 * max((like(sets[i], sets[j]) for j in chosen), default=0.0)
            if s > best_score:
                best, best_score = i, s
        chosen.append(best)
        out.append((every[best][0], best_score, every[best][1], every[best][2]))
    return out


def summaries(rows: DataFrame, scope: str, query: str, text: str, url: str, title: str, order: str, k: int = 5, most_docs: int = 50) -> DataFrame:
    """(scope, position, sentence, score, source_url, source_title) for each scope's first `most_docs` results."""
    w = Window.partitionBy(scope).orderBy(order)
    head = rows.select(scope, query, text, url, title, order).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most_docs)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__r")
        got = summarise(list(zip(pdf[text].fillna(""), pdf[url].fillna(""), pdf[title].fillna(""), strict=True)), pdf[query].iloc[0] or "", k)
        return pd.DataFrame({scope: [pdf[scope].iloc[0]] * len(got), "position": range(1, len(got) + 1), "sentence": [g[0] for g in got], "score": [round(g[1], 6) for g in got], "source_url": [g[2] for g in got], "source_title": [g[3] for g in got]})

    return head.groupBy(scope).applyInPandas(run, f"{scope} {dict(rows.dtypes)[scope]}, position int, sentence string, score double, source_url string, source_title string")


def tfidf(rows: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, term, tf, idf, w): weights of a corpus of sentences or documents, natively."""
    t = rows.select(F.col(doc).alias("doc"), summary_tokens(F.col(text)).alias("t")).where(F.size("t") > 0)
    n = t.select("doc").distinct().count()
    counts = t.select("doc", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("doc", "term").agg((F.count(F.lit(1)) / F.first("len")).alias("tf"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counts.join(df, "term").select("doc", "term", "tf", (F.log(F.lit(n) / F.col("df")) + 1).alias("idf")).withColumn("w", F.col("tf") * F.col("idf"))


def sentence_rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, pos, sentence): sentences of five words and 20 bytes or more, split at . ! ?"""
    parts = F.filter(F.transform(F.split(F.col(text), "(?<=[.!?])"), lambda x: F.trim(x)), lambda x: (word_count(x) >= 5) & (F.octet_length(x) >= 20))
    return docs.select(F.col(id_col).alias("id"), F.posexplode(parts).alias("pos", "sentence"))


def sentence_edges(weights: DataFrame, scope: DataFrame, least: float = 0.05) -> DataFrame:
    """(scope, a, b, similarity): cosine over shared terms within a scope, above `least`.

    weights: (doc, term, w) as from tfidf; scope: (doc, scope), at most MOST_SENTENCES sentences a scope as
    the summariser takes, so the pairs that meet on a term stay within that bound.
    """
    rows = weights.join(scope, "doc")
    norms = weights.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    a, b = rows.select("scope", "term", F.col("doc").alias("a"), F.col("w").alias("wa")), rows.select("scope", "term", F.col("doc").alias("b"), F.col("w").alias("wb"))
    dots = a.join(b, ["scope", "term"]).where(F.col("a") < F.col("b")).groupBy("scope", "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("d"))
    na, nb = norms.select(F.col("doc").alias("a"), F.col("n").alias("na")), norms.select(F.col("doc").alias("b"), F.col("n").alias("nb"))
    out = dots.join(na, "a").join(nb, "b").withColumn("similarity", F.col("d") / (F.col("na") * F.col("nb")))
    return out.where(F.col("similarity") > least).select("scope", "a", "b", "similarity")
