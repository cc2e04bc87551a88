"""Places for models. None is needed: without one its stage is skipped, embeddings fall back to feature hashes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators.ranking import top


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class NliModel(Protocol):
    labels: list[str]

    def logits(self, pairs: list[tuple[str, str]]) -> list[list[float]]: ...


def embedded(rows: DataFrame, id_col: str, text_col: str, model: Embedder) -> DataFrame:
    """(id, embedding) by a model, in Arrow batches; the model travels once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = model.embed([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.list_(pa.float32()))], names=["id", "embedding"])

    return rows.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, embedding array<float>")


def reranked(rows: DataFrame, query_id: str, query_text: str, row: str, text: str, model: Reranker | None, prefix: int = 256, k: int = 50, cache: DataFrame | None = None) -> DataFrame:
    """rows with `score` = .3 * score + .7 * model; the best k of a query. Without a model rows pass unchanged.

    cache: (query_hash, doc_hash, model_score); only pairs it lacks are scored, each text cut to `prefix`
    characters as such models read no more.
    """
    if model is None:
        return rows
    head = F.substring(F.coalesce(F.col(text), F.lit("")), 1, prefix)
    keyed = rows.withColumns({"query_hash": F.xxhash64(query_text), "doc_hash": F.xxhash64(head), "__t": head})
    pairs = keyed.select("query_hash", "doc_hash", query_text, "__t").dropDuplicates(["query_hash", "doc_hash"])
    if cache is not None:
        pairs = pairs.join(cache, ["query_hash", "doc_hash"], "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, t = b.column(2).to_pylist(), b.column(3).to_pylist()
            by: dict[str, list[int]] = {}
            for i, x in enumerate(q):
                by.setdefault(x or "", []).append(i)
            s = [0.0] * len(q)
            for x, at in by.items():
                for i, v in zip(at, model.score(x, [t[i] or "" for i in at]), strict=True):
                    s[i] = float(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=["query_hash", "doc_hash", "model_score"])

    scores = pairs.mapInArrow(run, "query_hash long, doc_hash long, model_score double")
    if cache is not None:
        scores = scores.unionByName(cache.select("query_hash", "doc_hash", "model_score"))
    both = keyed.join(scores, ["query_hash", "doc_hash"], "left").withColumn("score", 0.3 * F.col("score") + 0.7 * F.coalesce("model_score", F.lit(0.0)))
    return top(both.drop("query_hash", "doc_hash", "__t", "model_score", "rank"), [query_id], "score", row, k)


def inferred(pairs: DataFrame, a: str, b: str, model: NliModel | None, least: float = 0.7) -> DataFrame:
    """pairs with label and confidence of an inference model where it is sure enough; none without a model."""
    if model is None:
        return pairs.limit(0).withColumns({"label": F.lit("").cast("string"), "confidence": F.lit(0.0)})
    from webloom.operators.verification import inference_label

    keyed = pairs.withColumns({"__a": F.coalesce(F.col(a), F.lit("")), "__b": F.coalesce(F.col(b), F.lit(""))}).withColumn("__h", F.xxhash64("__a", "__b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.logits(list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[float(v) for v in x] for x in got], pa.list_(pa.float64()))], names=["__k", "__logits"])

    # each distinct pair is asked once, a batch at a time
    scored = keyed.select(F.col("__h").alias("__k"), "__a", "__b").dropDuplicates(["__k"]).mapInArrow(run, "__k long, __logits array<double>")
    joined = keyed.join(scored, F.col("__h") == F.col("__k")).withColumn("__l", inference_label(F.col("__logits"), model.labels)).where(F.col("__l.confidence") > least)
    return joined.withColumns({"label": F.col("__l.label"), "confidence": F.col("__l.confidence")}).drop("__l", "__a", "__b", "__h", "__k", "__logits")
