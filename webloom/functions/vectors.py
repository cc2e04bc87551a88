"""Vector expressions over array columns. Mismatched lengths and zero norms give 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    scale = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (scale < 1e-10), 0.0).otherwise(dot(a, b) / scale)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 1e-10, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def max_similarity(query: Column, doc: Column) -> Column:
    """Sum over the query's token vectors of the best dot product in the document; 0 where either is empty."""
    best = F.transform(query, lambda q: F.coalesce(F.array_max(F.transform(doc, lambda d: dot(q, d))), F.lit(0.0)))
    return F.coalesce(F.aggregate(best, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))
