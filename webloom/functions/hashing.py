"""Content hashes and 64-bit similarity fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.text import let, words


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def md5_60(text: Column) -> Column:
    """60 bits of the MD5, the same in every engine."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def shingles(text: Column, size: int = 3) -> Column:
    """Runs of `size` words as written; empty below that."""
    none = F.array().cast("array<string>")
    runs = lambda w: F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))).otherwise(none)
    return let(words(text), runs)


def simhash(text: Column, bits: int = 60, hashed=md5_60) -> Column:
    """Fingerprint by majority vote of the shingles' hash bits; 0 for texts of fewer than three words."""
    h = F.transform(shingles(text), hashed)
    votes = lambda b: F.aggregate(h, F.lit(0), lambda s, x: s + F.when(x.bitwiseAND(F.lit(1 << b)) != 0, 1).otherwise(-1))
    total = F.lit(0).cast("long")
    for b in range(bits):
        total = total + F.when(votes(b) > 0, F.lit(1 << b)).otherwise(F.lit(0)).cast("long")
    return total


def _votes(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        h = np.asarray(lists.flatten(), np.int64)
        size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
        row = np.repeat(np.arange(len(size)), size)
        fp = np.zeros(len(size), np.int64)
        for b in range(bits):
            vote = np.bincount(row, weights=np.where((h >> b) & 1, 1.0, -1.0), minlength=len(size))
            fp |= np.where(vote > 0, np.int64(1) << np.int64(b), np.int64(0))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["id", "fp"])


def simhash_frame(df: DataFrame, id_col: str, text_col: str, bits: int = 60, hashed=md5_60) -> DataFrame:
    """(id, fp): shingles are hashed natively, the votes counted over whole Arrow batches; no shuffle."""
    h = df.select(F.col(id_col).cast("long").alias("id"), F.transform(shingles(F.coalesce(F.col(text_col), F.lit(""))), hashed).alias("h"))
    return h.mapInArrow(lambda it: _votes(it, bits), "id long, fp long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash_of(text: str | None, bits: int = 60) -> int:
    """The same fingerprint of one text in Python, for rows that are in a Python step anyway."""
    w = (text or "").split()
    h = np.array([int(hashlib.md5(" ".join(w[i : i + 3]).encode("utf-8", "surrogatepass")).hexdigest()[:15], 16) for i in range(len(w) - 2)], np.int64)
    return sum(1 << b for b in range(bits) if len(h) and 2 * ((h >> b) & 1).sum() > len(h))
