"""Chunks of sentences by words with an overlap of trailing sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk(text: str | None, target: int = 512, overlap: float = 0.2) -> list[str]:
    """Chunks of about `target` words; each starts with the last sentences of the one before, up to overlap * target words."""
    parts = [s.strip() for s in re.split(r"(?<=[.!?])(?=[ \n\r])", text or "") if s.strip()]
    out, now, n, keep = [], [], 0, int(target * overlap)
    for s in parts:
        k = len(s.split())
        if now and n + k > target:
            out.append(" ".join(now))
            tail, m = [], 0
            for t in reversed(now):
                if m + len(t.split()) > keep:
                    break
                tail.insert(0, t)
                m += len(t.split())
            now, n = tail, m
        now.append(s)
        n += k
    if now:
        out.append(" ".join(now))
    return out


def chunks(docs: DataFrame, id_col: str, text: str, target: int = 512, overlap: float = 0.2) -> DataFrame:
    """(id, chunk_no, chunk, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, c, len(c.split())) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for n, c in enumerate(chunk(t, target, overlap))]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.int32()))], names=["id", "chunk_no", "chunk", "words"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text).mapInArrow(run, "id long, chunk_no int, chunk string, words int")
