"""Entities by pattern and by runs of capitalised words."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Patterns in order of precedence.
PATTERNS = [
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "email"),
    (r"https?://[^\s<>\"']+", "url"),
    (r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b", "date"),
    (r"\b\d{4}-\d{2}-\d{2}\b", "date"),
    (r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", "date"),
    (r"\b\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4}\b", "date"),
    (r"[$€£¥]\s?\d[\d,]*\.?\d*\s?[BMKbmk]?\b", "money"),
    (r"\b\d[\d,]*\.?\d*\s?(?:dollars|euros|pounds|USD|EUR|GBP)\b", "money"),
    (r"\b\d+\.?\d*\s?%", "percentage"),
    (r"\b\d+\.?\d*\s+percent\b", "percentage"),
    (r"\+?\d{1,3}[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "phone"),
]
# what a text must hold for a pattern to be worth running, as a cheaper test
_NEEDS = {0: "@", 1: "://", 6: "[$€£¥]", 7: "dollars|euros|pounds|USD|EUR|GBP", 8: "%", 9: "percent", 10: r"\d{3}[-.\s]?\d{4}"}
CONNECTORS = frozenset("of the and for in de van von".split())
SKIPPED = frozenset("The This That These Those It He She They We However Therefore Moreover Furthermore In On At For But And Or".split())
_SIGNS = [
    ("location", "city state country river mountain".split(), ("land", "burg", "stan")),
    ("organization", "university institute corporation company inc ltd llc association foundation agency department ministry committee".split(), ()),
    ("date", "january february march april may june july august september october november december".split(), ()),
    ("product", "version v1 v2 pro plus edition".split(), ()),
]


def guess(name: str) -> str:
    low = name.lower()
    for kind, inside, endings in _SIGNS:
        if any(s in low for s in inside) or (endings and low.endswith(endings)):
            return kind
    return "person" if " " in name else "other"


def by_pattern(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, name, type): distinct names of three bytes or more; a name of several types has the first."""

    def found(i: int, rx: str):
        all_ = F.regexp_extract_all(F.col(text), F.lit(rx), F.lit(0))
        if i not in _NEEDS:
            return all_
        need = F.col(text).rlike(_NEEDS[i]) if any(c in _NEEDS[i] for c in "[|\\") else F.contains(text, F.lit(_NEEDS[i]))
        return F.when(need, all_).otherwise(F.array().cast("array<string>"))

    each = F.array(*[F.struct(F.lit(i).alias("p"), F.lit(t).alias("type"), found(i, rx).alias("names")) for i, (rx, t) in enumerate(PATTERNS)])
    rows = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.inline(each)).select("id", "p", "type", F.explode("names").alias("name"))
    rows = rows.withColumn("name", F.trim("name")).where(F.octet_length("name") >= 3)
    return rows.groupBy("id", "name").agg(F.min_by("type", "p").alias("type"))


def capitalised(text: str | None) -> list[tuple[str, str]]:
    ws, out, i = (text or "").split(), [], 0
    while i < len(ws):
        if not ws[i][0].isupper():
            i += 1
            continue
        j = i + 1
        while j < len(ws) and (ws[j][0].isupper() or ws[j] in CONNECTORS):
            j += 1
        name = " ".join(ws[i:j])
        if (j > i + 1 or len(ws[i].encode()) > 1) and name not in SKIPPED:
            out.append((name, guess(name)))
        i = j
    return out


def entities(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, name, type): both kinds, pattern types before phrase types."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, n, t) for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for n, t in dict(capitalised(x)).items()]
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], t) for j, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["id", "name", "type"])

    phrases = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text)).where(F.col(text).isNotNull()).mapInArrow(run, "id long, name string, type string")
    both = by_pattern(docs, id_col, text).select("id", "name", "type", F.lit(0).alias("o")).unionByName(phrases.withColumn("o", F.lit(1)))
    w = Window.partitionBy("id", "name").orderBy("o", "type")
    return both.withColumn("r", F.row_number().over(w)).where("r = 1").select("id", "name", "type")
