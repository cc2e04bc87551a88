"""Lines repeated across the documents of one source, and documents without them.

Every line is normalised (lower case, white space collapsed, runs of digits read as one sign) and hashed;
distinct documents are counted by (source, line hash) after a map-side distinct, so a hot line or source
is pre-aggregated before it is shuffled; lines on at least `min_docs` documents and `min_share` of the
source's documents are frequent. Their table is joined back by hash: at most 1/min_share lines a source
and line of a document exist, and the planner broadcasts it only if its measured size allows.

Defined results: null bodies and null sources are left alone (a line needs a source); blank lines are
never frequent; repeats within a document count once for the share and all are found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# what Python's \s matches, no-break spaces included
WHITE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
INK = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]"


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), WHITE, " "), "[0-9]+", "0"))


def lines_of(pages: DataFrame, id_col: str, doc_col: str, source_col: str, text_col: str) -> DataFrame:
    """(row_id, line_no, source, doc, h): the non-blank lines; doc and line are 64-bit hashes."""
    return (
        pages.where(F.col(text_col).isNotNull() & F.col(source_col).isNotNull())
        .select(
            F.col(id_col).alias("row_id"),
            F.col(source_col).alias("source"),
            F.xxhash64(F.coalesce(F.col(doc_col).cast("string"), F.col(id_col).cast("string"))).alias("doc"),
            F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"),
        )
        # a raw line with any other sign isn't blank; so the normal form is made once, in the hash
        .where(F.col("line").rlike(INK))
        .select("row_id", "line_no", "source", "doc", F.xxhash64(normalised(F.col("line"))).alias("h"))
    )


def frequent_lines(pages: DataFrame, id_col: str = "page_id", doc_col: str = "url", source_col: str = "domain", text_col: str = "body_text", min_docs: int = 6, min_share: float = 0.05) -> DataFrame:
    """(source, h, n_docs): the lines that come back across the documents of a source."""
    lines = lines_of(pages, id_col, doc_col, source_col, text_col)
    counts = lines.groupBy("source", "h", "doc").agg(F.lit(1).alias("one")).groupBy("source", "h").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)
    sizes = (
        pages.where(F.col(source_col).isNotNull())
        .select(F.col(source_col).alias("source"), F.xxhash64(F.coalesce(F.col(doc_col).cast("string"), F.col(id_col).cast("string"))).alias("doc"))
        .distinct()
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("source_docs"))
    )
    return counts.join(sizes, "source").where(F.col("n_docs") >= F.col("source_docs") * min_share).select("source", "h", "n_docs")


def found_lines(pages: DataFrame, frequent: DataFrame, id_col: str = "page_id", doc_col: str = "url", source_col: str = "domain", text_col: str = "body_text") -> DataFrame:
    """(row_id, line_no) of every frequent line, repeats included."""
    lines = lines_of(pages, id_col, doc_col, source_col, text_col)
    return lines.join(frequent.select("source", "h"), ["source", "h"], "left_semi").select("row_id", "line_no")


def without_lines(pages: DataFrame, found: DataFrame, id_col: str = "page_id", text_col: str = "body_text", out: str = "clean_text") -> DataFrame:
    """All pages with `out`: the text without the found lines; pages are joined on their id only."""
    drop = found.groupBy("row_id").agg(F.collect_set("line_no").alias("__drop")).withColumnRenamed("row_id", "__row")
    joined = pages.join(drop, F.col(id_col) == F.col("__row"), "left").drop("__row")
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.coalesce(F.array_contains(F.col("__drop"), i), F.lit(False)))
    return joined.withColumn(out, F.array_join(kept, "\n")).drop("__drop")
