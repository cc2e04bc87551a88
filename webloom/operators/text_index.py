"""A text index kept on disk: build, append, and BM25 search with required, excluded, phrase and field parts.

A segment holds postings (term, field, doc, tf, len, positions) in folders by a hash of the term, sorted by term within
files, and two small tables: documents and lengths of every field, and document frequencies of every term. A
question reads the folders of its terms only (partition pruning) and within them the row groups of its terms. A
term in very many documents is spread over several files, so neither writing nor reading puts it into one task.

Defined results: null fields are empty; a document given twice is found twice, so appended segments should hold
new documents; a question without a usable part finds nothing; ties go to the smaller id.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions.text import index_tokens
from webloom.operators.retrieval import K1, B, parse_query

BUCKETS, FILES_A_BUCKET = 32, 4


def _bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(BUCKETS)).cast("int")


def append(docs: DataFrame, id_col: str, fields: list[str], path: str) -> None:
    """Add a segment of the documents to the index at path (made if need be); a segment shows up whole or not at all."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc"),
        F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(index_tokens(F.col(f)), F.array().cast("array<string>")).alias("t")) for f in fields])),
    )
    segment = uuid.uuid4().hex
    terms = rows.select("doc", "field", F.size("t").alias("len"), F.posexplode("t").alias("pos", "term"))
    held = terms.groupBy("doc", "field", "term").agg(F.first("len").alias("len"), F.array_sort(F.collect_list("pos")).alias("positions"))
    held = held.select("term", "field", "doc", F.size("positions").alias("tf"), "len", "positions", _bucket(F.col("term")).alias("bucket"))
    spread = held.repartition("bucket", F.pmod(F.xxhash64("doc"), F.lit(FILES_A_BUCKET))).sortWithinPartitions("bucket", "term", "doc")
    spread.write.partitionBy("bucket").parquet(f"{path}/postings/segment={segment}")
    stored = docs.sparkSession.read.parquet(f"{path}/postings/segment={segment}")
    stored.groupBy("bucket", "term", "field").agg(F.count(F.lit(1)).alias("df")).repartition("bucket").sortWithinPartitions("term").write.partitionBy("bucket").parquet(f"{path}/terms/segment={segment}")
    # written last: only segments with lengths are read
    rows.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("t")).cast("long").alias("total")).coalesce(1).write.parquet(f"{path}/lengths/segment={segment}")


@dataclass(frozen=True)
class TextIndex:
    postings: DataFrame
    terms: DataFrame
    lengths: dict[str, tuple[int, float]]
    docs: int

    def _scored(self, df: DataFrame, freq: str, tf: str) -> Column:
        mean = F.coalesce(*[F.when(F.col("field") == f, F.lit(m or 1.0)) for f, (_, m) in self.lengths.items()], F.lit(1.0))
        idf = F.log(1 + (F.lit(self.docs) - F.col(freq) + 0.5) / (F.col(freq) + 0.5))
        return idf * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col("len") / mean))

    def search_all(self, queries: DataFrame, query_id: str, query_text: str, fields: list[str] | None = None, k: int = 10, id_col: str = "doc") -> DataFrame:
        """(query, doc, score, rank) of many plain queries at once: every word may match, the words of a query meet the postings by a join."""
        wanted = queries.select(F.col(query_id).alias("q"), F.explode(F.array_distinct(index_tokens(F.col(query_text)))).alias("term")).distinct()
        wanted = wanted.withColumn("bucket", _bucket(F.col("term")))
        terms = self.terms if fields is None else self.terms.where(F.col("field").isin(fields))
        known = wanted.join(terms.groupBy("bucket", "term", "field").agg(F.sum("df").alias("df")), ["bucket", "term"])
        scored = self.postings.join(known, ["bucket", "term", "field"]).withColumn("w", self._scored(self.postings, "df", "tf")).groupBy("q", "doc").agg(F.round(F.sum("w"), 6).alias("score"))
        order = Window.partitionBy("q").orderBy(F.desc("score"), "doc")
        best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return best.select(F.col("q").alias(query_id), F.col("doc").alias(id_col), "score", "rank")

    def search(self, query: str, fields: list[str] | None = None, k: int = 10) -> DataFrame:
        """(doc, score, rank) of one question: +word must and -word must not stand, "words" stand side by side, field:word looks in one field."""
        parts = parse_query(query)
        clauses = [(kind, field, tokens) for kind in ("must", "not", "phrase", "should") for field, tokens in parts[kind]]
        words = sorted({t for _, _, tokens in clauses for t in tokens})
        spark = self.postings.sparkSession
        if not any(kind != "not" for kind, _, _ in clauses) or not self.docs:
            return spark.createDataFrame([], "doc long, score double, rank int")
        buckets = sorted({zlib.crc32(w.encode("utf-8")) % BUCKETS for w in words})
        mine = lambda df: df.where(F.col("bucket").isin(buckets) & F.col("term").isin(words))
        some = fields or list(self.lengths)
        freq = {(r.term, r.field): r.df for r in mine(self.terms).groupBy("term", "field").agg(F.sum("df").alias("df")).collect()}
        idf = {k: float(v) for k, v in freq.items()}
        hits = mine(self.postings).where(F.col("field").isin(some)).select("term", "field", "doc", "tf", "len", "positions")
        df_of = F.coalesce(*[F.when((F.col("term") == t) & (F.col("field") == f), F.lit(n)) for (t, f), n in idf.items()], F.lit(0.0))
        out = None
        for no, (kind, field, tokens) in enumerate(clauses):
            at = hits if field is None else hits.where(F.col("field") == field)
            if len(tokens) == 1:
                got = at.where(F.col("term") == tokens[0]).withColumn("df", df_of).select("doc", self._scored(hits, "df", "tf").alias("w"))
            else:
                # the words' positions, each moved back by its place in the phrase, meet where the phrase begins
                held = at.where(F.col("term").isin(tokens)).groupBy("doc", "field").agg(F.first("len").alias("len"), *[F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(f"p{i}") for i, t in enumerate(tokens)])
                begin = F.col("p0")
                for i in range(1, len(tokens)):
                    begin = F.array_intersect(begin, _moved_back(f"p{i}", i))
                held = held.withColumn("tf", F.coalesce(F.size(begin), F.lit(0)).cast("double")).where("tf > 0")
                mean = F.coalesce(*[F.when(F.col("field") == f, F.lit(m or 1.0)) for f, (_, m) in self.lengths.items()], F.lit(1.0))
                idfs = F.coalesce(
                    *[F.when(F.col("field") == f, sum(_idf(self.docs, freq.get((t, f), 0)) for t in tokens)) for f in some],
                    F.lit(0.0),
                )
                got = held.select("doc", (idfs * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))).alias("w"))
            got = got.select("doc", F.lit(no).alias("clause"), F.lit(kind).alias("kind"), "w")
            out = got if out is None else out.unionAll(got)
        required = [no for no, (kind, _, _) in enumerate(clauses) if kind in ("must", "phrase")]
        met = out.groupBy("doc").agg(
            F.round(F.sum(F.when(F.col("kind") != "not", F.col("w")).otherwise(0.0)), 6).alias("score"),
            F.collect_set(F.when(F.col("kind").isin("must", "phrase"), F.col("clause"))).alias("required"),
            F.max((F.col("kind") == "not").cast("int")).alias("refused"),
        )
        fine = met.where((F.size("required") == len(required)) & (F.col("refused") == 0) & (F.col("score") > 0))
        order = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "doc")
        return fine.orderBy(F.desc("score"), "doc").limit(k).withColumn("rank", F.row_number().over(order)).select("doc", "score", "rank")


def _moved_back(positions: str, by: int) -> Column:
    return F.transform(positions, lambda x: x - by)


def _idf(total: int, df: int) -> float:
    import math

    return math.log(1 + (total - df + 0.5) / (df + 0.5))


def read(spark: SparkSession, path: str) -> TextIndex:
    """The index at path with all its whole segments."""
    lengths = spark.read.parquet(f"{path}/lengths")
    whole = [r.segment for r in lengths.select("segment").distinct().collect()]
    stats = {r.field: (r.n, r.total / max(1, r.n)) for r in lengths.groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    postings, terms = (spark.read.parquet(f"{path}/{part}").where(F.col("segment").isin(whole)).drop("segment") for part in ("postings", "terms"))
    return TextIndex(postings, terms, stats, max((n for n, _ in stats.values()), default=0))


_KEPT: dict[tuple[str, str], TextIndex] = {}


def read_kept(spark: SparkSession, path: str) -> TextIndex:
    """read() of an index whose name follows its content (kept_for), remembered for the session."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _KEPT:
        _KEPT[key] = read(spark, path)
    return _KEPT[key]


def exists(spark: SparkSession, path: str, mark: str = "lengths") -> bool:
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{mark}")
    return bool(root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root))


def _signature(spark: SparkSession, table: DataFrame, *more: str) -> str:
    """A name that follows the files of a stored table, so that a changed table gets a new one."""
    sign = []
    for f in sorted(table.inputFiles()):
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        s = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
        sign.append(f"{f}:{s.getLen()}:{s.getModificationTime()}")
    return hashlib.md5("|".join([*sign, *more]).encode()).hexdigest()


def kept_for(spark: SparkSession, docs: DataFrame, id_col: str, fields: list[str], folder: str) -> str:
    """The path of the index of a stored table under folder, built at the first call."""
    path = f"{folder}/webloom-text-index-{_signature(spark, docs, id_col, *fields)}"
    if not exists(spark, path):
        append(docs, id_col, fields, path)
    return path


def kept_table(spark: SparkSession, source: DataFrame, label: str, folder: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives for a stored table, written under folder at the first call and read afterwards."""
    path = f"{folder}/webloom-{label}-{_signature(spark, source, label)}"
    if not exists(spark, path, "_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
