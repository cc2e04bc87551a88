"""The pN_ queries over whole tables, with their SQL where SQL can say the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import capping, knn, leakage, main_content, mixing, outranking, repeated_lines, residue, splitting
from webloom.registry import Registry
from webloom.session import shared_dir
from webloom.tables import load

registry = Registry()

_LINES = r"""
WITH l AS (
  SELECT page_id, domain, url, generate_subscripts(string_split(body_text, chr(10)), 1) - 1 AS line_no,
         unnest(string_split(body_text, chr(10))) AS raw
  FROM site_pages WHERE body_text IS NOT NULL AND domain IS NOT NULL
), n AS (
  SELECT page_id, domain, url, line_no,
         trim(regexp_replace(regexp_replace(lower(raw), '[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g'), '[0-9]+', '0', 'g')) AS line
  FROM l
), f AS (
  SELECT domain, line FROM (SELECT domain, line, count(DISTINCT url) AS n FROM n WHERE line <> '' GROUP BY ALL)
  JOIN (SELECT domain, count(DISTINCT url) AS d FROM site_pages GROUP BY domain) USING (domain)
  WHERE n >= 6 AND n >= d * 0.05
)"""


@registry.query("p1_found", _LINES + " SELECT page_id, CAST(line_no AS INTEGER) AS line_no FROM n SEMI JOIN f USING (domain, line)")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that come back across the pages of a domain."""
    pages = load(spark, sf_dir, "site_pages").select("page_id", "url", "domain", "body_text")
    return repeated_lines.found_lines(pages, repeated_lines.frequent_lines(pages)).select(F.col("row_id").alias("page_id"), "line_no")


@registry.query(
    "p1_clean_pages",
    _LINES
    + """ SELECT p.page_id, string_agg(l.raw, chr(10) ORDER BY l.line_no) FILTER (WHERE f.line IS NULL) AS clean_text
    FROM site_pages p LEFT JOIN l USING (page_id) LEFT JOIN n ON n.page_id = l.page_id AND n.line_no = l.line_no LEFT JOIN f ON f.domain = n.domain AND f.line = n.line GROUP BY p.page_id""",
)
def p1_clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's text without the lines that come back across its domain; null where nothing is left."""
    pages = load(spark, sf_dir, "site_pages").select("page_id", "url", "domain", "body_text")
    found = repeated_lines.found_lines(pages, repeated_lines.frequent_lines(pages))
    clean = repeated_lines.without_lines(pages, found)
    kept_any = F.size(F.split("body_text", "\n", -1)) > 0
    return clean.select("page_id", F.when(kept_any, F.col("clean_text")).alias("clean_text"))


@registry.query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that hold template residue, filler or only an error, access or script message."""
    return residue.residue_pages(load(spark, sf_dir, "site_pages"))


@registry.query("p2_model_report")
def p2_model_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the classifier agrees with the weak labels of hosts it never saw."""
    report = residue.train(load(spark, sf_dir, "site_pages"), report=True).report
    return spark.createDataFrame([(k, float(v)) for k, v in report.items()], "measure string, value double")


_SCORES = {"bm25_score": (True, 1.0), "vector_score": (True, 1.0), "bm25_rank": (False, 1.0), "vector_rank": (False, 1.0)}


_PREFER = "least(1, greatest(0, ({0} - 0.02) / 0.48))"


@registry.query(
    "p3_ranking",
    f"""WITH l AS (SELECT query_id, cand_id, unnest([1, 2, 3, 4]) AS name, unnest([bm25_score, vector_score, -CAST(bm25_rank AS DOUBLE), -CAST(vector_rank AS DOUBLE)]) AS v FROM rank_candidates),
r AS (SELECT *, rank() OVER (PARTITION BY query_id, name ORDER BY v DESC) AS rk, count(*) OVER (PARTITION BY query_id, name, v) AS ties, count(*) OVER (PARTITION BY query_id, name) AS n FROM l WHERE v IS NOT NULL AND NOT isnan(v)),
p AS (SELECT query_id, cand_id, name, n, 1 - (rk + (ties - 1) / 2 - 0.5) / n AS pct FROM r),
f AS (SELECT a.query_id, a.cand_id, a.name, sum({_PREFER.format("(a.pct - b.pct)")} - {_PREFER.format("(b.pct - a.pct)")}) / any_value(a.n) AS flow FROM p a JOIN p b ON a.query_id = b.query_id AND a.name = b.name GROUP BY ALL),
g AS (SELECT c.query_id, c.cand_id, round(avg(flow), 9) AS net FROM rank_candidates c LEFT JOIN f USING (query_id, cand_id) GROUP BY ALL)
SELECT query_id, cand_id, round(net, 6) + CAST(0 AS DOUBLE) AS net_flow, row_number() OVER (PARTITION BY query_id ORDER BY net DESC NULLS LAST, cand_id) AS final_rank FROM g""",
)
def p3_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order of each query's candidates from two scores and two ranks."""
    rows = load(spark, sf_dir, "rank_candidates").select("query_id", "cand_id", *_SCORES)
    return outranking.outrank(rows, "query_id", "cand_id", _SCORES).withColumn("net_flow", F.round("net_flow", 6) + 0.0)


_VECTORS = (("rank_candidates", "cand_id", "embedding"), ("embedding_entries", "entry_id", "vector"))


_PAIRS = """SELECT '{t}' AS tbl, a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.v, y.v) AS s FROM {t}_v x JOIN {t}_v y ON x.id <> y.id) WHERE s >= 0.9) WHERE r <= 10"""
_USABLE = """{t}_v AS (SELECT {k} AS id, {v}::DOUBLE[] AS v FROM {t} WHERE len({v}) = 64 AND len(list_filter({v}, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter({v}, lambda x: x <> 0)) > 0)"""


@registry.query(
    "p4_found",
    "WITH "
    + ", ".join(_USABLE.format(t=t, k=k, v=v) for t, k, v in _VECTORS)
    + ", m AS ("
    + " UNION ALL ".join(_PAIRS.format(t=t) for t, _, _ in _VECTORS)
    + ") SELECT m.tbl, m.a AS id_a, m.b AS id_b FROM m JOIN m n ON m.tbl = n.tbl AND m.a = n.b AND m.b = n.a WHERE m.a < m.b",
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of cosine 0.9 or more, each among the ten most similar of the other."""
    parts = [
        knn.mutual_pairs(load(spark, sf_dir, table), key, vec, 0.9).select(F.lit(table).alias("tbl"), "id_a", "id_b") for table, key, vec in _VECTORS
    ]
    return parts[0].unionByName(parts[1])


@registry.query("p4_neighbours")
def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar vectors of every vector whose id is divisible by 50, among all."""
    parts = [
        knn.neighbours(load(spark, sf_dir, table), key, vec, query_step=50).select(F.lit(table).alias("tbl"), "id", "other", F.round("similarity", 6).alias("similarity"), "place")
        for table, key, vec in _VECTORS
    ]
    return parts[0].unionByName(parts[1])


_HOST = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(domain)), ':\d*$', ''), '\.+$', ''), '^www\.', '')"
_ORDER = "ORDER BY (score IS NULL OR isnan(score)), CASE WHEN NOT isnan(score) THEN score END DESC, div_id"


@registry.query("p6_found", f"SELECT div_id FROM (SELECT div_id, row_number() OVER (PARTITION BY query_id, {_HOST} {_ORDER}) AS r FROM diversity_candidates) WHERE r > 2")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows beyond the two best of each host in each query."""
    rows = load(spark, sf_dir, "diversity_candidates").select("query_id", "div_id", "score", capping.host_of(F.col("domain")).alias("host"))
    return capping.over_count(rows, ["query_id"], "host", "score", "div_id", 2).select("div_id")


@registry.query(
    "p6_share_capped",
    f"""WITH d AS (SELECT query_id, div_id, {_HOST} AS host, row_number() OVER (PARTITION BY query_id, {_HOST} {_ORDER}) AS r FROM diversity_candidates), c AS (SELECT query_id, host, count(*) AS n FROM d GROUP BY ALL),
t AS (SELECT query_id, unnest(range(1, max(n) + 1)) AS level FROM c GROUP BY query_id), o AS (SELECT query_id, level FROM t JOIN c USING (query_id) GROUP BY ALL HAVING max(least(n, level)) <= 0.2 * sum(least(n, level)) + 1e-9),
b AS (SELECT q.query_id, coalesce(max(level), 1) AS level FROM (SELECT DISTINCT query_id FROM c) q LEFT JOIN o USING (query_id) GROUP BY ALL)
SELECT query_id, div_id, host, r AS rank_in_contributor, level FROM d JOIN b USING (query_id) WHERE r <= level""",
)
def p6_share_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's rows with no host above a fifth of what is kept, the best by score staying."""
    rows = load(spark, sf_dir, "diversity_candidates").select("query_id", "div_id", "score", capping.host_of(F.col("domain")).alias("host"))
    return capping.capped_by_share(rows, ["query_id"], "host", "score", "div_id", 0.2).select("query_id", "div_id", "host", "rank_in_contributor", "level")


@registry.query("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct main-content lines of every page, by key."""
    html_pages = load(spark, sf_dir, "crawled_pages").select("fetch_id", "body")
    model = main_content.fit_weights(html_pages, "fetch_id", "body")
    text = main_content.main_line_keys(load(spark, sf_dir, "site_pages"), "page_id", "body_text", html=False, model=model)
    html = main_content.main_line_keys(html_pages, "fetch_id", "body", html=True, model=model)
    return text.select(F.lit("site_pages").alias("src"), "row_id", "line_key").unionAll(html.select(F.lit("crawled_pages").alias("src"), "row_id", "line_key"))


@registry.query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a held-out item."""
    return leakage.leaked(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


@registry.query("p9_mixture")
def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture with how often each is used."""
    return mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets")).documents


@registry.query("p9_report")
def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source."""
    return mixing.report_frame(spark, mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets")).report)


@registry.query("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are cut because they pass 2,048 tokens."""
    return splitting.oversized(load(spark, sf_dir, "documents"))


@registry.query("p10_pieces")
def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their pieces."""
    return splitting.split_texts(load(spark, sf_dir, "documents"))


@registry.query("p10_file_pieces")
def p10_file_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as plain text files, and these cut range by range as files of any size are."""
    folder = f"{shared_dir(spark)}/webloom-texts-{uuid.uuid4().hex}"
    load(spark, sf_dir, "documents").where("text is not null").select("text").write.text(folder)
    pieces = splitting.split_files(spark, sorted(spark.read.text(folder).inputFiles()))
    return pieces.select("file_no", "piece_no", "start_byte", "end_byte", "n_tokens", F.md5("text").alias("digest"))
