"""Claims repeated by independent organisations, echo chambers and numeric disagreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.text import key_phrases, words
from webloom.functions.urls import host, organisation


def phrases(docs: DataFrame, scope: str, url: str, text: str, order: str) -> DataFrame:
    """(scope, url, org, seq, phrase, phrase_raw): each document's key phrases in document order."""
    return docs.select(
        F.col(scope).alias("scope"), F.col(url).alias("url"), organisation(host(F.col(url))).alias("org"), F.col(order).alias("ord"), F.posexplode(key_phrases(F.col(text))).alias("pos", "raw")
    ).select("scope", "url", "org", F.struct("ord", "pos").alias("seq"), F.lower("raw").alias("phrase"), F.col("raw").alias("phrase_raw"))


def long_words(phrase: Column) -> Column:
    return F.array_distinct(F.filter(words(phrase), lambda w: F.octet_length(w) > 3))


def fuzzy_sources(p: DataFrame, least: float = 0.4) -> DataFrame:
    """(scope, phrase, url, org, seq): a phrase's own sources and those of later phrases that share 40 % of its long words.

    Pairs meet through a shared word; to reach 40 % of at most the longer phrase's words they share one of
    the rarest 60 %, so each phrase is listed under its rarest ceil(.6 n) + 1 words only (prefix filter,
    exact). No word leads to a cross join of a scope.
    """
    first = p.groupBy("scope", "phrase").agg(F.min("seq").alias("first_seq"))
    w = p.select("scope", "phrase").distinct().withColumn("w", long_words(F.col("phrase"))).where(F.size("w") >= 3)
    freq = w.select("scope", F.explode("w").alias("word")).groupBy("scope", "word").agg(F.count(F.lit(1)).alias("n"))
    ranked = w.select("scope", "phrase", F.size("w").alias("size"), F.explode("w").alias("word")).join(freq, ["scope", "word"])
    place = Window.partitionBy("scope", "phrase").orderBy("n", "word")
    # an overlap of at least ceil(least * n) words of n leaves n - that + 1 words of which one must be shared
    prefix = ranked.withColumn("r", F.row_number().over(place)).where(F.col("r") <= F.col("size") - F.ceil(least * F.col("size")) + 1).select("scope", "word", "phrase")
    a, b = prefix.withColumnRenamed("phrase", "pa"), prefix.withColumnRenamed("phrase", "pb")
    pairs = a.join(b, ["scope", "word"]).where(F.col("pa") != F.col("pb")).select("scope", "pa", "pb").distinct()
    wa, wb = long_words(F.col("pa")), long_words(F.col("pb"))
    same = pairs.where(F.size(F.array_intersect(wa, wb)) / F.greatest(F.size(wa), F.size(wb)) >= least)
    later = (
        same.join(first.select("scope", F.col("phrase").alias("pa"), "first_seq"), ["scope", "pa"])
        .join(p.select("scope", F.col("phrase").alias("pb"), "url", "org", "seq"), ["scope", "pb"])
        .where(F.col("seq") > F.col("first_seq"))
        .select("scope", F.col("pa").alias("phrase"), "url", "org", "seq")
    )
    return p.select("scope", "phrase", "url", "org", "seq").unionByName(later)


def claims(p: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(scope, phrase, source_url, orgs, verification, confidence), attributed to the phrase's first source."""
    sources = fuzzy_sources(p) if fuzzy else p.select("scope", "phrase", "url", "org", "seq")
    out = sources.groupBy("scope", "phrase").agg(F.countDistinct("org").alias("orgs"), F.min_by("url", "seq").alias("source_url"))
    status = F.when(F.col("orgs") >= 2, "Verified").when(F.col("orgs") == 1, "Partial").otherwise("Unverified")
    sure = F.when(F.col("orgs") >= 2, 0.9).when(F.col("orgs") == 1, 0.7).otherwise(0.5)
    return out.select("scope", "phrase", "source_url", "orgs", status.alias("verification"), sure.alias("confidence"))


def echo_chamber(docs: DataFrame, scope: str, url: str, min_orgs: int = 3) -> DataFrame:
    """(scope, docs, orgs, echo_risk, domains): many documents of few organisations; five domains named."""
    d = docs.select(F.col(scope).alias("scope"), host(F.col(url)).alias("domain")).withColumn("org", organisation(F.col("domain")))
    names = d.groupBy("scope", "domain").agg(F.lit(1).alias("x"))
    five = names.withColumn("r", F.row_number().over(Window.partitionBy("scope").orderBy("domain"))).where("r <= 5").groupBy("scope").agg(F.array_sort(F.collect_list("domain")).alias("domains"))
    out = d.groupBy("scope").agg(F.count(F.lit(1)).alias("docs"), F.countDistinct("org").alias("orgs"))
    return out.join(five, "scope").select("scope", "docs", "orgs", ((F.col("orgs") < min_orgs) & (F.col("docs") >= min_orgs)).alias("echo_risk"), "domains")


_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def number_claims(p: DataFrame) -> DataFrame:
    """(scope, topic, unit, value, url, seq, i): every number of a phrase with the up to five words before it, three at least."""
    w = words(F.col("phrase_raw"))
    each = p.withColumn("w", w).select("scope", "url", "seq", "w", F.posexplode("w").alias("i", "word"))
    bare = F.regexp_replace("word", "[,%]", "")
    start = F.greatest(F.col("i") - 5, F.lit(0))
    topic = F.array_join(F.slice("w", start + 1, F.col("i") - start), " ")
    unit = F.when(F.col("word").endswith("%"), "%").otherwise(F.coalesce(F.get("w", F.col("i") + 1), F.lit("")))
    return each.where((F.col("i") >= 3) & bare.rlike(_NUMBER)).select("scope", topic.alias("topic"), unit.alias("unit"), bare.try_cast("double").alias("value"), "url", "seq", "i")


def numeric_contradictions(numbers: DataFrame) -> DataFrame:
    """(scope, topic, unit, value_a, source_a, value_b, source_b, severity): spreads over 20 %, the first two values in order."""
    two = F.slice(F.array_sort(F.collect_list(F.struct("seq", "i", "value", "url"))), 1, 2)
    g = numbers.groupBy("scope", "topic", "unit").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"), two.alias("t"))
    g = g.where((F.col("n") >= 2) & (F.col("lo") > 0) & ((F.col("hi") - F.col("lo")) / F.col("lo") > 0.2))
    hard = F.when((F.col("hi") - F.col("lo")) / F.col("lo") > 1.0, "Hard").otherwise("Soft")
    return g.select("scope", "topic", "unit", F.col("t")[0]["value"].alias("value_a"), F.col("t")[0]["url"].alias("source_a"), F.col("t")[1]["value"].alias("value_b"), F.col("t")[1]["url"].alias("source_b"), hard.alias("severity"))


def inference_label(logits: Column, labels: list[str], least_spread: float = 0.5) -> Column:
    """struct(label, confidence) of an inference model's logits; null label where they are too close."""
    from webloom.functions.vectors import softmax

    spread = F.array_max(logits) - F.array_min(logits)
    p = softmax(logits)
    best = F.array_max(p)
    names = F.array(*map(F.lit, labels))
    return F.when(spread >= least_spread, F.struct(F.element_at(names, F.array_position(p, best).cast("int")).alias("label"), best.alias("confidence")))


def inference_pairs(rows: DataFrame, scope: str, row: str, text: str, rank: str, docs: int = 5, least_words: int = 8) -> DataFrame:
    """(scope, a, b, sentence_a, sentence_b): the first longer sentences of a scope's best `docs` rows, each pair once.

    At most docs * (docs - 1) / 2 pairs a scope, since the rows are cut to the best before they meet.
    """
    parts = F.filter(F.transform(F.split(F.col(text), "[.!?]"), lambda x: F.trim(x)), lambda x: F.size(words(x)) >= least_words)
    best = rows.where(F.col(rank) <= docs).select(F.col(scope).alias("scope"), F.col(row).alias("r"), F.col(rank).alias("k"), F.get(parts, F.lit(0)).alias("s")).where("s is not null")
    a = best.select("scope", F.col("r").alias("a"), F.col("k").alias("ka"), F.col("s").alias("sentence_a"))
    b = best.select("scope", F.col("r").alias("b"), F.col("k").alias("kb"), F.col("s").alias("sentence_b"))
    return a.join(b, "scope").where(F.col("ka") < F.col("kb")).select("scope", "a", "b", "sentence_a", "sentence_b")
