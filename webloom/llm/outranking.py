"""One ranking from several scores on unlike scales, by outranking net flow.

Within a query every score becomes a percentile of its own (ties share the middle rank), so neither range
nor distribution matters. A row is preferred to another by a score as far as its percentile is ahead: not
at all up to `indifference`, wholly from `preference` on, in proportion between. A row's flow by a score is
the mean preference over all other rows minus the mean preference of them over it, and the ranking goes by
the weighted sum of flows. Flows are exact and need no pairs: sums over all rows ahead by more than x are
differences of prefix sums over the sorted percentiles, looked up at four shifted points of every value.

A query of up to CELL_ROWS rows is handled where its rows meet: one exchange by query, after which every
score is a sort, a rank and running sums up to a shifted percentile. Larger queries go through cells:
ties are pre-aggregated, ranks come from exact_rank, and the prefix sums run in cells of the percentile
scale, as many as the query has rows / CELL_ROWS, so no task sees a whole hot query. Both give the same flows.

Defined results: a null or NaN score compares with nothing. By default ("present") a row's net flow is the
weighted mean over the scores it has; "neutral" counts a missing score as a flow of 0, "last" as that of a
row behind all others. Infinite scores are the extremes. Ties in the net flow go to the smaller id. Rows
without any score have a null flow and come last. The rows of a null query are a query of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.operators.group_rank import exact_rank, hot_groups, same_keys
from webloom.session import stage_table

CELL_ROWS = 50_000


def percentiles(df: DataFrame, query: str, row: str, scores: dict[str, bool]) -> DataFrame:
    """(query, row, name, pct): mid-rank percentile of every present score, 1 best. scores: column -> whether higher is better."""
    value = lambda c, up: F.col(c).cast("double") if up else -F.col(c).cast("double")
    long = df.select(
        F.col(query).alias("q"),
        F.col(row).alias("r"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("name"), value(c, up).alias("v")) for c, up in scores.items()])),
    ).where("v is not null and not isnan(v)")
    ranks = exact_rank(long, ["q", "name"], "v", "r", out="rn")
    ties = ranks.groupBy("q", "name", "v").agg(((F.min("rn") + F.max("rn")) / 2).alias("mid"))
    sizes = long.groupBy("q", "name").agg(F.count(F.lit(1)).alias("n"))
    ties = ties.join(sizes, ["q", "name"]).select("q", "name", "v", "n", (1 - (F.col("mid") - 0.5) / F.col("n")).alias("pct"))
    return long.join(ties, ["q", "name", "v"])


def flows(pct: DataFrame, preference: float, indifference: float, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(q, name, pct, flow) for every distinct percentile: sum of preferences over others minus theirs, over n."""
    if not 0 <= indifference < preference:
        raise ValueError("0 <= indifference < preference")
    p, d = preference, indifference
    values = pct.groupBy("q", "name", "pct").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    cells = F.ceil(F.col("n") / cell_rows)
    tiny = 1e-12
    # prefix at x counts percentiles <= x; behind by at least p: <= pct - p, behind by more than d: < pct - d
    points = {"b_p": F.col("pct") - p + tiny, "b_d": F.col("pct") - d - tiny, "a_d": F.col("pct") + d + tiny, "a_p": F.col("pct") + p - tiny}
    probes = values.select("q", "name", "n", F.col("pct").alias("at"), F.inline(F.array(*[F.struct(F.lit(k).alias("what"), x.alias("x")) for k, x in points.items()])))
    facts = values.select("q", "name", "n", F.col("pct").alias("at"), F.lit("").alias("what"), F.col("pct").alias("x"), "c", (F.col("c") * F.col("pct")).alias("s"))
    union = facts.unionByName(probes.withColumns({"c": F.lit(0).cast("long"), "s": F.lit(0.0)})).withColumn("cell", F.greatest(F.lit(-1), F.least(cells, F.floor(F.col("x") * cells))).cast("long"))
    inside = Window.partitionBy("q", "name", "cell").orderBy("x", "what").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("q", "name").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = union.groupBy("q", "name", "cell").agg(F.sum("c").alias("tc"), F.sum("s").alias("ts"))
    totals = totals.select("q", "name", "cell", F.coalesce(F.sum("tc").over(before), F.lit(0)).alias("oc"), F.coalesce(F.sum("ts").over(before), F.lit(0.0)).alias("os"))
    summed = (
        union.withColumns({"pc": F.sum("c").over(inside), "ps": F.sum("s").over(inside)})
        .where("what <> ''")
        .join(totals, ["q", "name", "cell"])
        .select("q", "name", "at", "n", "what", (F.col("pc") + F.col("oc")).alias("C"), (F.col("ps") + F.col("os")).alias("S"))
    )
    pick = lambda k, c: F.max(F.when(F.col("what") == k, F.col(c)))
    wide = summed.groupBy("q", "name", F.col("at").alias("pct")).agg(F.max("n").alias("n"), *[pick(k, c).alias(f"{k}_{c}") for k in points for c in "CS"])
    all_c = F.col("n")
    total_s = values.groupBy("q", "name").agg(F.sum(F.col("c") * F.col("pct")).alias("all_s"))
    wide = wide.join(total_s, ["q", "name"])
    own = F.col("pct")
    near = lambda k, c: F.col(f"{k}_{c}")
    plus = near("b_p", "C") + ((own - d) * (near("b_d", "C") - near("b_p", "C")) - (near("b_d", "S") - near("b_p", "S"))) / (p - d)
    minus = (all_c - near("a_p", "C")) + ((near("a_p", "S") - near("a_d", "S")) - (own + d) * (near("a_p", "C") - near("a_d", "C"))) / (p - d)
    return wide.select("q", "name", "pct", "n", ((plus - minus) / F.greatest(F.col("n"), F.lit(1))).alias("flow"))


def flows_in_place(base: DataFrame, names: list[str], preference: float, indifference: float) -> DataFrame:
    """base with flow_<name> of every score, by windows that all share the one partitioning by q."""
    if not 0 <= indifference < preference:
        raise ValueError("0 <= indifference < preference")
    p, d, tiny = preference, indifference, 1e-12
    ranked = base
    for c in names:
        down = Window.partitionBy("q").orderBy(F.desc_nulls_last(c))
        ranked = ranked.withColumns({f"rk_{c}": F.rank().over(down), f"ties_{c}": F.count(c).over(down.rangeBetween(0, 0))})
    every = Window.partitionBy("q")
    ranked = ranked.withColumns({f"n_{c}": F.count(c).over(every) for c in names})
    ranked = ranked.withColumns({f"pct_{c}": F.when(F.col(c).isNotNull(), 1 - (F.col(f"rk_{c}") + (F.col(f"ties_{c}") - 1) / 2 - 0.5) / F.col(f"n_{c}")) for c in names})
    ranked = ranked.select("q", "r", *[f"{k}_{c}" for c in names for k in ("n", "pct")])
    # counts and sums of the percentiles up to four shifted points; the shifts are constants, so each is one running frame
    points = {"b_p": f"{p - tiny:.15f}D PRECEDING", "b_d": f"{d + tiny:.15f}D PRECEDING", "a_d": f"{d - tiny if d > tiny else 0.0:.15f}D FOLLOWING", "a_p": f"{p - tiny:.15f}D FOLLOWING"}
    for c in names:
        over = f"OVER (PARTITION BY q ORDER BY pct_{c} RANGE BETWEEN UNBOUNDED PRECEDING AND {{}})"
        ranked = ranked.withColumns({f"{k}_{m}": F.expr(f"coalesce({agg}(pct_{c}) {over.format(bound)}, 0)") for k, bound in points.items() for m, agg in (("C", "count"), ("S", "sum"))})
        own, at = F.col(f"pct_{c}"), F.col
        plus = at("b_p_C") + ((own - d) * (at("b_d_C") - at("b_p_C")) - (at("b_d_S") - at("b_p_S"))) / (p - d)
        minus = (at(f"n_{c}") - at("a_p_C")) + ((at("a_p_S") - at("a_d_S")) - (own + d) * (at("a_p_C") - at("a_d_C"))) / (p - d)
        ranked = ranked.withColumn(f"flow_{c}", (plus - minus) / F.greatest(at(f"n_{c}"), F.lit(1))).drop(*[f"{k}_{m}" for k in points for m in "CS"])
    return ranked.select("q", "r", *[f"flow_{c}" for c in names])


def flows_in_cells(base: DataFrame, names: list[str], preference: float, indifference: float, cell_rows: int) -> DataFrame:
    """The same for queries too large for one task."""
    keyed = base.withColumn("k", F.coalesce(F.col("q").cast("string"), F.lit("\x00")))
    # five plans read the percentiles, so they are computed once
    pct = stage_table(percentiles(keyed, "k", "r", dict.fromkeys(names, True)), "percentiles")
    flow = flows(pct, preference, indifference, cell_rows)
    per_row = pct.select("q", "r", "name", "pct").join(flow.select("q", "name", "pct", "flow"), ["q", "name", "pct"])
    by_row = per_row.groupBy("q", "r").agg(*[F.max(F.when(F.col("name") == c, F.col("flow"))).alias(f"flow_{c}") for c in names]).withColumnsRenamed({"q": "k", "r": "r2"})
    joined = keyed.join(by_row, (keyed["k"] == by_row["k"]) & keyed["r"].eqNullSafe(by_row["r2"]), "left")
    return joined.select(keyed["q"], "r", *[f"flow_{c}" for c in names])


def outrank(df: DataFrame, query: str, row: str, scores: dict[str, tuple[bool, float]], preference: float = 0.5, indifference: float = 0.02, missing: str = "present", cell_rows: int = CELL_ROWS) -> DataFrame:
    """(query, row, net_flow, final_rank) of every row. scores: column -> (higher is better, weight)."""
    names = [f"s{i}" for i in range(len(scores))]
    weights = [float(w) for _, w in scores.values()]
    value = lambda c, up: F.nanvl(F.col(c).cast("double") if up else -F.col(c).cast("double"), F.lit(None).cast("double"))
    base = df.select(F.col(query).alias("q"), F.col(row).alias("r"), *[value(c, up).alias(n) for n, (c, (up, _)) in zip(names, scores.items(), strict=True)])
    hot = hot_groups(base.select("q"), ["q"], 0.0, cell_rows)
    parts = [(base, False)] if hot is None else [(base.join(hot.select("q"), same_keys(base, hot, ["q"]), how), how == "left_semi") for how in ("left_anti", "left_semi")]
    out = None
    for part, large in parts:
        got = flows_in_cells(part, names, preference, indifference, cell_rows) if large else flows_in_place(part, names, preference, indifference)
        has = [F.col(f"flow_{n}").isNotNull() for n in names]
        f = sum((F.when(h, F.col(f"flow_{n}") * w).otherwise(0.0) for h, n, w in zip(has, names, weights, strict=True)), F.lit(0.0))
        held = sum((F.when(h, w).otherwise(0.0) for h, w in zip(has, weights, strict=True)), F.lit(0.0))
        lacking = sum(weights) - held
        net = f / held if missing == "present" else (f - (lacking if missing == "last" else 0.0)) / sum(weights)
        some = has[0]
        for h in has[1:]:
            some = some | h
        got = got.select(F.col("q").alias(query), F.col("r").alias(row), F.when(some, F.round(net, 9)).alias("net_flow"))
        if large:
            ranked = exact_rank(got, [query], "net_flow", row, out="final_rank", sized_by=part.select(F.col("q").alias(query)))
        else:
            ranked = got.withColumn("final_rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc_nulls_last("net_flow"), F.col(row).asc_nulls_first())).cast("long"))
        ranked = ranked.select(query, row, "net_flow", F.col("final_rank").cast("long").alias("final_rank"))
        out = ranked if out is None else out.unionByName(ranked)
    return out
