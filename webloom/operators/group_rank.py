"""Exact ranks within groups of which a few may hold a large part of all rows.

A window over a group puts the whole group into one task. Groups above a share of all rows (there can be
at most 1/share of them) are therefore cut into cells by approximate quantiles of the score and, inside
one tied score, of the tie column; a row's rank is its rank within the cell plus the rows of the cells
before it. The result is exact; the quantiles only balance the work.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOT_SHARE = 0.001
HOT_FLOOR = 50_000
CELLS = 64


def hot_groups(df: DataFrame, keys: list[str], share: float = HOT_SHARE, floor: int = HOT_FLOOR) -> DataFrame | None:
    """Groups with more than `floor` rows and more than `share` of all rows: at most 1/share rows; None if there are none."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    big = [r for r in counts.where(F.col("__n") > floor).agg(F.sum("__n").alias("s"), F.max("__n").alias("m")).collect()]
    if not big[0]["s"]:
        return None
    total = df.count()
    hot = counts.where((F.col("__n") > floor) & (F.col("__n") > share * total))
    return hot if big[0]["m"] > share * total else None


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]):
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def exact_rank(df: DataFrame, keys: list[str], score: str, tie: str, out: str = "rank_in_group", share: float = HOT_SHARE, floor: int = HOT_FLOOR, sized_by: DataFrame | None = None) -> DataFrame:
    """Add `out`: 1, 2, ... within `keys` by score descending, null and NaN last, then tie ascending.

    tie must be a number and unique within its group for the order to be fixed; a null tie comes first.
    sized_by: a cheaper frame with the same groups and sizes, to find the large ones in.
    """
    value = F.col(score).cast("double")
    bad = value.isNull() | F.isnan(value)
    df = df.withColumns({"__bad": bad, "__v": F.when(~bad, -value)})
    order = [F.col("__bad"), F.col("__v"), F.col(tie).asc_nulls_first()]
    hot = hot_groups(df if sized_by is None else sized_by, keys, share, floor)
    if hot is None:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).drop("__bad", "__v")
    hot = hot.select(*keys)
    points = [i / CELLS for i in range(1, CELLS)]
    narrow = df.select(*keys, "__bad", "__v", F.col(tie).cast("double").alias("__t"))
    edges = (
        narrow.join(F.broadcast(hot), same_keys(narrow, hot, keys), "left_semi")
        .groupBy(*keys)
        .agg(
            F.percentile_approx(F.when(~F.col("__bad"), F.col("__v")), points, 10_000).alias("__ve"),
            F.percentile_approx("__t", points, 10_000).alias("__te"),
        )
    )
    edges = edges.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__ve", "__te")
    on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(edges[f"__k{i}"]) for i, k in enumerate(keys)])
    cut = df.join(F.broadcast(edges), on, "left").drop(*[f"__k{i}" for i in range(len(keys))])
    below = lambda xs, x: F.size(F.filter(xs, lambda e: e < x))
    at_edge = F.array_contains("__ve", F.col("__v"))
    cell = F.when(F.col("__te").isNull(), F.lit(0)).when(F.col("__bad") | F.col("__ve").isNull(), 2 * CELLS + 2)
    cell = cell.otherwise(2 * below(F.col("__ve"), F.col("__v")) + F.when(at_edge, 1).otherwise(0))
    one_value = F.col("__bad") | at_edge
    cell2 = F.when(F.col("__te").isNotNull() & one_value & F.col(tie).isNotNull(), below(F.col("__te"), F.col(tie).cast("double"))).otherwise(0)
    cut = cut.withColumns({"__a": cell, "__b": cell2, "__hot": F.col("__te").isNotNull()}).drop("__ve", "__te")
    cells = [*keys, "__a", "__b"]
    sizes = cut.where("__hot").groupBy(*cells).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__a", "__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(k).alias(f"__c{i}") for i, k in enumerate(cells)], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = cut.withColumn("__r", F.row_number().over(Window.partitionBy(*cells).orderBy(*order)))
    on = reduce(lambda a, b: a & b, [ranked[k].eqNullSafe(offsets[f"__c{i}"]) for i, k in enumerate(cells)])
    return (
        ranked.join(offsets, on, "left")
        .withColumn(out, (F.col("__r") + F.coalesce("__before", F.lit(0))).cast("long"))
        .drop("__r", "__before", "__bad", "__v", "__a", "__b", "__hot", *[f"__c{i}" for i in range(len(cells))])
    )
