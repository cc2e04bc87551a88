import math
import random

from webloom.operators.group_rank import exact_rank, hot_groups


def brute(rows):
    out, groups = {}, {}
    for g, i, s in rows:
        groups.setdefault(g, []).append((s is None or math.isnan(s), 0.0 if s is None or math.isnan(s) else -s, i))
    for g, xs in groups.items():
        for n, (_, _, i) in enumerate(sorted(xs), 1):
            out[g, i] = n
    return out


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "g string, i long, s double")
    got = {(r.g, r.i): r.r for r in exact_rank(df, ["g"], "s", "i", "r", **options).collect()}
    assert got == brute(rows)


def test_small_and_hot_groups_agree(spark):
    rng = random.Random(3)
    rows = []
    for i in range(6000):
        g = rng.choice(["hot", "hot", "hot", "a", "b", None])
        s = rng.choice([None, float("nan"), 0.5, 0.5, rng.random(), round(rng.random(), 1), float("inf"), float("-inf")])
        rows.append((g, i, s))
    check(spark, rows)
    check(spark, rows, share=0.01, floor=100)


def test_one_tied_score_is_cut_by_the_tie(spark):
    check(spark, [("hot", i, 1.0) for i in range(3000)], share=0.01, floor=100)
    check(spark, [("hot", i, None) for i in range(3000)], share=0.01, floor=100)


def test_empty(spark):
    check(spark, [])
    df = spark.createDataFrame([], "g string")
    assert hot_groups(df, ["g"]) is None
