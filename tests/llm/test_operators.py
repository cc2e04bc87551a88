"""The ten operators against brute force, exact round trips or held-out accuracy, with odd inputs."""

import functools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.llm import capping, knn, leakage, mixing, outranking, repeated_lines, residue, splitting
from webloom.llm import tokens as T

# --- 1: repeated lines


def test_repeated_lines_equal_brute_force(spark):
    rng = random.Random(5)
    pool = ["Share  this 5", "share this 77", "SHARE THIS 1", "By Ann", "x", "", " \t", "Long text " * 3]
    rows = []
    for i in range(400):
        domain = rng.choice(["hot", "hot", "hot", "b", "c", None])
        body = None if rng.random() < 0.03 else "\n".join(rng.choice(pool + [f"own {rng.random()}"]) for _ in range(rng.randrange(0, 8)))
        rows.append((i, f"u{rng.randrange(120)}" if rng.random() < 0.98 else None, domain, body, 1))
    pages = spark.createDataFrame(rows, "page_id long, url string, domain string, body_text string, line_no int")
    norm = lambda s: __import__("re").sub("[0-9]+", "0", " ".join(s.lower().split()))
    urls, seen = defaultdict(set), defaultdict(set)
    for i, u, d, b, _ in rows:
        if d is not None:
            urls[d].add(u if u is not None else str(i))
            for x in (b or "").split("\n") if b is not None else []:
                if norm(x):
                    seen[d, norm(x)].add(u if u is not None else str(i))
    often = {k for k, v in seen.items() if len(v) >= 6 and len(v) >= 0.05 * len(urls[k[0]])}
    want = {(i, n) for i, u, d, b, _ in rows if b is not None for n, x in enumerate(b.split("\n")) if (d, norm(x)) in often}
    frequent = repeated_lines.frequent_lines(pages)
    found = repeated_lines.found_lines(pages, frequent)
    assert {(r.row_id, r.line_no) for r in found.collect()} == want and want
    clean = {r.page_id: r.clean_text for r in repeated_lines.without_lines(pages, found).collect()}
    assert len(clean) == len(rows)
    for i, _, _, b, _ in rows:
        assert clean[i] == (None if b is None else "\n".join(x for n, x in enumerate(b.split("\n")) if (i, n) not in want))
    none = pages.limit(0)
    assert repeated_lines.found_lines(none, repeated_lines.frequent_lines(none)).count() == 0


# --- 2: residue


ARTICLE = "The council of the town met on Monday to talk about the bridge and its repair. \nThe work will take a year, and the road is closed until then. \nNobody in the town was sure how much it may cost."
BAD = [
    ("{{ title }}", ARTICLE), ("Fine", ARTICLE + "\nDear @@NAME@@, thank you for reading."), ("Fine", "Lorem ipsum dolor varis solent. magnor porrex vestra tempra."),
    ("404 Not Found", "Oops! That page has gone missing."), ("Fine", "You need to enable JavaScript to run this app.\nHome | News | Sport"), ("Your page title here", ARTICLE),
]
GOOD = [
    ("A bridge", ARTICLE), ("On templates", ARTICLE + "\nInside a template, `{{ city }}` prints the value of city for every reader of the page."), ("A bridge", ARTICLE + "\nFor the full view of x.example, switch on scripts in your browser settings."),
    (None, ARTICLE), ("JavaScript and the archive: a course", ARTICLE), ("Matrix", ARTICLE + "\nThe matrix {{32, 3}, {1, 7}} was shown to the class by the teacher."), (None, None), ("", ""),
]


def test_residue_on_unseen_hosts(spark):
    rng = random.Random(2)
    rows, want = [], set()
    for i in range(900):
        bad = rng.random() < 0.3
        title, body = rng.choice(BAD if bad else GOOD)
        if bad:
            want.add(i)
        rows.append((i, title, body, f"h{i % 40}.example", (rng.choice([200, 404, None]) if bad else 200,), "clash"))
    pages = spark.createDataFrame(rows, "page_id long, title string, body_text string, domain string, metadata struct<status_code:int>, score string")
    model = residue.train(pages, report=True)
    assert model.report["held_out_rows"] > 50 and model.report["precision"] > 0.95 and model.report["recall"] > 0.95
    assert {r.page_id for r in residue.residue_pages(pages).collect()} == want
    assert residue.residue_pages(pages.limit(0)).count() == 0
    only = spark.createDataFrame(rows[:1], pages.schema)
    assert residue.residue_pages(only).count() == (0 in want)


# --- 3: outranking


def brute_flow(values, preference, indifference):
    present = {i: v for i, v in values.items() if v is not None and not math.isnan(v)}
    n, xs = len(present), sorted(present.values(), reverse=True)
    pct = {i: 1 - (xs.index(v) + 1 + (xs.count(v) - 1) / 2 - 0.5) / n for i, v in present.items()}
    p = lambda d: min(1.0, max(0.0, (d - indifference) / (preference - indifference)))
    return {i: sum(p(a - b) - p(b - a) for b in pct.values()) / n for i, a in pct.items()}


@pytest.mark.parametrize("cell_rows", [50_000, 7])
def test_net_flow_equals_all_pairs(spark, monkeypatch, cell_rows):
    rng = random.Random(8)
    make = lambda: rng.choice([None, float("nan"), 1.0, 1.0, rng.random(), 1e9 * rng.random(), float("inf")])
    rows = [(q, i, make(), make(), rng.choice([None, rng.randrange(1, 60)]), 0.5) for q in (1, 2, None) for i in range(60 if q else 1)] + [(3, 0, None, None, None, 0.1)]
    df = spark.createDataFrame(rows, "q long, i long, a double, b double, r long, net_flow double")
    scores = {"a": (True, 1.0), "b": (True, 2.0), "r": (False, 1.0)}

    got = {(r.q, r.i): (r.net_flow, r.final_rank) for r in outranking.outrank(df, "q", "i", scores, 0.5, 0.02, cell_rows=cell_rows).collect()}
    assert len(got) == len(rows)
    for q in (1, 2):
        own = [r for r in rows if r[0] == q]
        parts = [(brute_flow({r[1]: (None if r[k] is None else s * float(r[k])) for r in own}, 0.5, 0.02), w) for k, s, w in ((2, 1, 1.0), (3, 1, 2.0), (4, -1, 1.0))]
        net = {}
        for r in own:
            w = sum(w for f, w in parts if r[1] in f)
            net[r[1]] = sum(f[r[1]] * w for f, w in parts if r[1] in f) / w if w else None
        order = sorted(net, key=lambda i: (net[i] is None, -(net[i] or 0), i))
        for i, v in net.items():
            assert (got[q, i][0] is None) == (v is None) and (v is None or abs(got[q, i][0] - v) < 1e-6)
        ranks = {i: got[q, i][1] for i in net}
        assert sorted(ranks.values()) == list(range(1, len(net) + 1))
        assert all(abs((net[a] or 0) - (net[b] or 0)) < 1e-6 or ranks[a] < ranks[b] for n, a in enumerate(order) for b in order[n + 1 :] if net[b] is not None)
    assert got[3, 0] == (None, 1) and outranking.outrank(df.limit(0), "q", "i", scores).count() == 0


def test_range_does_not_decide(spark):
    rows = [(1, i, float(i), 1e6 * float(-i)) for i in range(10)]
    df = spark.createDataFrame(rows, "q long, i long, a double, b double")
    got = outranking.outrank(df, "q", "i", {"a": (True, 1.0), "b": (True, 1.0)}).collect()
    assert {round(r.net_flow, 6) for r in got} == {0.0}


# --- 4: neighbours


def clustered(n, dim=64, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dim))
    x = np.vstack([base, base + 0.2 * rng.normal(size=base.shape), rng.normal(size=(n - 2 * len(base), dim))])
    return (x * rng.uniform(0.5, 2, size=(len(x), 1))).astype(np.float32)


def truth(x, k=10):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u.astype(np.float64) @ u.T.astype(np.float64)
    np.fill_diagonal(s, -9)
    return s, np.argsort(-s, axis=1, kind="stable")[:, :k]


def vectors_frame(spark, x, extra=()):
    rows = [(i, [float(v) for v in r], "clash") for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "id long, v array<float>, similarity string")


ODD = [(90_000, None, ""), (90_001, [0.0] * 64, ""), (90_002, [float("nan")] + [1.0] * 63, ""), (90_003, [1.0] * 32, ""), (90_004, [float("inf")] + [0.0] * 63, ""), (90_005, [None] + [1.0] * 63, "")]


@pytest.mark.parametrize("cell_rows", [4096, 100])
def test_mutual_pairs(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(knn, "CELL_ROWS", cell_rows)
    x = clustered(2400)
    s, top = truth(x)
    near = [set(t) for t in top]
    want = {(i, j) for i in range(len(x)) for j in top[i] if i < j and s[i, j] >= 0.9 and i in near[j]}
    got = {(r.id_a, r.id_b): r.similarity for r in knn.mutual_pairs(vectors_frame(spark, x, ODD), "id", "v", 0.9).collect()}
    assert set(got) <= want and len(set(got) & want) >= 0.98 * len(want) and len(want) > 300
    assert all(abs(got[p] - s[p]) < 1e-6 for p in got)


def test_neighbours_recall(spark):
    x = clustered(6000, seed=3)
    _, top = truth(x)
    got = defaultdict(set)
    for r in knn.neighbours(vectors_frame(spark, x, ODD), "id", "v", query_step=50).collect():
        got[r.id].add(r.other)
    asked = range(0, len(x), 50)
    assert set(got) == set(asked)
    assert sum(len(got[i] & set(top[i])) for i in asked) / (10 * len(asked)) >= 0.9


@pytest.mark.parametrize("cell_rows", [4096, 60])
def test_lists_divided_again(spark, monkeypatch, cell_rows):
    """Beyond MAX_LISTS coarse lists are divided; the work of a query stays that of a few lists of list_rows vectors."""
    monkeypatch.setattr(knn, "MAX_LISTS", 4)
    monkeypatch.setattr(knn, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(knn, "SPLIT_ROWS", 700)
    monkeypatch.setattr(knn, "fit", functools.partial(knn.fit, list_rows=128))
    x = clustered(6000, seed=3)
    s, top = truth(x)
    df = vectors_frame(spark, x, ODD)
    near = [set(t) for t in top]
    want = {(i, j) for i in range(len(x)) for j in top[i] if i < j and s[i, j] >= 0.9 and i in near[j]}
    got = {(r.id_a, r.id_b) for r in knn.mutual_pairs(df, "id", "v", 0.9).collect()}
    assert got <= want and len(got & want) >= 0.95 * len(want) and len(want) > 900
    by = defaultdict(list)
    for r in knn.neighbours(df, "id", "v", query_step=50).collect():
        by[r.id].append(r.other)
    assert set(by) == set(range(0, len(x), 50)) and all(len(v) == len(set(v)) == 10 for v in by.values())


def test_work_grows_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(knn, "MAX_LISTS", 4)
    pairs = []
    for n in (2_000, 4_000, 8_000):
        x = clustered(n, seed=5)
        rows = knn.usable(vectors_frame(spark, x), "id", "v", 64)
        index = knn.fit(rows, 64, 10, 4, 0.9, list_rows=64)
        plain = knn.index_of(index)
        cells = knn._celled(rows.mapInArrow(lambda it, plain=plain: knn._assigned(it, plain, 1), "list long, part long, role tinyint, id long, raw binary"), index)
        sides = cells.groupBy("cell").agg(F.sum((F.col("role").bitwiseAND(1) > 0).cast("long")).alias("d"), F.sum((F.col("role").bitwiseAND(2) > 0).cast("long")).alias("q"))
        pairs.append(sides.agg(F.sum(F.col("d") * F.col("q"))).first()[0])
    # pairs compared: doubling the rows about doubles them, far from four times
    assert pairs[1] < 2.8 * pairs[0] and pairs[2] < 2.8 * pairs[1]


def test_hot_copies_and_tiny_tables(spark):
    x = np.vstack([np.tile(np.arange(1, 65, dtype=np.float32), (400, 1)), clustered(100, seed=4)])
    got = {(r.id_a, r.id_b) for r in knn.mutual_pairs(vectors_frame(spark, x), "id", "v", 0.9).collect()}
    assert {(i, j) for i in range(11) for j in range(i + 1, 11)} == {p for p in got if p[1] < 400}
    by = defaultdict(dict)
    for r in knn.neighbours(vectors_frame(spark, x), "id", "v", query_step=1, probes=1.0).collect():
        by[r.id][r.place] = r.other
    assert [by[399][p] for p in range(1, 11)] == list(range(10)) and [by[3][p] for p in range(1, 11)] == [i for i in range(11) if i != 3]
    assert knn.mutual_pairs(vectors_frame(spark, x[:0], ODD), "id", "v", 0.9).count() == 0
    assert knn.neighbours(vectors_frame(spark, x[:1]), "id", "v").count() == 0


# --- 6: caps


def test_host_names(spark):
    names = ["A.Example", "www.a.example", " a.example. ", "a.example:443", "WWW.A.EXAMPLE:80", "https://a.example/x", "blog.a.example", "www.", None]
    got = [r.h for r in spark.createDataFrame([(n,) for n in names], "n string").select(capping.host_of(F.col("n")).alias("h")).collect()]
    assert got[:6] == ["a.example"] * 6 and got[6:] == ["blog.a.example", "www", None]


def test_over_count_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice(["h", "h", "g", None]), i, rng.choice([None, float("nan"), 1.0, rng.random()]), 7) for i in range(500)]
    df = spark.createDataFrame(rows, "q long, host string, id long, score double, level int")
    groups = defaultdict(list)
    for q, h, i, s, _ in rows:
        bad = s is None or math.isnan(s)
        groups[q, h].append((bad, 0 if bad else -s, i))
    want = {x[2] for g in groups.values() for x in sorted(g)[2:]}
    assert {r.id for r in capping.over_count(df, ["q"], "host", "score", "id", 2).collect()} == want
    assert capping.over_count(df.limit(0), ["q"], "host", "score", "id", 2).count() == 0


@pytest.mark.parametrize("share", [0.2, 0.34, 0.5, 1.0])
def test_share_levels_equal_search(spark, share):
    rng = random.Random(int(share * 100))
    rows, counts = [], defaultdict(Counter)
    for q in range(12):
        for h in range(rng.randrange(1, 9)):
            for _ in range(int(rng.paretovariate(0.7)) % 60 + 1):
                rows.append((q, f"h{h}", len(rows), rng.random()))
                counts[q][h] += 1
    df = spark.createDataFrame(rows, "q long, host string, id long, score double")
    got = {r.q: r.level for r in capping.share_levels(df, ["q"], "host", share).collect()}
    for q, c in counts.items():
        fits = [level for level in range(1, max(c.values()) + 1) if max(min(n, level) for n in c.values()) <= share * sum(min(n, level) for n in c.values()) + 1e-9]
        assert got[q] == (max(fits) if fits else 1), (q, c)
    kept = Counter((r.q, r.host) for r in capping.capped_by_share(df, ["q"], "host", "score", "id", share).collect())
    assert all(n == min(counts[q][int(h[1:])], got[q]) for (q, h), n in kept.items())


# --- 8: leaks

ITEM = "Apart from Tremuserk the mayor repeatedly monitored the pension fund in peculiar haste since 1985 and the deputy reviewed several dividend lists until Monday noon despite seasonal warehouse rules of the Société"
NOISE = "Few readers noticed that the network had combined a hidden patient for some samples of the town. "


def leak_case(k, changed=(), start=0):
    w = ITEM.split()[start : start + k]
    return " ".join("zzz" if i in changed else x for i, x in enumerate(w))


LEAKS = [
    (ITEM, True), (NOISE * 300 + ITEM.upper() + " " + NOISE, True), (leak_case(15), True), (leak_case(14), False), (leak_case(8), False), (leak_case(15, (5, 10)), True), (leak_case(18, (4, 9, 14)), True),
    (leak_case(15, (3, 7, 11)), False), (ITEM.replace(" ", "\n\n").replace("monitored", "<b>monitored</b>,"), True), (ITEM.replace("Société", "societe!"), True), (NOISE, False), (None, False), ("", False), ("  ", False),
    (leak_case(8) + " " + NOISE + leak_case(8, start=8), False),
]


@pytest.mark.parametrize("limit", [1 << 20, 100])
def test_leaks(spark, limit):
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(LEAKS)] + [(100, ITEM, "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "short item"), (4, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaked(docs, items, block_bytes=limit).collect()}
    assert got == {(i, 1) for i, (_, want) in enumerate(LEAKS) if want} | {(100, 1)}
    assert leakage.leaked(docs, items.limit(0), block_bytes=limit).count() == 0
    assert leakage.leaked(docs.limit(0), items, block_bytes=limit).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=40), st.lists(st.integers(1, 60), max_size=40), st.lists(st.integers(1, 60), min_size=4, max_size=20))
def test_winnowing_guarantee(a, b, shared):
    mix = lambda xs: np.array([x * 0x9E3779B97F4A7C15 % 2**64 for x in xs], np.uint64)
    one, two = leakage.fingerprints(mix(a + shared)), leakage.fingerprints(mix(shared + b))
    assert set(one[0].tolist()) & set(two[0].tolist())


def test_hot_phrase_and_giant_item(spark, monkeypatch):
    rng = random.Random(2)
    giant = [f"w{rng.randrange(9000)}" for _ in range(50_000)]
    hot = "one of the most of the one of the most of the one of the most"
    items = [(1, " ".join(giant))] + [(i, f"{hot} a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i} i{i} j{i} k{i} l{i} m{i} n{i} o{i} p{i}") for i in range(2, 300)]
    docs = [(1, " ".join(giant[31_000:31_015])), (2, " ".join(giant[40_000:40_014])), (3, f"{hot} " * 400 + items[7][1]), (4, " ".join(items[9][1].split()[14:])), (5, " ".join(giant)), (6, "of the one")]
    monkeypatch.setattr(leakage, "EXPANDED", 5_000)
    block = leakage.Items(items)
    got = set(block.found_in([t for _, t in docs]))
    assert got >= {(0, 1), (2, 8), (3, 10), (4, 1)} and not {t for t, _ in got} & {1, 5}
    # the hot phrase alone has 15 words, so documents that hold it whole hold a passage of every item with it
    assert {i for t, i in got if t == 2} == set(range(2, 300)) and {i for t, i in got if t == 3} == {10}
    monkeypatch.setattr(leakage, "EXPANDED", 1 << 40)
    monkeypatch.setattr(leakage, "TILE_ROWS", 1 << 40)
    monkeypatch.setattr(leakage, "TILE_DIAGONALS", 1 << 40)
    assert set(block.found_in([t for i, t in docs if i != 5])) == {(t - (t > 4), i) for t, i in got if t != 4}


# --- 9: mixing


def plain_sainte_lague(weights, seats, caps):
    got = dict.fromkeys(weights, 0)
    for _ in range(seats):
        open_ = [k for k in weights if weights[k] > 0 and got[k] < caps.get(k, seats)]
        if not open_:
            break
        got[max(open_, key=lambda k: (weights[k] / (2 * got[k] + 1), -k))] += 1
    return got


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=8), st.integers(0, 120), st.lists(st.integers(0, 40), min_size=8, max_size=8))
def test_sainte_lague_equals_the_plain_rule(ws, seats, caps):
    weights = {i: w / 7 for i, w in enumerate(ws)}
    limits = dict(enumerate(caps))
    assert mixing.sainte_lague(weights, seats, limits) == plain_sainte_lague(weights, seats, limits)


@pytest.mark.parametrize(("shards", "share"), [(1, 0.4), (40, 0.03), (40, 0.97), (300, 0.001), (300, 1.0)])
def test_shards_are_apportioned_as_by_the_plain_rule(spark, shards, share):
    rng = random.Random(shards)
    tokens = {("a", i): rng.choice([5, 700, 9_000, 9_100, 200_000]) for i in range(shards)} | {("b", i): 3_000 for i in range(7)}
    block = 64
    seats = {s: round(share * sum(t for (x, _), t in tokens.items() if x == s) / block) for s in "ab"}
    df = spark.createDataFrame([(s, i, t, seats[s]) for (s, i), t in tokens.items()], "source string, shard int, t long, seats long")
    got = {(r.source, r.shard): r.given for r in mixing.shard_seats(df, block).collect()}
    for s in "ab":
        own = {i: t for (x, i), t in tokens.items() if x == s}
        want = mixing.sainte_lague({i: float(t) for i, t in own.items()}, seats[s], {i: -(-t // block) for i, t in own.items()})
        assert {i: got[s, i] for i in own} == want


@pytest.mark.parametrize("shard_tokens", [4_000_000, 2_000])
def test_mixture_shares(spark, shard_tokens):
    rng = random.Random(6)
    rows = [(i, rng.choice(["big", "Big ", "BIG", "big", "big", "mid", "mid", "tiny", "extra", None]), " ".join(rng.choice(["storm", "harbour", "report"]) for _ in range(rng.randrange(1, 60)))) for i in range(3000)]
    rows += [(9001, "big", None), (9002, "big", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.3, 2), ("tiny", 0.2, 4), ("absent", 0.1, 2)], "source string, target_weight double, max_repeats int")
    m = mixing.mix(docs, targets, shard_tokens=shard_tokens, block=64)
    report = {r["source"]: r for r in m.report}
    for s in ("big", "mid", "tiny"):
        assert abs(report[s]["share"] - report[s]["share_of_available"]) < 0.02 and 0 < report[s]["most_repeats"] <= report[s]["max_repeats"]
    assert report["absent"]["tokens"] == 0 and set(report) == {"big", "mid", "tiny", "absent"}
    used = m.documents.collect()
    assert {r.source for r in used} == {"big", "mid", "tiny"} and len({r.doc_id for r in used}) == len(used)
    by = Counter()
    for r in used:
        assert r.n_tokens == T.count(dict((i, t) for i, _, t in rows)[r.doc_id]) if r.doc_id < 30 else True
        by[r.source] += r.n_tokens * r.repeats
    assert {s: by[s] for s in by} == {s: report[s]["tokens"] for s in by}
    again = mixing.mix(docs, targets, shard_tokens=shard_tokens, block=64).documents.collect()
    assert {(r.doc_id, r.repeats) for r in again} == {(r.doc_id, r.repeats) for r in used}
    assert mixing.mix(docs.limit(0), targets).documents.count() == 0 and mixing.mix(docs, targets.limit(0)).documents.count() == 0


# --- 10: splitting

WORDS = "the storm hit the harbour and the council met to talk about a report on costs".split()


def long_text(n, seed, kind="mixed"):
    rng = random.Random(seed)
    if kind == "wall":
        return "".join(rng.choice("abcdefghij") for _ in range(n * 4))
    if kind == "han":
        return "".join(rng.choice("的一是在不了有和人这中大为上个国我以要他时来用们") for _ in range(n))
    out = []
    for _ in range(n):
        out.append(rng.choice(WORDS) + rng.choice(["", "", "", "", ".", ",", ".\n", ".\n\n", " é", "  "]))
    return " ".join(out)


TEXTS = [None, "", "short", long_text(300, 1), long_text(4000, 2), long_text(20_000, 3), long_text(6000, 4, "wall"), long_text(5000, 5, "han"), "\n" * 9000, "x " * 3000]


def check_pieces(text, rows, plan):
    data = text.encode()
    rows = sorted(rows, key=lambda r: r.piece_no)
    assert [r.piece_no for r in rows] == list(range(len(rows)))
    assert rows[0].start_byte == 0 and rows[-1].end_byte == len(data)
    for n, r in enumerate(rows):
        assert data[r.start_byte : r.end_byte].decode() == r.text and T.count(r.text) == r.n_tokens <= plan.limit
        if n:
            before = rows[n - 1]
            lap = data[r.start_byte : before.end_byte].decode()
            assert r.start_byte < before.end_byte < r.end_byte and plan.overlap - 12 <= T.count(lap) <= plan.overlap + 12


@pytest.mark.parametrize("plan", [splitting.Plan(), splitting.Plan(range_bytes=10_000), splitting.Plan(limit=256, overlap=32, range_bytes=3_000)])
def test_pieces(spark, plan):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, piece_no int")
    want = {i for i, t in enumerate(TEXTS) if t and T.count(t) > plan.limit}
    by = defaultdict(list)
    for r in splitting.split_texts(docs, plan=plan).collect():
        by[r.doc_id].append(r)
    assert set(by) == want == {r.doc_id for r in splitting.oversized(docs, plan=plan).collect()}
    for i, rows in by.items():
        check_pieces(TEXTS[i], rows, plan)
    assert splitting.split_texts(docs.limit(0), plan=plan).count() == 0
    natural = [r for i in (4, 5) for r in by[i][:-1]]
    assert sum(TEXTS[r.doc_id].encode()[: r.end_byte].decode().rstrip(" ")[-1] in ".\n" for r in natural) >= 0.9 * len(natural)


WALLS = [*TEXTS[3:], "".join(random.Random(9).choice("ab,1'.!é的") for _ in range(60_000)), "a" * 30_000, ("x1'" * 9_000) + " " + "?" * 9_000, long_text(3000, 8, "wall") + "\n\n" + long_text(4000, 9)]


def test_the_size_of_ranges_changes_nothing(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(WALLS)), "doc_id long, text string")
    shown = lambda rows, k: {(r[k], r.piece_no, r.start_byte, r.end_byte, r.text) for r in rows.collect()}
    whole = shown(splitting.split_texts(docs, plan=splitting.Plan(range_bytes=1 << 20)), "doc_id")
    assert {i for i, *_ in whole} == {i for i, t in enumerate(WALLS) if T.count(t) > 2048}
    for size in (9_000, 16_384, 20_000):
        assert shown(splitting.split_texts(docs, plan=splitting.Plan(range_bytes=size)), "doc_id") == whole
    paths = []
    for i, t in enumerate(WALLS):
        (tmp_path / f"{i}.txt").write_text(t, newline="")
        paths.append(str(tmp_path / f"{i}.txt"))
    assert shown(splitting.split_files(spark, paths, splitting.Plan(range_bytes=20_000)), "file_no") == whole


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1'., \n\u00a0é的'sT", max_size=80), st.integers(0, 200))
def test_tokens_start_afresh(text, at):
    data = text.encode()
    a = splitting.fresh_start(lambda x, y: data[x:y], min(at, len(data)), len(data), halo=4)
    assert a >= min(at, len(data))
    assert T.encode(data[:a].decode()).tolist() + T.encode(data[a:].decode()).tolist() == T.encode(text).tolist()


def test_prefix_sums_in_blocks(spark):
    rows = spark.createDataFrame([(k, i, (i * 7) % 5) for k in (1, 2) for i in range(50)], "k long, i long, v long")
    got = {(r.k, r.i): r.s for r in splitting.prefix_sums(rows, "k", "i", "v", "s", block=8).collect()}
    assert got == {(k, i): sum((j * 7) % 5 for j in range(i)) for k in (1, 2) for i in range(50)}


def test_files(spark, tmp_path):
    paths = []
    for i, t in enumerate(TEXTS[4:8] + ["", "tiny"]):
        (tmp_path / f"{i}.txt").write_text(t, newline="")
        paths.append(str(tmp_path / f"{i}.txt"))
    plan = splitting.Plan(range_bytes=20_000)
    by = defaultdict(list)
    for r in splitting.split_files(spark, paths, plan).collect():
        by[r.file_no].append(r)
    assert set(by) == {0, 1, 2, 3}
    for i, rows in by.items():
        check_pieces(TEXTS[4 + i], rows, plan)
