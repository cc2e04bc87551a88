"""The k most similar vectors of every vector, by an adaptive dimension scan within probed lists.

Directions are partitioned into lists by spherical k-means fitted on a bounded sample (SAMPLE_PER_LIST
rows a list, MAX_LISTS lists). Beyond MAX_LISTS * list_rows vectors each of these coarse lists is divided again, into as many
lists as it has list_rows vectors, by k-means of its own over a sample of SUB_SAMPLE rows a list that stays
distributed; so lists keep their size however many vectors there are, and work grows with n log n. Every vector lies in the list of its nearest centroid and, as a query,
visits its `probes` nearest lists. Within a list, queries and vectors are rotated by one random orthogonal
matrix and compared in column blocks: after each block the partial squared distance, scaled up, is an
estimate of the whole one, and a hypothesis test drops the pairs whose estimate is too far beyond the
query's current k-th distance (or beyond `min_similarity`, if one is asked for). Survivors get their
cosine from the original values in double precision.

Work is spread by cells: a list that the sample shows to be larger than CELL_ROWS is cut into chunks of
queries by chunks of vectors, so no group is larger than that whatever the skew. Of exact copies only the
k + 1 with the smallest ids are scanned: by the tie rule (equal similarity: smaller id first) no other
copy can be among the k most similar of any vector, so nothing is lost and a hot copy costs nothing.

Defined results: null, zero, short, long, NaN or infinite vectors are unusable and appear nowhere; fewer
than k + 1 usable rows give fewer neighbours; repeated rows count as rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.session import stage_table

LIST_ROWS = 1024
MAX_LISTS = 4096
SAMPLE_PER_LIST = 64
CELL_ROWS = 4096
SUB_SAMPLE = 24
SPLIT_ROWS = 65_536
EPSILON = 2.1
PARTITION_BYTES = 8 << 20
BLOCKS = (16, 32, 64)


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray
    rotation: np.ndarray
    chunks: np.ndarray
    probes: int
    k: int
    min_similarity: float | None
    rows: int = 0
    # where the lists are divided again: (list, sub, centroid, chunks), how many sublists a query visits, and tasks a list is placed by
    sublists: DataFrame | None = None
    sub_probes: int = 1
    parts: np.ndarray | None = None


def usable(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, v): vectors of the right length with finite values and a norm."""
    v = F.col(vec_col)
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(v.isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), v.cast("array<float>").alias("v"))


def without_surplus_copies(rows: DataFrame, k: int) -> DataFrame:
    """rows without the copies that can't be anyone's neighbour: of equal vectors the k + 1 smallest ids stay."""
    keyed = rows.select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    many = keyed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1)
    if many.isEmpty():
        return rows
    copies = keyed.join(many.select("h1", "h2"), ["h1", "h2"])
    first = copies.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("r") <= k + 1).select("id")
    surplus = copies.select("id").join(first, "id", "left_anti")
    return rows.join(surplus, "id", "left_anti")


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    return (x / np.maximum(n, 1e-300)[:, None]).astype(np.float32)


def kmeans(sample: np.ndarray, lists: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; empty lists are moved onto the rows farthest from their centroid."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        best, near = np.empty(len(sample), np.int64), np.empty(len(sample), np.float32)
        for a in range(0, len(sample), 8192):
            s = sample[a : a + 8192] @ c.T
            best[a : a + 8192] = s.argmax(1)
            near[a : a + 8192] = s.max(1)
        sums = np.zeros_like(c, dtype=np.float64)
        np.add.at(sums, best, sample)
        empty = np.flatnonzero(np.bincount(best, minlength=lists) == 0)
        c = _unit(sums)
        if len(empty):
            c[empty] = sample[np.argsort(near)[: len(empty)]]
    return c


def probes_for(sample: np.ndarray, order: np.ndarray, home: np.ndarray, k: int, recall: float, queries: int = 512) -> int:
    """The fewest lists to visit for a share `recall` of the k nearest, measured on the sample by brute force.

    Neighbours within the sample lie farther off than those among all rows, so this errs to more lists.
    """
    lists = order.shape[1]
    if len(sample) < 2 or recall >= 1.0:
        return lists
    asked = np.arange(0, len(sample), max(1, len(sample) // queries))
    s = sample[asked] @ sample.T
    s[np.arange(len(asked)), asked] = -9
    m = min(k, len(sample) - 1)
    near = np.argpartition(-s, m - 1, axis=1)[:, :m]
    place = np.argsort(np.argsort(-order[asked], axis=1), axis=1)
    need = np.take_along_axis(place, home[near], axis=1).ravel()
    return int(np.searchsorted(np.cumsum(np.bincount(need, minlength=lists)) / need.size, recall) + 1)


def fit(rows: DataFrame, dim: int, k: int, probes: int | float, min_similarity: float | None = None, seed: int = 7, list_rows: int = LIST_ROWS) -> Index:
    """The lists and the rotation, from a hash sample of at most about SAMPLE_PER_LIST * lists rows.

    probes: how many lists a query visits, or as a float the recall to visit as many as the sample shows to need.
    """
    n = rows.count()
    lists = int(min(MAX_LISTS, max(1, n // list_rows)))
    want = max(lists * SAMPLE_PER_LIST, 256)
    drawn = rows if n <= want else rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * want / n) + 1)
    table = drawn.select("v").toArrow().column(0).combine_chunks()
    sample = _unit(np.asarray(table.flatten(), np.float32).reshape(-1, dim)) if len(table) else np.zeros((0, dim), np.float32)
    lists = max(1, min(lists, len(sample)))
    centroids = kmeans(sample, lists, seed) if len(sample) else np.eye(1, dim, dtype=np.float32)
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0].astype(np.float32)
    order = sample @ centroids.T
    home = order.argmax(1) if len(sample) else np.zeros(0, int)
    rows_in = np.bincount(home, minlength=lists) * (n / max(1, len(sample)))
    chunks = np.maximum(1, np.ceil(rows_in / CELL_ROWS)).astype(np.int64)
    visits = probes_for(sample, order, home, k, probes) if isinstance(probes, float) else max(1, probes)
    index = Index(centroids, rotation, chunks, min(visits, lists), k, min_similarity, n)
    if n // list_rows <= MAX_LISTS:
        return index
    return _divided(rows, index, rows_in, list_rows, seed)


def _divided(rows: DataFrame, index: Index, rows_in: np.ndarray, list_rows: int, seed: int) -> Index:
    """index with every list divided into lists of about list_rows vectors."""
    dim = index.centroids.shape[1]
    share = min(1.0, SUB_SAMPLE / list_rows)
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1_000_000)) < int(1_000_000 * share) + 1)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(np.asarray(batch.column(0).flatten(), np.float32).reshape(-1, dim))
            yield pa.RecordBatch.from_arrays([pa.array((x @ index.centroids.T).argmax(1)), batch.column(0)], names=["list", "v"])

    def divide(table: pa.Table) -> pa.Table:
        number = table.column("list")[0].as_py()
        x = _unit(np.asarray(table.column("v").combine_chunks().flatten(), np.float32).reshape(-1, dim))
        subs = int(np.clip(round(len(x) / SUB_SAMPLE), 1, len(x)))
        c = kmeans(x[: SUB_SAMPLE * MAX_LISTS], subs, seed, rounds=6)
        held = np.bincount((x @ c.T).argmax(1), minlength=subs) / share
        chunks = np.maximum(1, np.ceil(held / CELL_ROWS)).astype(np.int32)
        return pa.table({"list": pa.array(np.full(subs, number)), "sub": pa.array(np.arange(subs, dtype=np.int32)), "centroid": pa.array(list(c), pa.list_(pa.float32())), "chunks": pa.array(chunks)})

    placed = drawn.select("v").mapInArrow(homes, "list long, v array<float>")
    subs = placed.groupBy("list").applyInArrow(divide, "list long, sub int, centroid array<float>, chunks int")
    parts = np.maximum(1, np.ceil(rows_in / SPLIT_ROWS)).astype(np.int64)
    return replace(index, sublists=stage_table(subs, "sublists"), sub_probes=max(4, index.probes), parts=parts)


def _assigned(batches: Iterator[pa.RecordBatch], index: Index, query_step: int) -> Iterator[pa.RecordBatch]:
    """Every vector once for each coarse list it lies in or visits, with the task of the list it goes to."""
    dim = index.centroids.shape[1]
    for batch in batches:
        ids = batch.column(0).to_numpy()
        if not len(ids):
            continue
        x = np.ascontiguousarray(np.asarray(batch.column(1).flatten(), np.float32).reshape(-1, dim))
        s = _unit(x) @ index.centroids.T
        p = index.probes
        near = np.argpartition(-s, p - 1, axis=1)[:, :p] if p < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(ids), 1))
        home = s.argmax(1)
        asks = ids % query_step == 0
        r, j = np.nonzero(asks[:, None] & (near != home[:, None]))
        at = np.concatenate([np.arange(len(ids)), r])
        lists = np.concatenate([home, near[r, j]])
        roles = np.concatenate([np.where(asks, 3, 1), np.full(len(r), 2)]).astype(np.int8)
        mix = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        part = (mix[at] % index.parts[lists].astype(np.uint64)).astype(np.int64)
        raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(lists), pa.array(part), pa.array(roles), pa.array(ids[at]), raw.take(pa.array(at))], names=["list", "part", "role", "id", "raw"])


def _into_sublists(rows: pa.Table, subs: pa.Table, index: Index) -> pa.Table:
    """Rows of a coarse list in the cells of its sublists; a sublist larger than a cell is met chunk by chunk."""
    dim = index.centroids.shape[1]
    if not rows.num_rows:
        return pa.table({"cell": pa.array([], pa.int64()), "role": pa.array([], pa.int8()), "id": pa.array([], pa.int64()), "raw": pa.array([], pa.binary())})
    number = rows.column("list")[0].as_py()
    c = np.asarray(subs.column("centroid").combine_chunks().flatten(), np.float32).reshape(-1, dim) if subs.num_rows else np.zeros((1, dim), np.float32)
    order = np.argsort(subs.column("sub").to_numpy()) if subs.num_rows else np.zeros(1, int)
    g = subs.column("chunks").to_numpy().astype(np.int64)[order] if subs.num_rows else np.ones(1, np.int64)
    c = c[order]
    first = np.concatenate([[0], np.cumsum(g**2)])
    ids, role = rows.column("id").to_numpy(), rows.column("role").to_numpy()
    x = _unit(np.frombuffer(b"".join(rows.column("raw").to_pylist()), np.float32).reshape(-1, dim))
    s = x @ c.T
    home, p = s.argmax(1), min(index.sub_probes, len(c))
    near = np.argpartition(-s, p - 1, axis=1)[:, :p] if p < len(c) else np.tile(np.arange(len(c)), (len(ids), 1))
    mix = (ids.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)
    at, cells, roles = [], [], []

    def spread(r: np.ndarray, own: np.ndarray, kind: int) -> None:
        """Data meets all query chunks of its list, a query all data chunks."""
        n = g[own]
        rep = np.repeat(np.arange(len(r)), n)
        step = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
        mine = (mix[r] % n.astype(np.uint64)).astype(np.int64)
        at.append(r[rep])
        cells.append(first[own][rep] + (mine[rep] * n[rep] + step if kind == 1 else step * n[rep] + mine[rep]))
        roles.append(np.full(len(rep), kind))

    both = ((role & 3) == 3) & (near == home[:, None]).any(1) & (g[home] == 1)
    r = np.flatnonzero(both)
    at.append(r)
    cells.append(first[home[r]])
    roles.append(np.full(len(r), 3))
    r = np.flatnonzero(((role & 1) > 0) & ~both)
    spread(r, home[r], 1)
    r, j = np.nonzero(((role & 2) > 0)[:, None] & ~(both[:, None] & (near == home[:, None])))
    spread(r, near[r, j], 2)
    take = pa.array(np.concatenate(at))
    key = np.int64(number) * np.int64(1 << 40) + np.concatenate(cells).astype(np.int64)
    return pa.table({"cell": pa.array(key), "role": pa.array(np.concatenate(roles).astype(np.int8)), "id": rows.column("id").take(take), "raw": rows.column("raw").take(take)})


_CELL_DDL = "cell long, role tinyint, id long, raw binary"


def _celled(assigned: DataFrame, index: Index) -> DataFrame:
    spark, plain = assigned.sparkSession, index_of(index)
    parts = spark.createDataFrame([(i, int(n)) for i, n in enumerate(index.parts)], "list long, n int")
    subs = index.sublists.join(parts, "list").select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("part"), "sub", "centroid", "chunks")
    return assigned.groupBy("list", "part").cogroup(subs.groupBy("list", "part")).applyInArrow(lambda a, b: _into_sublists(a, b, plain), _CELL_DDL)


def index_of(index: Index) -> Index:
    """The index without its table, as it travels to tasks."""
    return replace(index, sublists=None)


def _cells(batches: Iterator[pa.RecordBatch], index: Index, query_step: int) -> Iterator[pa.RecordBatch]:
    """Every vector once for each cell it belongs to: role 1 vector, 2 query, 3 both."""
    dim = index.centroids.shape[1]
    first = np.concatenate([[0], np.cumsum(index.chunks**2)])
    for batch in batches:
        ids = batch.column(0).to_numpy()
        if not len(ids):
            continue
        x = np.asarray(batch.column(1).flatten(), np.float32).reshape(-1, dim)
        s = _unit(x) @ index.centroids.T
        p = index.probes
        near = np.argpartition(-s, p - 1, axis=1)[:, :p] if p < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(ids), 1))
        home = s.argmax(1)
        asks = ids % query_step == 0
        mix = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        rows, cells, roles = [], [], []
        # plain lists: one cell each
        g = index.chunks
        plain = g[home] == 1
        r = np.flatnonzero(plain)
        rows.append(r)
        cells.append(first[home[r]])
        roles.append(np.where(asks[r] & (near[r] == home[r, None]).any(1), 3, 1))
        q, j = np.nonzero(asks[:, None] & (g[near] == 1) & ~((near == home[:, None]) & plain[:, None]))
        rows.append(q)
        cells.append(first[near[q, j]])
        roles.append(np.full(len(q), 2))
        # lists cut into chunks: a vector meets all query chunks, a query all vector chunks
        for r in np.flatnonzero(~plain):
            n, own = g[home[r]], mix[r] % np.uint64(g[home[r]])
            rows.append(np.full(n, r))
            cells.append(first[home[r]] + int(own) * n + np.arange(n))
            roles.append(np.full(n, 1))
        for r, j in zip(*np.nonzero(asks[:, None] & (g[near] > 1)), strict=True):
            a = near[r, j]
            n, own = g[a], mix[r] % np.uint64(g[a])
            rows.append(np.full(n, r))
            cells.append(first[a] + np.arange(n) * n + int(own))
            roles.append(np.full(n, 2))
        at = np.concatenate(rows)
        raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(cells).astype(np.int64)), pa.array(np.concatenate(roles).astype(np.int8)), pa.array(ids[at]), raw.take(pa.array(at))],
            names=["cell", "role", "id", "raw"],
        )


def _augmented(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrices whose product is the squared distance of every row of q to every row of x."""
    one = lambda a: np.ones((len(a), 1), np.float32)
    sq = lambda a: np.einsum("ij,ij->i", a, a)[:, None]
    return np.hstack([q, sq(q), one(q)]), np.hstack([-2 * x, one(x), sq(x)])


def scan_cell(q: np.ndarray, x: np.ndarray, k: int, min_similarity: float | None, epsilon: float = EPSILON, rows: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query row, vector row) that pass every test, from rotated unit vectors; a superset of each query's k nearest but for the test's small error."""
    dim = q.shape[1]
    blocks = [b for b in BLOCKS if b < dim] + [dim]
    for a in range(0, len(q), rows):
        part = q[a : a + rows]
        if min_similarity is not None:
            bound = np.full(len(part), max(0.0, 2 - 2 * min_similarity) + 1e-4, np.float32)
        else:
            # the k-th distance among a few vectors bounds the k-th among all
            some = x[:: max(1, len(x) // 256)]
            d = _augmented(part, some)
            d = d[0] @ d[1].T
            bound = np.partition(d, k, axis=1)[:, k] + 1e-4 if d.shape[1] > k else np.full(len(part), 9.0, np.float32)
        low = blocks[0]
        left, right = _augmented(part[:, :low], x[:, :low])
        far = (bound * (low / dim) * (1 + epsilon / np.sqrt(low)) ** 2 + 1e-4) if low < dim else bound
        dist = left @ right.T
        i, j = np.nonzero(dist <= far[:, None])
        d = dist[i, j]
        for b in blocks[1:]:
            if len(i) == 0:
                break
            diff = np.empty(len(i), np.float32)
            for c in range(0, len(i), 1 << 16):
                s = slice(c, c + (1 << 16))
                e = part[i[s], low:b] - x[j[s], low:b]
                diff[s] = np.einsum("ij,ij->i", e, e)
            d = d + diff
            keep = d <= (bound[i] * (b / dim) * (1 + epsilon / np.sqrt(b)) ** 2 + 1e-4 if b < dim else bound[i])
            i, j, d, low = i[keep], j[keep], d[keep], b
        yield i + a, j


def _search(table: pa.Table, index: Index) -> pa.Table:
    dim = index.centroids.shape[1]
    role = table.column("role").to_numpy()
    ids = table.column("id").to_numpy()
    raw = np.frombuffer(b"".join(table.column("raw").to_pylist()), np.float32).reshape(-1, dim)
    unit = raw.astype(np.float64)
    unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
    spun = unit.astype(np.float32) @ index.rotation
    data, ask = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(data) and len(ask):
        for i, j in scan_cell(spun[ask], spun[data], index.k, index.min_similarity):
            a, b = ask[i], data[j]
            other = ids[a] != ids[b]
            a, b = a[other], b[other]
            sim = np.empty(len(a))
            for c in range(0, len(a), 1 << 16):
                s = slice(c, c + (1 << 16))
                sim[s] = np.einsum("ij,ij->i", unit[a[s]], unit[b[s]])
            if index.min_similarity is not None:
                near = sim >= index.min_similarity
                a, b, sim = a[near], b[near], sim[near]
            order = np.lexsort((ids[b], -sim, a))
            a, b, sim = a[order], b[order], sim[order]
            start = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.empty(0, int)
            place = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
            best = place < index.k
            out.append((ids[a[best]], ids[b[best]], sim[best]))
    cat = lambda n, t: np.concatenate([o[n] for o in out]).astype(t) if out else np.empty(0, t)
    return pa.table({"id": cat(0, np.int64), "other": cat(1, np.int64), "similarity": cat(2, np.float64)})


def _grouped(cells: DataFrame, index: Index, query_step: int):
    """cells grouped, over as many partitions as keep each at about PARTITION_BYTES whatever the number of rows."""
    row_bytes = 4 * index.centroids.shape[1] + 24
    visits = 1 + index.probes / query_step
    parts = -(-int(index.rows * visits * row_bytes) // PARTITION_BYTES)
    least = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(max(least, parts), "cell").groupBy("cell")


def candidates(rows: DataFrame, index: Index, query_step: int = 1) -> DataFrame:
    """(id, other, similarity): each asking vector's best k of every cell it visits. query_step: ids divisible by it ask."""
    plain = index_of(index)
    if index.sublists is not None:
        cells = _celled(rows.mapInArrow(lambda it: _assigned(it, plain, query_step), "list long, part long, role tinyint, id long, raw binary"), index)
    else:
        cells = rows.mapInArrow(lambda it: _cells(it, plain, query_step), _CELL_DDL)
    return _grouped(cells, index, query_step).applyInArrow(lambda t: _search(t, plain), "id long, other long, similarity double")


def neighbours(df: DataFrame, id_col: str, vec_col: str, dim: int = 64, k: int = 10, probes: int | float = 0.95, query_step: int = 1, seed: int = 7) -> DataFrame:
    """(id, other, similarity, place): the k most similar vectors of every asking vector."""
    rows = usable(df, id_col, vec_col, dim)
    index = fit(rows, dim, k, probes, seed=seed)
    scanned = without_surplus_copies(rows, k)
    # surplus copies still ask
    asking = rows.where(F.pmod("id", F.lit(query_step)) == 0).join(scanned.select("id"), "id", "left_anti") if scanned is not rows else None
    found = candidates(scanned, index, query_step)
    if asking is not None:
        plain = index_of(index)
        both = scanned.select("id", "v", F.lit(False).alias("asks")).unionByName(asking.select("id", "v", F.lit(True).alias("asks")))
        if index.sublists is not None:
            cells = _celled(both.mapInArrow(lambda it: _copies(it, plain, query_step, _assigned), "list long, part long, role tinyint, id long, raw binary"), index)
        else:
            cells = both.mapInArrow(lambda it: _copies(it, plain, query_step, _cells), _CELL_DDL)
        found = _grouped(cells, index, query_step).applyInArrow(lambda t: _search(t, plain), "id long, other long, similarity double")
    place = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)


def _copies(batches: Iterator[pa.RecordBatch], index: Index, query_step: int, place) -> Iterator[pa.RecordBatch]:
    """What `place` gives for scanned vectors, and for surplus copies as queries only."""
    for batch in batches:
        only = batch.column(2)
        for flag in (False, True):
            part = batch.filter(pa.compute.equal(only, flag)).select([0, 1])
            for out in place(iter([part]), index, query_step):
                if flag:
                    at = out.schema.get_field_index("role")
                    out = out.filter(pa.array((np.asarray(out.column(at)) & 2) > 0))
                    out = out.set_column(at, "role", pa.array(np.full(out.num_rows, 2, np.int8)))
                yield out


def mutual_pairs(df: DataFrame, id_col: str, vec_col: str, min_similarity: float, dim: int = 64, k: int = 10, probes: int | float = 4, seed: int = 7) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b: pairs of at least min_similarity, each among the k most similar of the other.

    Whatever is nearer than such a pair is at least as similar, so ranks among the found pairs are ranks
    among all rows.
    """
    rows = without_surplus_copies(usable(df, id_col, vec_col, dim), k)
    index = fit(rows, dim, k, probes, min_similarity, seed)
    found = candidates(rows, index)
    pairs = found.groupBy(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).agg(F.max("similarity").alias("similarity"))
    sides = pairs.select("id_a", "id_b", "similarity", F.inline(F.array(F.struct(F.col("id_a").alias("me"), F.col("id_b").alias("you")), F.struct(F.col("id_b").alias("me"), F.col("id_a").alias("you")))))
    place = Window.partitionBy("me").orderBy(F.desc("similarity"), "you")
    near = sides.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)
    return near.groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("n"), F.max("similarity").alias("similarity")).where("n = 2").drop("n")
