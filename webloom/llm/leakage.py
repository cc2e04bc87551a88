"""Evaluation texts inside training documents, by winnowed word fingerprints and extension of the hits.

Words are folded (case, accents, punctuation, mark-up and spacing don't count). Of every `WINDOW`
consecutive hashes of `K` words the smallest is kept, of items and documents alike, which guarantees a
common fingerprint for every shared run of WINDOW + K - 1 = 4 words. A run of at least 15 item words with
at least 5 in 6 unchanged always holds such runs: the changed words cut it into stretches of which at
least two fingerprints survive. Pairs with two hits near one diagonal are extended by a local alignment of
the item with the document along these diagonals and kept if one holds such a run.

The held-out items are a stated query set: they travel to the executors in blocks of about `block_bytes` of
text (one block for any common evaluation suite), and for each block the documents are fingerprinted, joined
with the block's fingerprints and extended in one narrow stage without a shuffle. Word hashes that no item of
the block has can't be hits and are never formed. A fingerprint that is frequent on both sides multiplies only
inside one Arrow batch, where hits are expanded in slices of at most EXPANDED rows, and alignments run in tiles,
so neither a hot phrase nor an item of any length needs more memory.

Defined results: null and empty texts have no words; repeated rows are found each; every hit item of a
document is reported once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 3
WINDOW = 2
MIN_RUN = 15
# a run of this length holds a shorter one, or the changes would be more than 1 in 6
LONGEST_RUN = 36
MIN_HITS = 2
DRIFT = 6
BLOCK_BYTES = 16 << 20
SLICE_BYTES = 8 << 20
EXPANDED = 1 << 21
TILE_ROWS, TILE_DIAGONALS = 4096, 128
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|&(?:nbsp|shy|zwj|zwnj|#\d{2,5});|[­​-‍⁠﻿]")
_INNER = re.compile(r"(?<=\w)['’`´](?=\w)")
_WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+")
_MARKS = re.compile(r"[̀-ͯ]+")


def words(text: str | None) -> list[str]:
    """The folded words of a text; a Han or Kana sign is a word of its own."""
    if not text:
        return []
    if "<" in text or "&" in text or not text.isascii():
        text = _TAG.sub(lambda m: "" if m.group()[0] in "&­​‌‍⁠﻿" and m.group() != "&nbsp;" else " ", text)
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.casefold())


def word_ids(tokens: list[str], ids: dict[str, int], grow: bool) -> np.ndarray:
    """64-bit word hashes; without grow, words that ids lacks are 0."""
    if grow:
        for w in set(tokens) - ids.keys():
            ids[w] = xxhash.xxh3_64_intdigest(w) or 1
    get = ids.get
    return np.array([get(w, 0) for w in tokens], dtype=np.uint64)


def fingerprints(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word position) of the winnowed K-grams. A gram with an unknown word (0) ranks last and is never kept."""
    n = len(w) - K + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    known = np.ones(n, bool)
    h = np.zeros(n, np.uint64)
    for i in range(K):
        part = w[i : i + n]
        known &= part != 0
        h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h[~known] = _NONE
    keep = np.zeros(n, bool)
    if n < WINDOW:
        keep[int(np.argmin(h))] = True
    for i in range(WINDOW):
        # the i-th place of a window is kept where it is the window's smallest
        m = n - WINDOW + 1
        if m <= 0:
            break
        smallest = np.ones(m, bool)
        for j in range(WINDOW):
            if j != i:
                smallest &= h[i : i + m] <= h[j : j + m]
        keep[i : i + m] |= smallest
    at = np.flatnonzero(keep & known)
    return h[at], at


def _tile_has_run(item: np.ndarray, doc: np.ndarray, first: int, last: int, low: int, high: int) -> bool:
    n, m, width = last - first, len(doc), high - low + 1
    at = np.arange(first, last)[:, None] + np.arange(low, high + 1)[None, :]
    same = (item[first:last, None] == doc[np.clip(at, 0, m - 1)]) & (at >= 0) & (at < m)
    most, step = LONGEST_RUN // 6 + 1, np.arange(width, dtype=np.int16)
    # changes of the best alignment from each item word to the word k further on, by the diagonal it is on
    changes = np.minimum.accumulate(np.where(same, 0, most).astype(np.int16) - step, axis=1) + step
    for k in range(1, min(n, LONGEST_RUN)):
        before = changes[: n - k]
        changes = before + ~same[k:]
        np.minimum(changes[:, :-1], before[:, 1:] + 1, out=changes[:, :-1])
        changes = np.minimum.accumulate(changes - step, axis=1) + step
        if k + 1 >= MIN_RUN and (same[k:] & (6 * changes <= k + 1)).any():
            return True
        if changes.min() >= most:
            return False
    return False


def has_run(item: np.ndarray, doc: np.ndarray, low: int, high: int, first: int = 0, last: int | None = None) -> bool:
    """Whether doc holds, in order, a run of MIN_RUN item words or more with 5 in 6 unchanged on the diagonals low to high.

    Local alignment from every item word (of `first` to `last`) at once: a replaced, left out or put in word is one
    change, runs begin and end with an unchanged word. A run of twice MIN_RUN unchanged words and more has a shorter
    one in it, so LONGEST_RUN words are as far as any must be followed, and its changes, each a diagonal at most,
    bound its drift: tiles that overlap by these miss nothing.
    """
    first, last = max(0, first), len(item) if last is None else min(last, len(item))
    low, high = max(low, -len(item)), min(high, len(doc))
    if last - first < MIN_RUN or not len(doc):
        return False
    for r in range(first, max(first + 1, last - MIN_RUN + 1), TILE_ROWS - LONGEST_RUN):
        for d in range(low, high + 1, TILE_DIAGONALS - 2 * DRIFT):
            if _tile_has_run(item, doc, r, min(last, r + TILE_ROWS), d, min(high, d + TILE_DIAGONALS - 1)):
                return True
    return False


def _clusters(keys: list[np.ndarray], x: np.ndarray, place: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, cluster of every ordered row, -1 to drop): rows of equal keys whose x lie within gap of the next, with MIN_HITS places or more."""
    order = np.lexsort((x, *reversed(keys)))
    new = np.append(True, np.diff(x[order]) > gap)
    for k in keys:
        new |= np.append(True, np.diff(k[order]) != 0)
    start = np.flatnonzero(new)
    p = place[order]
    several = np.maximum.reduceat(p, start) > np.minimum.reduceat(p, start)
    cluster = np.cumsum(new) - 1
    return order, np.where(several[cluster], cluster, -1)


class Items:
    """A block of held-out items with their words and a fingerprint table sorted by hash, then item."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.ids: dict[str, int] = {}
        self.names: list[int] = []
        self.words: list[np.ndarray] = []
        hashes, owners, places = [], [], []
        for item_id, text in rows:
            w = word_ids(words(text), self.ids, grow=True)
            h, at = fingerprints(w)
            hashes.append(h)
            owners.append(np.full(len(h), len(self.names), np.int64))
            places.append(at)
            self.names.append(item_id)
            self.words.append(w)
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes, dense = np.unique(h[order], return_inverse=True)
        self.place = np.concatenate(places)[order] if places else np.empty(0, np.int64)
        owner = np.concatenate(owners)[order] if owners else np.empty(0, np.int64)
        # one sorted key of hash and item, so that the rows of a hash and a range of items are a slice
        self.key = dense.astype(np.int64) * max(1, len(self.names)) + owner
        self.owner = owner

    def found_in(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(index of the text, item id) of every text that holds a run of an item."""
        if not len(self.hashes):
            return []
        docs = [word_ids(words(t), self.ids, grow=False) for t in texts]
        gap = np.zeros(K, np.uint64)
        starts = np.cumsum([0, *(len(w) + K for w in docs)])
        h, pos = fingerprints(np.concatenate([x for w in docs for x in (w, gap)])) if docs else (np.empty(0, np.uint64), np.empty(0, np.int64))
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        found: set[tuple[int, int]] = set()
        for part, low, high in self._slices(at[hit], pos[hit], 0, len(self.names)):
            self._extend(docs, starts, at[hit][part], pos[hit][part], low, high, found)
        return sorted((t, self.names[i]) for t, i in found)

    def _rows(self, at: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        n = max(1, len(self.names))
        return np.searchsorted(self.key, at * n + low), np.searchsorted(self.key, at * n + high)

    def _slices(self, at: np.ndarray, pos: np.ndarray, low: int, high: int) -> Iterator[tuple[slice, int, int]]:
        """Slices of the hits and ranges of items that expand to EXPANDED rows at most; slices overlap by the length of a run."""
        work = [(0, len(at), low, high)]
        reach = LONGEST_RUN + 2 * DRIFT
        while work:
            a, b, low, high = work.pop()
            if a == b:
                continue
            left, right = self._rows(at[a:b], low, high)
            if int((right - left).sum()) <= EXPANDED or (pos[b - 1] - pos[a] <= 2 * reach and high - low <= 1):
                yield slice(a, b), low, high
            elif pos[b - 1] - pos[a] > 2 * reach:
                half = (pos[a] + pos[b - 1]) // 2
                work.append((a, int(np.searchsorted(pos, half + reach, "right")), low, high))
                work.append((int(np.searchsorted(pos, half)), b, low, high))
            else:
                work += [(a, b, low, (low + high) // 2), (a, b, (low + high) // 2, high)]

    def _extend(self, docs: list[np.ndarray], starts: np.ndarray, at: np.ndarray, pos: np.ndarray, low: int, high: int, found: set[tuple[int, int]]) -> None:
        left, right = self._rows(at, low, high)
        times = right - left
        row = np.repeat(left - np.append(0, np.cumsum(times)[:-1]), times) + np.arange(int(times.sum()))
        if not len(row):
            return
        text = np.searchsorted(starts, pos, "right") - 1
        t, place, owner = np.repeat(text, times), self.place[row], self.owner[row]
        diagonal = np.repeat(pos - starts[text], times) - place
        # hits of one run lie within DRIFT diagonals and LONGEST_RUN words of each other
        order, cluster = _clusters([t, owner], diagonal, place, DRIFT)
        keep = cluster >= 0
        if not keep.any():
            return
        order, cluster = order[keep], cluster[keep]
        t, owner, diagonal, place = t[order], owner[order], diagonal[order], place[order]
        order, cluster = _clusters([cluster], place, place, LONGEST_RUN)
        order, cluster = order[cluster >= 0], cluster[cluster >= 0]
        if not len(order):
            return
        start = np.flatnonzero(np.append(True, np.diff(cluster) != 0))
        d, p = diagonal[order], place[order]
        bounds = [f.reduceat(x, start).tolist() for x, f in ((d, np.minimum), (d, np.maximum), (p, np.minimum), (p, np.maximum))]
        for doc, item, d0, d1, p0, p1 in zip(t[order][start].tolist(), owner[order][start].tolist(), *bounds, strict=True):
            if (doc, item) not in found and has_run(self.words[item], docs[doc], d0 - DRIFT, d1 + DRIFT, p0 - LONGEST_RUN, p1 + K + LONGEST_RUN):
                found.add((doc, item))


def _scan(items: Items, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.cumsum(pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
        cuts = np.unique(np.searchsorted(sizes, np.arange(SLICE_BYTES, int(sizes[-1]) if len(sizes) else 0, SLICE_BYTES), "right"))
        edges = [0, *(int(c) for c in cuts if 0 < c < batch.num_rows), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            part = batch.slice(a, b - a)
            ids = part.column(0).to_pylist()
            found = items.found_in(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([ids[t] for t, _ in found], pa.int64()), pa.array([i for _, i in found], pa.int64())], names=["doc_id", "item_id"])


def leaked(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id): every document that holds a passage of an item. Each block of items costs one scan of the documents."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null and text <> ''")
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("text is not null and text <> ''")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // max(1, block_bytes)))
    out = None
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        shared = docs.sparkSession.sparkContext.broadcast(Items([(r.item_id, r.text) for r in own.collect()]))
        part = docs.mapInArrow(lambda it, shared=shared: _scan(shared.value, it), "doc_id long, item_id long")
        out = part if out is None else out.unionAll(part)
    return out if blocks == 1 else out.distinct()
