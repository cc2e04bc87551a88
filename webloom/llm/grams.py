"""Hashed n-grams of words and token shapes, and a logistic regression over them."""

from __future__ import annotations

import re

import numpy as np
import xxhash

BITS = 20
# Fixed value: chi-squared of one degree of freedom at a chance of 1 in 1,000.
LEAST_CHI = 10.83
MIX = np.uint64(0x9E3779B97F4A7C15)
TOKEN = re.compile(r"[^\W\d_]+|\d+|\n+|_+|[^\w\s]+")


_PLAIN = frozenset([".", ",", "\n", ";", ":", "-", "!", "?", "'", '"', "(", ")", "’", "–", "|", ">", "/", "·", "*", "•"])
_CACHE = 500_000
_RARE = np.uint64(1 << 63)


class _Vocabulary(dict):
    """token -> row of the table of hashes: word, shape (the highest bit tells signs that running text lacks) and kind."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int]] = []
        self.table = np.empty((0, 3), np.uint64)

    def __missing__(self, token: str) -> int:
        h = lambda x: xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) or 1
        if token[0] == "\n":
            word = shape = "\n"
        elif token[0].isdigit():
            word = shape = "0"
        elif token[0].isalpha():
            word = token.lower()
            shape = "A" if token.isupper() and len(token) > 1 else "Aa" if token[0].isupper() else "a"
        else:
            word = shape = token[:4]
        rare = not (token[0].isalnum() or token in _PLAIN)
        kind = "S" if rare else "w" if token[0].isalpha() else shape
        self.rows.append((h(word), h("sign " + shape) | (1 << 63) if rare else h("shape " + shape) >> 1, h("kind " + kind)))
        self[token] = n = len(self.rows) - 1
        return n

    def hashes(self, tokens: list[str]) -> np.ndarray:
        """Rows: hashes of words, shapes and kinds. A cache that grew too large is begun anew; hashes depend on the token alone."""
        if len(self) > _CACHE:
            self.clear()
            self.rows = []
            self.table = np.empty((0, 3), np.uint64)
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        if len(self.table) < len(self.rows):
            self.table = np.concatenate([self.table, np.array(self.rows[len(self.table) :], np.uint64)])
        return self.table[at].T


_KNOWN = _Vocabulary()


def _mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return (a * MIX) ^ (b + (a >> np.uint64(31)))


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes * MIX >> np.uint64(64 - BITS)).astype(np.int64)


class Texts:
    """Texts as one row of tokens, so that n-grams of all of them are formed at once."""

    def __init__(self, texts: list[str]) -> None:
        found = [TOKEN.findall(t) for t in texts]
        self.n = len(texts)
        self.size = np.fromiter(map(len, found), np.int64, self.n)
        self.first = np.cumsum(self.size) - self.size
        self.of = np.repeat(np.arange(self.n), self.size)
        self.w, self.s, self.kinds = _KNOWN.hashes([t for f in found for t in f])
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, hashes: np.ndarray, owner: np.ndarray) -> None:
        self.parts.append((slots(hashes), owner))

    def runs(self, stream: np.ndarray, longest: int) -> list[np.ndarray]:
        """Hashes of the runs of 2, 3, ... tokens that begin at each token, and whether they stay within their text."""
        out, run = [], stream
        for n in range(1, longest):
            run = _mix(run[:-1], stream[n:])
            out.append((run, self.of[: len(run)] == self.of[n:]))
        return out

    def scores(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum of weights, number of slots) of every text."""
        total, count = np.zeros(self.n), np.zeros(self.n)
        for slot, owner in self.parts:
            total += np.bincount(owner, weights[slot], self.n)
            count += np.bincount(owner, minlength=self.n)
        return total, count

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(slot, text) with every slot of a text once, ordered by text."""
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        key = np.sort(np.concatenate([(owner << BITS) | slot for slot, owner in self.parts]))
        key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
        return key & ((1 << BITS) - 1), key >> BITS

    def lists(self, distinct: bool) -> list[np.ndarray]:
        """The slots of each text."""
        if distinct:
            slot, owner = self.distinct()
        else:
            slot = np.concatenate([p for p, _ in self.parts]) if self.parts else np.empty(0, np.int64)
            owner = np.concatenate([o for _, o in self.parts]) if self.parts else np.empty(0, np.int64)
            order = np.argsort(owner, kind="stable")
            slot, owner = slot[order], owner[order]
        return np.split(slot, np.searchsorted(owner, np.arange(1, self.n)))


def lines(texts: list[str], ended: list[bool]) -> Texts:
    """Slots of lines: words and runs of two and three, how they begin and end, their shape and length."""
    t = Texts(texts)
    some = np.flatnonzero(t.size)
    if not len(some):
        return t
    t.add(t.w, t.of)
    runs = t.runs(t.w, 3)
    for run, inside in runs:
        t.add(run[inside], t.of[: len(run)][inside])
    first = t.first[some]
    t.add(_mix(t.w[first], np.uint64(5)), some)
    t.add(_mix(t.w[first + t.size[some] - 1], np.uint64(6)), some)
    two = t.size[some] > 1
    t.add(_mix(runs[0][0][first[two]], np.uint64(7)), some[two])
    begin, own, at = t.s[first], some, first
    for n in range(1, 4):
        more = t.size[own] > n
        begin, own, at = _mix(begin[more], t.s[at[more] + n]), own[more], at[more]
        t.add(_mix(begin, np.uint64(20 + n)), own)
    size = np.minimum(np.array([int(n).bit_length() for n in t.size[some]], np.int64), 9)
    end = np.array(ended, np.int64)[some]
    stops = np.array([min(texts[i].count(". "), 3) for i in some], np.int64)
    upper, lower = (np.array([getattr(texts[i], f)() for i in some], np.int64) for f in ("isupper", "islower"))
    for x in (100 + size, 120 + end, 140 + 2 * size + end, 300 + stops, 400 + upper, 410 + lower):
        t.add(x.astype(np.uint64) * MIX, some)
    return t


def pages(texts: list[str], part: int, bucket: np.ndarray | None = None) -> Texts:
    """Slots of the words and runs of two and three of texts and of shapes around signs that running text lacks; words and pairs once more with a bucket."""
    t = Texts(texts)
    salt = np.uint64(part)
    t.add(t.w + salt, t.of)
    runs = t.runs(t.w, 3)
    for run, inside in runs:
        t.add(run[inside] + salt, t.of[: len(run)][inside])
    sign = t.s >= _RARE
    for stream in (t.s, t.kinds):
        has = sign
        for run, inside in t.runs(stream, 5):
            has = has[: len(run)] | sign[len(sign) - len(run) :]
            keep = has & inside
            t.add(run[keep] + salt, t.of[: len(run)][keep])
    if bucket is not None:
        at = (1000 + bucket).astype(np.uint64)
        t.add(_mix(t.w, at[t.of]), t.of)
        run, inside = runs[0] if runs else (t.w[:0], np.empty(0, bool))
        t.add(_mix(run[inside], at[t.of[: len(run)][inside]]), t.of[: len(run)][inside])
    return t


def minimise(f, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking; f gives value and gradient."""
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, kept = g.copy(), []
        for s, y, r in reversed(past):
            a = r * (s @ q)
            kept.append(a)
            q -= a * y
        if past:
            s, y, r = past[-1]
            q *= 1 / (r * (y @ y))
        for (s, y, r), a in zip(past, reversed(kept), strict=True):
            q += (a - r * (y @ q)) * s
        slope, t = -(g @ q), 1.0 if past else 1 / max(1e-12, np.sqrt(g @ g))
        while True:
            there = x - t * q
            new, h = f(there)
            if new <= value + 1e-4 * t * slope or t < 1e-10:
                break
            t /= 2
        s, y = there - x, h - g
        if value - new < 1e-7 * max(1.0, abs(value)):
            return there if new < value else x
        if s @ y > 1e-12:
            past = [*past, (s, y, 1 / (s @ y))][-memory:]
        x, value, g = there, new, h
    return x


def fit(rows: list[tuple[np.ndarray, int]], steps: int = 100, ridge: float = 5e-4) -> tuple[np.ndarray, float]:
    """Logistic regression with L2 and balanced classes on slots scaled by their log ratio between the classes; the same result every time."""
    y = np.array([r[1] for r in rows], np.float64)
    idx = np.concatenate([r[0] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    size = 1 << BITS
    pos, neg = np.bincount(idx, y[row], size), np.bincount(idx, 1 - y[row], size)
    ratio = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((neg + 0.5) / ((1 - y).sum() + 1))
    # chance alone links rare n-grams to a class: only those stay whose link is beyond doubt
    n, seen = len(y), pos + neg
    expected = seen * y.sum() / n
    chi = (pos - expected) ** 2 / np.maximum(expected * (1 - y.mean()) * (1 - seen / n), 1e-12)
    ratio[(seen < 3) | (chi < LEAST_CHI)] = 0.0
    keep = ratio[idx] != 0
    idx, row = idx[keep], row[keep]
    used, at = np.unique(idx, return_inverse=True)
    scale = ratio[used] / 10
    cost = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = x[:-1], x[-1]
        z = np.bincount(row, (w * scale)[at], len(rows)) + b
        m = np.where(y == 1, -z, z)
        value = (cost * np.logaddexp(0, m)).sum() + ridge * (w @ w) / 2
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * cost
        return value, np.append(np.bincount(at, d[row], len(used)) * scale + ridge * w, d.sum())

    x = minimise(loss, np.zeros(len(used) + 1), steps)
    out = np.zeros(size, np.float32)
    out[used] = x[:-1] * scale
    return out, float(x[-1])
