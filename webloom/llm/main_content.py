"""Main content of a page by the distribution of its text over lines.

Markup is stripped to lines; a line that ends as a sentence weighs its length times the chance that its words are
those of an article; the weights are summed over a sliding window of lines. A block surges where a window first
reaches a share of the page's largest sum (`SURGE_SHARE`) and dives where no window through the line does any
more; between these points the lines whose own weight is more likely than not to be an article's are kept, with the
headings that lead them. In HTML the block must lie in the container with most text, which shuts out a stray sentence
of a sidebar.

The chance comes from the structure of HTML pages and from no list of phrases: lines inside the container that holds most
of a page's running text against the lines outside it teach a logistic regression over hashed n-grams, shapes and
lengths of lines (`fit_weights`, on at most about `SAMPLE_PAGES` pages). What it has learned weighs lines of plain-text
pages as well. Without a model every sentence weighs its length. A page is handled as a whole by one Python call
inside Arrow batches; there is no shuffle.

Defined results: null, empty or unparsable bodies and pages without any article text give no lines; repeated lines of
a page count once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import grams
from webloom.llm.page_lines import blanks, collapse, ended, is_filler, is_list_of_words, is_numbered, unmarked
from webloom.sources import markup

WINDOW = 3
# Sums below this share of a page's largest are no block; pages and lines that teach the weights.
SURGE_SHARE = 0.15
SAMPLE_PAGES = 4_000
PAGES, KNOWN_LINES = 256, 1 << 16
LEAST_MAIN = 400
# The share of taught headings that may fall below the score that keeps them; lines outside that score
# above this share of the article's are no examples in the next round.
HEADING_LOST, LIKE_ARTICLE, ROUNDS = 0.02, 0.015, 4
_ASIDE_TAGS = frozenset("nav aside footer dialog form".split())
_ASIDE_NAME = re.compile(
    r"(?:^|[\s_-])(?:nav|menu|sidebar|side|footer|foot|bottom|cookie|consent|promo|share|social|related|recommend|more|teaser|advert|ads?|banner|comments?|newsletter|breadcrumbs?|legal)(?:$|[\s_-])",
    re.I,
)
_STRUCTURE = frozenset("#root html body div section article main header footer nav aside td th form details dialog center".split())
_HEADING = re.compile(r"h[1-6]")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


@dataclass(frozen=True)
class LineModel:
    weights: np.ndarray
    bias: float
    text_from: float
    heading_from: float

    def scores(self, lines: list[str]) -> np.ndarray:
        return mean_scores(self.weights, self.bias, line_grams(lines))

    def chance(self, line: str) -> float:
        """From 0 to 1, how likely an ended line is an article's; 0.5 at the score that parts the taught lines best."""
        return float(np.clip(0.5 + 5 * (self.scores([line])[0] - self.text_from), 0, 1))


def line_grams(lines: list[str]) -> grams.Texts:
    return grams.lines([unmarked(x) for x in lines], [ended(x) for x in lines])


def mean_scores(weights: np.ndarray, bias: float, texts: grams.Texts) -> np.ndarray:
    """Log odds over the root of the number of n-grams, so that long lines aren't surer by their length alone."""
    total, count = texts.scores(weights)
    return (total + bias) / np.sqrt(np.maximum(1.0, count))


def is_text(line: str) -> bool:
    return ended(line) and len(_WORD.findall(line)) >= 4


def _may_head(line: str) -> bool:
    """Three words or more, the unfilled blanks of a template not counted."""
    for m in blanks(line):
        line = line.replace(m.group(), " ")
    return sum(any(c.isalpha() for c in w) for w in line.split()) >= 3


class _Judge:
    """(weight, may head) of lines. Furniture comes back on page after page, so what was judged is kept and the new lines of a batch are judged at once."""

    def __init__(self, model: LineModel | None) -> None:
        self.model = model
        self.known: dict[str, tuple[float, bool]] = {}

    def learn(self, raws: Iterable[str]) -> None:
        if len(self.known) > KNOWN_LINES:
            self.known = {}
        new = [r for r in dict.fromkeys(raws) if r not in self.known]
        lines = [collapse(r) for r in new]
        texts = [bool(x) and is_text(x) for x in lines]
        heads = [bool(x) and not t and not is_list_of_words(r) and not is_numbered(x) and _may_head(x) for r, x, t in zip(new, lines, texts, strict=True)]
        asked = [i for i in range(len(new)) if texts[i] or heads[i]]
        score = self.model.scores([lines[i] for i in asked]) if self.model is not None and asked else None
        for r in new:
            self.known[r] = (0.0, False)
        for k, i in enumerate(asked):
            if heads[i]:
                self.known[new[i]] = (0.0, score is None or bool(score[k] >= self.model.heading_from))
            elif not is_filler(lines[i]):
                chance = 1.0 if score is None else min(1.0, max(0.0, 0.5 + 5 * (score[k] - self.model.text_from)))
                self.known[new[i]] = (len(lines[i]) * chance, False)

    def __call__(self, raw: str) -> tuple[float, bool]:
        if raw not in self.known:
            self.learn([raw])
        return self.known[raw]


def dense(weights: list[float], window: int = WINDOW, share: float = SURGE_SHARE) -> list[bool]:
    """Whether a line lies in a window whose sum reaches the page's threshold, a share of its largest sum."""
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    least = share * max(sums, default=0.0)
    return [least > 0 and any(s >= least for s in sums[max(0, i - window + 1) : i + 1]) for i in range(len(weights))]


def blocks(weights: list[float], window: int = WINDOW, share: float = SURGE_SHARE) -> list[tuple[int, int]]:
    """Stretches [surge, dive) of lines in dense windows, cut to the first and last line with a weight."""
    found, start = [], None
    inside = [*dense(weights, window, share), False]
    for i, here in enumerate(inside):
        if here and start is None:
            start = i
        if not here and start is not None:
            own = [j for j in range(start, i) if weights[j] > 0]
            if own:
                found.append((own[0], own[-1] + 1))
            start = None
    return found


def kept(lines: list[str], weights: list[float], may_head: list[bool], window: int = WINDOW, share: float = SURGE_SHARE) -> list[int]:
    """Indexes of the lines that are kept: those of the blocks that weigh half their length or more, with their headings."""
    order = [i for i, x in enumerate(lines) if x]
    heavy = [weights[i] >= 0.5 * len(lines[i]) > 0 for i in order]
    found = blocks([weights[i] for i in order], window, share)
    out: list[int] = []
    done = 0
    for a, b in found:
        text = [j for j in range(a, b) if heavy[j]]
        if not text:
            continue
        # headings lead text or follow the last of it: those inside the block, and those within a window of it
        first = min([j for j in range(max(done, text[0] - window), text[0]) if may_head[order[j]]], default=text[0])
        last = max([j for j in range(text[-1] + 1, min(len(order), text[-1] + 1 + window)) if may_head[order[j]]], default=text[-1])
        out += [order[j] for j in range(first, last + 1) if (a <= j < b and heavy[j]) or may_head[order[j]]]
        done = last + 1
    return out


def main_lines(body: str | None, judge: _Judge | None = None, window: int = WINDOW, share: float = SURGE_SHARE) -> list[int]:
    """Indexes of the main-content lines of a body already turned to text, split at \\n."""
    if not body:
        return []
    judge = judge or _Judge(None)
    raw = body.split("\n")
    lines = [collapse(x) for x in raw]
    judged = [judge(r) for r in raw]
    return kept(lines, [w for w, _ in judged], [h for _, h in judged], window, share)


def _containers(page: markup.Page) -> tuple[list[int], list[bool], dict[int, float]]:
    """Of every line its container and whether it lies in a part that names itself furniture; of every container its running text."""
    elements = page.elements
    aside: dict[int, bool] = {-1: False}
    for e in elements:
        low = e.tag in _ASIDE_TAGS
        if not low and e.attrs and e.tag not in ("body", "html", "article", "main"):
            a = markup.attributes(e.attrs)
            low = bool(_ASIDE_NAME.search(f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}")) or a.get("role") in ("navigation", "complementary", "contentinfo", "dialog", "banner")
        aside[e.id] = low or aside[e.parent]
    homes, off, weight = [], [], {}
    for x in page.lines:
        e = elements[x.element]
        up = e
        if (e.blocks == 0 and e.lines == 1) or e.tag not in _STRUCTURE:
            up = elements[e.parent]
            while up.tag not in _STRUCTURE:
                up = elements[up.parent]
        homes.append(up.id)
        off.append(aside[e.id] or x.link_chars > 0.6 * len(x.text))
        if not off[-1] and is_text(x.text) and not _HEADING.fullmatch(e.tag):
            weight[up.id] = weight.get(up.id, 0.0) + len(x.text)
    return homes, off, weight


def _parsed(source: str | None) -> markup.Page | None:
    return markup.read(source) if source and "<" in source else None


def main_html_lines(source: str | markup.Page | None, judge: _Judge | None = None, window: int = WINDOW, share: float = SURGE_SHARE) -> list[str]:
    """The main-content lines of an HTML page, h1 included, in page order."""
    page = _parsed(source) if not isinstance(source, markup.Page) else source
    if page is None:
        return []
    judge = judge or _Judge(None)
    elements = page.elements
    if not page.lines:
        return []
    homes, off, _ = _containers(page)
    texts = [x.text for x in page.lines]
    heading = [_HEADING.fullmatch(elements[x.element].tag) is not None for x in page.lines]
    weights, heads = [], []
    for text, head, o in zip(texts, heading, off, strict=True):
        w, _ = (0.0, False) if o or head else judge(text)
        weights.append(w)
        heads.append(head and not o and _may_head(text))
    by: dict[int, float] = {}
    for h, w, text in zip(homes, weights, texts, strict=True):
        if w >= 0.5 * len(text) > 0:
            by[h] = by.get(h, 0.0) + w
    if not by:
        return []
    titled = [h for h, x, o in zip(homes, page.lines, off, strict=True) if elements[x.element].tag == "h1" and h in by and not o]
    main = max(titled, key=lambda h: by[h]) if titled else max(by, key=lambda h: (by[h], -h))
    if titled and max(by.values()) > 4 * by[main]:
        main = max(by, key=lambda h: (by[h], -h))
    inside = [any(a.id == main for a in page.ancestors(h)) for h in homes]
    weights = [w if ok else 0.0 for w, ok in zip(weights, inside, strict=True)]
    heads = [h and ok for h, ok in zip(heads, inside, strict=True)]
    found = kept([collapse(t) for t in texts], weights, heads, window, share)
    h1 = [i for i, x in enumerate(page.lines) if elements[x.element].tag == "h1" and not off[i] and not blanks(x.text)]
    if found:
        # in HTML a heading of the container is known by its tag, wherever it stands
        found = sorted({*found, *(i for i, h in enumerate(heads) if h and elements[page.lines[i].element].tag != "h1")})
        if h1 and h1[0] < found[0] + 1 and h1[0] not in found:
            found = [h1[0], *found]
    return [texts[i] for i in dict.fromkeys(found)]


# --- what the structure of HTML pages teaches about lines


def taught_lines(source: str | None) -> list[tuple[str, int, bool]]:
    """(line, 1 inside the main container or 0 outside, heading) of a page one container of which holds two thirds of the running text."""
    if not source or "<" not in source:
        return []
    page = markup.read(source)
    homes, off, weight = _containers(page)
    if not weight:
        return []
    main = max(weight, key=lambda h: (weight[h], -h))
    if weight[main] < max(LEAST_MAIN, 2 * (sum(weight.values()) - weight[main])):
        return []
    out = []
    for x, h, o in zip(page.lines, homes, off, strict=True):
        tag = page.elements[x.element].tag
        inside = not o and any(a.id == main for a in page.ancestors(h))
        if tag != "h1":
            out.append((collapse(x.text), int(inside), inside and _HEADING.fullmatch(tag) is not None))
    return out


def parting(z: np.ndarray, y: np.ndarray) -> float:
    """The score at which the shares of the two classes above it differ most."""
    if not 0 < y.sum() < len(y):
        return 0.0
    order = np.argsort(-z, kind="stable")
    gain = np.cumsum(y[order]) / y.sum() - np.cumsum(1 - y[order]) / (len(y) - y.sum())
    best = int(np.argmax(gain))
    return float((z[order][best] + z[order][min(best + 1, len(z) - 1)]) / 2)


def _taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(line, y, h, is_text(line)) for body in batch.column(0).to_pylist() for line, y, h in taught_lines(body) if line]
        lines, y, heading, text = zip(*rows, strict=True) if rows else [()] * 4
        idx = line_grams(list(lines)).lists(distinct=False) if rows else []
        types = [pa.int8(), pa.bool_(), pa.bool_(), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((y, heading, text, idx), types, strict=True)], names=["y", "heading", "text", "idx"])


def fit_weights(pages: DataFrame, id_col: str, body_col: str, sample_pages: int = SAMPLE_PAGES) -> LineModel | None:
    """The chance of lines, from at most about sample_pages HTML pages drawn by a hash of their id; None if they teach nothing."""
    n = pages.count()
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("lines")), F.lit(1_000_000))
    drawn = pages if n <= sample_pages else pages.where(draw < int(1_000_000 * sample_pages / n) + 1)
    got = drawn.select(F.col(body_col).cast("string").alias("body")).mapInArrow(_taught, "y tinyint, heading boolean, text boolean, idx array<int>").toArrow()
    y, heading, text = (np.array(got.column(c).to_pylist(), int) for c in ("y", "heading", "text"))
    if not len(y) or not 0 < y.sum() < len(y):
        return None
    idx = [np.asarray(x, np.int64) for x in got.column("idx").to_pylist()]
    article = (y == 1) & (text == 1)
    told = np.ones(len(y), bool)
    for again in range(ROUNDS):
        if again and article.any():
            # sentences of sidebars that read like an article's say where a line stands, not what it says: they teach nothing about words
            told = (y == 1) | (z < np.quantile(z[article], LIKE_ARTICLE))
        w, b = grams.fit([(idx[i], int(y[i])) for i in np.flatnonzero(told)], steps=60 if again == ROUNDS - 1 else 20, ridge=1e-4)
        z = np.array([(w[i].sum() + b) / max(1, len(i)) ** 0.5 for i in idx])
    some = told & (text == 1)
    text_from = parting(z[some], y[some])
    heading_from = float(np.quantile(z[heading == 1], HEADING_LOST)) if heading.any() else 0.0
    return LineModel(w, b, text_from, heading_from)


def line_key(line: str) -> str:
    """The first 12 hex digits of the MD5 of the line, its white space collapsed."""
    return hashlib.md5(collapse(line).encode("utf-8", "surrogatepass")).hexdigest()[:12]


def _batches(batches: Iterator[pa.RecordBatch], html: bool, keys: bool, model: LineModel | None) -> Iterator[pa.RecordBatch]:
    judge = _Judge(model)
    for whole in batches:
        for at in range(0, whole.num_rows, PAGES):
            batch = whole.slice(at, PAGES)
            rows, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if html:
                pages = [_parsed(b) for b in bodies]
                judge.learn(x.text for p in pages if p is not None for x in p.lines)
                found = [main_html_lines(p, judge) if p is not None else [] for p in pages]
            else:
                split = [(b or "").split("\n") for b in bodies]
                judge.learn(x for raw in split for x in raw)
                found = [[raw[i] for i in main_lines(b, judge)] for b, raw in zip(bodies, split, strict=True)]
            ids, values = [], []
            for row, lines in zip(rows, found, strict=True):
                if keys:
                    own = dict.fromkeys(map(line_key, lines))
                    ids += [row] * len(own)
                    values += own
                else:
                    ids.append(row)
                    values.append("\n".join(lines))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.string())], names=["row_id", "line_key" if keys else "main_text"])


def main_text(df: DataFrame, id_col: str, body_col: str, html: bool, model: LineModel | None = None) -> DataFrame:
    """(row_id, main_text): each page's main content, its lines joined by \\n; empty where it has none."""
    return df.select(F.col(id_col).cast("long"), F.col(body_col).cast("string")).mapInArrow(lambda it: _batches(it, html, False, model), "row_id long, main_text string")


def main_line_keys(df: DataFrame, id_col: str, body_col: str, html: bool, model: LineModel | None = None) -> DataFrame:
    """(row_id, line_key): the distinct lines of each page's main content."""
    return df.select(F.col(id_col).cast("long"), F.col(body_col).cast("string")).mapInArrow(lambda it: _batches(it, html, True, model), "row_id long, line_key string")
