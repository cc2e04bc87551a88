"""Pages that hold template residue, filler or an error message instead of an article.

A regularised logistic regression over hashed n-grams of title and whole body, their lengths and title features. Tokens
are words, runs of digits, line ends and runs of signs, so that what surrounds a blank is part of an n-gram; n-grams of
token shapes stand beside those of words, and words and pairs once more together with the amount of running text,
since a message means something else beside an article. The phrase lists below give weak labels only, together
with the response status; no feature is made of them, so the model learns from the labelled pages what else such
pages say. Every page is scored whole, in one narrow Arrow stage; only the weights travel.

The model is fitted on a bounded sample (`sample_rows` drawn, of these at most `fit_rows` of each class) and validated
on hosts that it never saw, and once more on pages whose only cues belong to a family of phrases that was kept
out of the labels.

Defined results: null title and body count as empty; a page without any word is no case; if the sample lacks one
class the weak labels themselves are the result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import grams
from webloom.llm.page_lines import BLANK, is_furniture

SAMPLE_ROWS = 40_000
FIT_ROWS = 4_000
PAGES, SLICE_BYTES = 256, 4 << 20
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")

# What titles and short pages say instead of content, by family; only weak labels are made of them.
PHRASES = {
    "missing": "not found|couldn't be found|could not be found|page you asked for|page you requested|taken down|no longer available|no longer exists|does not exist"
    "|nicht gefunden|no encontrada|no encontrado|no encontramos|introuvable|n'existe pas",
    "denied": "access denied|forbidden|do not have permission|unauthorized|zugriff verweigert|zugriff auf diese seite|acceso denegado|accès refusé",
    "failed": "server error|bad gateway|gateway timeout|gateway time-out|service unavailable|something went wrong|not able to answer|interner fehler|error interno|erreur interne|überlastet|no responde|ne répond pas",
    "wait": "too many requests|just a moment|attention required|unusual traffic|down for maintenance|please wait|timed out",
    # lines with a word of scripts and one of these
    "scripts": "enable|disabled|activate|switch|turn on|turned off|allow|require|aktivier|activ|habilit|autoris",
    # lines that begin with these
    "filler": "lorem ipsum|headline goes here|your page title here|title tk|text goes here|copy goes here|text coming here|copy coming here|text to follow|copy to follow|body copy|body text"
    "|placeholder text|placeholder copy|dummy text|dummy copy|sample text|sample copy|filler text|filler copy|this is placeholder|this is dummy|this is sample|this is filler",
}
_CUES = {k: tuple(v.split("|")) for k, v in PHRASES.items()}
_QUOTED = re.compile(r"`[^`]*`|\"[^\"\n]*\"|“[^”\n]*”|<code>.*?</code>")
# Words of sentences that explain template syntax rather than show its failure.
_EXPLAINS = re.compile(r"templat|mail merge|placeholder|\bfields?\b|syntax|variable|explain|replaced|prints|stands for|plantilla|vorlage|platzhalter|modèle|gabarit|marcador", re.I)


_SIGNS = re.compile(r"[{}\[\]<%$#@_«]")


def without_furniture(body: str | None) -> str:
    """The lines of a body that are no menus, notices, prompts or credits, or hold signs that such lines lack."""
    return "\n".join(x for x in ((body or "").split("\n")) if x.strip() and (_SIGNS.search(x) or not is_furniture(x)))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray | None
    bias: float
    report: dict


def sentences(body: str) -> int:
    """Sentences of eight words or more."""
    return sum(s.count(" ") >= 7 for s in _SENTENCE.split(body))


def cues(line: str) -> set[str]:
    """Families of phrases that a lower-cased line shows."""
    found = {k for k in ("missing", "denied", "failed", "wait") if any(p in line for p in _CUES[k])}
    if ("script" in line or "skript" in line) and any(p in line for p in _CUES["scripts"]):
        found.add("scripts")
    if line.lstrip(" \t*#>-").startswith(_CUES["filler"]):
        found.add("filler")
    return found


def families(title: str, body: str) -> dict[str, set[int]]:
    """Families of cues that a page shows, with the lines (0: the title) they stand on; blanks quoted or explained are "told"."""
    found: dict[str, set[int]] = {}
    for i, line in enumerate((title, *body.split("\n"))):
        for k in cues(line.lower()):
            found.setdefault(k, set()).add(i)
        if any(mark in line for mark in "{%<[@_(«") and BLANK.search(line):
            explained = _EXPLAINS.search(BLANK.sub(" ", line))
            quoted = [q.span() for q in _QUOTED.finditer(line)]
            for m in BLANK.finditer(line):
                told = explained or any(a <= m.start() and m.end() <= b for a, b in quoted)
                found.setdefault("told" if told else "blank", set()).add(i)
    return found


def weak_label(title: str | None, body: str | None, status: int | None, without: str | None = None) -> int:
    """1 case, 0 none, -1 not told, by status and phrases (those of one family left out); body without its furniture."""
    title, body = title or "", body or ""
    if not grams.TOKEN.search(body + title):
        return -1
    found, n = families(title, body), sentences(body)
    found.pop(without, None)
    if "blank" in found or ("filler" in found and n <= 40):
        return 1
    lines = set().union(*(found[k] for k in found if k not in ("told", "blank", "filler")))
    failed = (status or 0) >= 400
    if lines or failed:
        rest = sentences("\n".join(x for i, x in enumerate(body.split("\n"), 1) if i not in lines))
        return 1 if rest == 0 or (failed and rest <= 2) else -1 if failed else 0
    # without a word beside its furniture a page is only empty
    return 0 if n >= 1 or not grams.TOKEN.search(body) else -1


def features(titles: list[str | None], bodies: list[str]) -> list[np.ndarray]:
    """Distinct slots of pages, bodies without their furniture; none for a page without words."""
    titles = [t or "" for t in titles]
    n = np.array([sentences(b) for b in bodies], np.int64)
    words = np.array([grams.TOKEN.search(b) is not None for b in bodies], bool)
    bucket = np.where(words, np.digitize(n, [2, 4, 7]), 4)
    own, body = grams.pages(titles, 1), grams.pages(bodies, 2, bucket)
    some = np.flatnonzero(words | (own.size > 0))
    short = np.array([min(9, len(t.split())) for t in titles], np.int64)
    length = np.array([min(12, len(b).bit_length()) for b in bodies], np.int64)
    body.parts += own.parts
    for x in (10_000 + bucket, 11_000 + np.minimum(n, 20), 12_000 + short, 13_000 + length, 14_000 + 20 * short + bucket, 15_000 + np.array([t == "" for t in titles], np.int64)):
        body.add(x[some].astype(np.uint64) * grams.MIX, some)
    return body.lists(distinct=True)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most PAGES rows, fewer where texts are long."""
    at = 0
    length = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column("body_text")), 0)).astype(np.int64)
    while at < batch.num_rows:
        n = max(1, min(PAGES, int(np.searchsorted(np.cumsum(length[at : at + PAGES]), SLICE_BYTES, "right"))))
        yield batch.slice(at, n)
        at += n


_GROUPS = (None, "blank", *PHRASES)


def _featured(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """(labels, held_out, idx): labels with all families and without each; a share of the pages that are no cases."""
    for whole in batches:
        for batch in _slices(whole):
            labels, held, titles, texts = [], [], [], []
            for title, body, status, domain, draw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                text = without_furniture(body)
                label, own = weak_label(title, text, status), families(title or "", text)
                # pages that show a cue beside an article are few and teach most
                if label != 1 and not own and draw >= (share if label == 0 else 4 * share):
                    continue
                labels.append([label, *(weak_label(title, text, status, g) if g in own and label == 1 else label for g in _GROUPS[1:])])
                held.append(zlib.crc32((domain or "").encode()) % 5 == 0)
                titles.append(title)
                texts.append(text)
            idx = features(titles, texts) if texts else []
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.list_(pa.int8())), pa.array(held, pa.bool_()), pa.array(idx, pa.list_(pa.int32()))], names=["labels", "held_out", "idx"])


def _score(w: np.ndarray, b: float, idx: list[np.ndarray]) -> np.ndarray:
    return np.array([float(w[i].sum()) + b for i in idx])


def _fit_twice(idx: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float] | None:
    for again in (False, True):
        if not 0 < (labels == 1).sum() or not 0 < (labels == 0).sum():
            return None
        w, b = grams.fit([(idx[i], int(labels[i])) for i in np.flatnonzero(labels >= 0)])
        if not again:
            z = _score(w, b, idx)
            labels = np.where((labels != 1) & (z > 1), 1, np.where((labels == 0) & (z > -0.5), -1, labels))
    return w, b


def _sample(pages: DataFrame, id_col: str, sample_rows: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    n = pages.count()
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("residue")), F.lit(1_000_000)) / 1_000_000
    drawn = pages.where(draw < sample_rows / n) if n > sample_rows else pages
    share = min(1.0, FIT_ROWS / max(1, min(n, sample_rows)))
    pick = F.pmod(F.xxhash64(F.col(id_col), F.lit("fit")), F.lit(1_000_000)) / 1_000_000
    got = (
        drawn.select("title", "body_text", F.col("metadata.status_code").cast("int").alias("status"), "domain", pick.alias("pick"))
        .mapInArrow(lambda it: _featured(it, share), "labels array<tinyint>, held_out boolean, idx array<int>")
        .toArrow()
    )
    idx = [np.asarray(x, np.int64) for x in got.column("idx").to_pylist()]
    return idx, np.array(got.column("labels").to_pylist(), np.int8).reshape(-1, len(_GROUPS)), np.array(got.column("held_out").to_pylist(), bool)


def train(pages: DataFrame, id_col: str = "page_id", sample_rows: int = SAMPLE_ROWS, report: bool = False) -> Model:
    """Fit on pages drawn by a hash of their id; hosts in a fifth of a hash space only validate.

    report: measure agreement with the labels of those hosts, and for every family of cues the share found of pages
    that only this family tells, by a model whose labels lack it.
    """
    idx, labels, held = _sample(pages, id_col, sample_rows)
    own = np.flatnonzero(~held)
    out: dict[str, float] = {"train_rows": len(own), "train_positive": int((labels[own, 0] == 1).sum()), "held_out_rows": int(held.sum()), "held_out_positive": int((labels[held, 0] == 1).sum())}
    got = _fit_twice([idx[i] for i in own], labels[own, 0])
    if got is None:
        return Model(None, 0.0, out)
    if report:
        said, told = _score(*got, [idx[i] for i in np.flatnonzero(held)]) > 0, labels[held, 0]
        out |= {"precision": float((told[said] == 1).mean()) if said.any() else 0.0, "recall": float(said[told == 1].mean()) if (told == 1).any() else 0.0}
        for k, family in enumerate(_GROUPS[1:], 1):
            only = held & (labels[:, 0] == 1) & (labels[:, k] != 1)
            other = _fit_twice([idx[i] for i in own], labels[own, k]) if only.any() else None
            if other is not None:
                out[f"recall_without_{family}"] = float((_score(*other, [idx[i] for i in np.flatnonzero(only)]) > 0).mean())
    return Model(got[0].astype(np.float32), got[1], out)


def scored(pages: DataFrame, model: Model, id_col: str = "page_id") -> DataFrame:
    """(page_id, score): the model's log odds that a page is residue, of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                _, titles, bodies, states = (batch.column(i).to_pylist() for i in range(4))
                texts = [without_furniture(b) for b in bodies]
                idx = features(titles, texts)
                if model.weights is None:
                    out = [float(weak_label(t, x, s) == 1) - 0.5 for t, x, s in zip(titles, texts, states, strict=True)]
                else:
                    out = [float(model.weights[i].sum()) + model.bias for i in idx]
                # an empty page is only empty
                out = [z if len(i) else -10.0 for z, i in zip(out, idx, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["page_id", "score"])

    return pages.select(F.col(id_col).cast("long"), "title", "body_text", F.col("metadata.status_code").cast("int").alias("status")).mapInArrow(run, "page_id long, score double")


def residue_pages(pages: DataFrame, id_col: str = "page_id", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The ids of pages that are residue."""
    return scored(pages, train(pages, id_col, sample_rows), id_col).where("score > 0").select("page_id")
