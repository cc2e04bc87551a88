"""Two extractors vote on a page's text; metadata, structured data and hydration fill what they miss.

A page is read once by webloom.sources.markup and handled inside one Arrow batch call, which returns a
struct; everything after (promotion, thresholds, records) is native.
"""

from __future__ import annotations

import html as H
import json
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.lexicons import LANGUAGE_WORDS, MONTH_NAMES
from webloom.sources import markup

# Tags and name parts that the scores use.
BLOCK_TAGS = frozenset("p li blockquote td pre h1 h2 h3 h4 h5 h6 figcaption dt dd".split())
BOILER_TAGS = frozenset("nav footer aside noscript".split())
BOILER_NAMES = "sidebar nav menu footer comment widget ad- advertisement social-share cookie popup modal banner".split()
BLOCK_GOOD = "article content post entry story text body".split()
BLOCK_BAD = "comment sidebar nav menu footer widget ad social share related meta tags breadcrumb".split()
BOX_GOOD = "article content post entry text body main story".split()
BOX_BAD = "sidebar nav menu footer comment widget ad banner social share related recommend popup modal".split()
TAG_BONUS = {"p": 3.0, "blockquote": 2.0, "pre": 2.0, "li": 1.0, "h1": 4.0, "h2": 4.0, "h3": 4.0, "td": -1.0}
BOX_BONUS = {"article": 30.0, "main": 25.0, "section": 10.0, "aside": -50.0, "nav": -50.0, "footer": -50.0, "header": -50.0}
BOX_NAMES = ("post-content", "article-body", "entry-content", "content")

_DROP = re.compile(r"<(script|style|svg|noscript|iframe)\b[^>]*>.*?</\1\s*>|<!--.*?-->|\sstyle\s*=\s*(?:\"[^\"]*\"|'[^']*')", re.I | re.S)


def sanitise(source: Column) -> Column:
    """Without script-like blocks, comments and inline styles; natively."""
    out = source
    for tag in ("script", "style", "svg", "noscript", "iframe"):
        out = F.regexp_replace(out, rf"(?si)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    out = F.regexp_replace(out, "(?s)<!--.*?-->", "")
    return F.regexp_replace(out, r"(?si)\sstyle\s*=\s*(?:\"[^\"]*\"|'[^']*')", "")


_BRACES = re.compile(r"\{[^{}]*+\}")
_SELECTOR = re.compile(r"(?:(?<=\s)|^)[.#@]?[\w-][\w\s,>.#:()-]{0,200}\Z", re.M)


def _without_rules(text: str) -> str:
    """Without every brace pair that a selector leads, and the selector; linear, as only the signs back to the brace before are looked at."""
    out, done, bound = [], 0, 0
    for m in _BRACES.finditer(text):
        a = m.start()
        # one sign more than a selector has, for the white space before it
        low = max(bound, text.rfind("{", bound, a) + 1, text.rfind("}", bound, a) + 1, a - 203)
        head = _SELECTOR.search(text, low, a)
        if head:
            out.append(text[done : head.start()])
            done = m.end()
        bound = m.end()
    return "".join([*out, text[done:]])


def without_css(text: str) -> str:
    """Style rules left in text go; runs of blank lines and blanks are closed."""
    if "{" in text:
        text = _without_rules(text)
    lines = [x for x in text.split("\n") if not re.match(r"\s*(?:@media|@import|\.[\w-]+\s*\{)", x)]
    return re.sub(r" {2,}", " ", re.sub(r"\n{3,}", "\n\n", "\n".join(lines))).strip()


class Tree:
    """The page's lines with the text of whole elements."""

    def __init__(self, source: str) -> None:
        self.page = markup.read(source)
        self.attrs = {e.id: markup.attributes(e.attrs) for e in self.page.elements if e.attrs}
        self.children: dict[int, list[int]] = {}
        for e in self.page.elements[1:]:
            self.children.setdefault(e.parent, []).append(e.id)
        self.own: dict[int, list[markup.Line]] = {}
        for line in self.page.lines:
            for e in self.page.ancestors(line.element):
                self.own.setdefault(e.id, []).append(line)
        self.inside: dict[int, list[int]] = {}
        for p in self.page.elements:
            if p.tag == "p":
                for a in self.page.ancestors(p.id):
                    self.inside.setdefault(a.id, []).append(p.id)
        self._names: dict[int, str] = {}
        self._plain: dict[int, bool] = {}

    def name(self, i: int) -> str:
        if i not in self._names:
            a = self.attrs.get(i, {})
            self._names[i] = f"{a.get('class', '')} {a.get('id', '')}".lower()
        return self._names[i]

    def marked(self, i: int) -> bool:
        """Whether the element itself is boilerplate by tag or name."""
        if i not in self._plain:
            self._plain[i] = self.page.elements[i].tag in BOILER_TAGS or any(b in self.name(i) for b in BOILER_NAMES)
        return self._plain[i]

    def text(self, i: int, sep: str = " ") -> str:
        return sep.join(x.text for x in self.own.get(i, []))

    def link_chars(self, i: int) -> int:
        return sum(x.link_chars for x in self.own.get(i, []))

    def boiler(self, i: int, depth: int = 11) -> bool:
        for n, e in enumerate(self.page.ancestors(self.page.elements[i].parent)):
            if n >= depth:
                return False
            if self.marked(e.id):
                return True
        return False


def block_pass(t: Tree) -> tuple[str, float]:
    """Every text block outside boilerplate scored; the blocks from the 40th percentile up are kept."""
    found = []
    for e in t.page.elements:
        if e.tag not in BLOCK_TAGS or t.boiler(e.id):
            continue
        text = t.text(e.id).strip()
        if not text:
            continue
        size = len(text.encode())
        score = min(size / 50, 10.0) + 2.0 * len(re.findall(r"[.!?]", text)) + (5.0 if len(text.split()) > 10 else 0.0) + TAG_BONUS.get(e.tag, 0.0)
        parent = t.name(e.parent)
        score += 5.0 * sum(w in parent for w in BLOCK_GOOD) - 10.0 * sum(w in parent for w in BLOCK_BAD)
        if t.link_chars(e.id) / max(size, 1) > 0.6:
            score -= 15.0
        found.append((text, score))
    if not found:
        return "", 0.3
    least = sorted(s for _, s in found)[int(len(found) * 0.4)]
    body = "\n\n".join(x for x, s in found if s >= least and len(x.encode()) > 30)
    size = len(body.encode())
    return body, 0.85 if size > 500 else 0.6 if size > 100 else 0.3


def _clear_text(t: Tree, i: int) -> str:
    bad = {"nav", "footer", "header", "aside"}
    return " ".join(x.text for x in t.own.get(i, []) if not any(e.tag in bad for e in t.page.ancestors(x.element) if e.id != i and e.id > i))


def box_pass(t: Tree) -> tuple[str, float]:
    """The best container; else the best div of two long paragraphs; else all longer paragraphs."""
    paragraphs = lambda i: t.inside.get(i, [])

    def rate(i: int, text: str) -> float:
        e, size = t.page.elements[i], len(text.encode())
        if size < 50:
            return -100.0
        s = min(size / 100, 50.0) + 3.0 * len(paragraphs(i)) + BOX_BONUS.get(e.tag, 0.0)
        s += 15.0 * sum(w in t.name(i) for w in BOX_GOOD) - 20.0 * sum(w in t.name(i) for w in BOX_BAD)
        return s - (30.0 if t.link_chars(i) / max(size, 1) > 0.5 else 0.0)

    boxes = []
    for e in t.page.elements:
        a = t.attrs.get(e.id, {})
        if e.tag in ("article", "main") or a.get("role") == "main" or a.get("id") == "content" or set(a.get("class", "").split()) & set(BOX_NAMES):
            text = _clear_text(t, e.id)
            if len(text.encode()) >= 100:
                boxes.append((rate(e.id, text), -e.id, text))
    if not boxes:
        for e in t.page.elements:
            if e.tag == "div":
                ps = [x for x in (t.text(p).strip() for p in paragraphs(e.id)) if len(x.encode()) > 40]
                if len(ps) >= 2:
                    text = "\n\n".join(ps)
                    boxes.append((rate(e.id, text), -e.id, text))
    body = max(boxes)[2] if boxes else "\n\n".join(x for x in (t.text(e.id).strip() for e in t.page.elements if e.tag == "p") if len(x.encode()) > 20)
    return body, 0.8 if len(body.encode()) > 200 else 0.4


_META = re.compile(r"<meta\b([^>]*)>", re.I)
_JSONLD = re.compile(r"<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", re.I | re.S)


def metas(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _META.finditer(source):
        a = markup.attributes(m[1])
        key = (a.get("name") or a.get("property") or a.get("http-equiv") or "").lower()
        if key and a.get("content") and key not in out:
            out[key] = a["content"].strip()
    return out


def parse_date(text: str | None) -> str | None:
    """The UTC instant of an ISO date or time, y/m/d, or an English day and month, as ISO text."""
    text = (text or "").strip()
    try:
        d = datetime.fromisoformat(text.replace("Z", "+00:00"))
        return (d if d.tzinfo else d.replace(tzinfo=UTC)).astimezone(UTC).isoformat()
    except ValueError:
        pass
    m = re.fullmatch(r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})", text)
    parts = (int(m[1]), int(m[2]), int(m[3])) if m else None
    m = re.fullmatch(r"([A-Za-z]+) (\d{1,2}), (\d{4})", text)
    if m and m[1].lower() in MONTH_NAMES:
        parts = (int(m[3]), MONTH_NAMES.index(m[1].lower()) + 1, int(m[2]))
    m = re.fullmatch(r"(\d{1,2}) ([A-Za-z]+) (\d{4})", text)
    if m and m[2].lower() in MONTH_NAMES:
        parts = (int(m[3]), MONTH_NAMES.index(m[2].lower()) + 1, int(m[1]))
    try:
        return datetime(*parts, tzinfo=UTC).isoformat() if parts else None
    except ValueError:
        return None


_SCRIPTS = (("cjk", "一-鿿㐀-䶿"), ("kana", "぀-ヿ"), ("hangul", "가-힯ᄀ-ᇿ"), ("arabic", "؀-ۿݐ-ݿ"), ("cyrillic", "Ѐ-ӿ"), ("devanagari", "ऀ-ॿ"), ("latin", "A-Za-zÀ-ɏ"))


def language_of(text: Column) -> Column:
    """Language by script, then by common words of en, es, fr, de, pt; null below 50 letters, en below three hits. Natively."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\s+", ""), r"[!-/:-@\[-`{-~]", "")
    total = F.length(bare)
    n = {k: F.length(F.regexp_replace(bare, f"[^{cls}]", "")) for k, cls in _SCRIPTS}
    quarter = F.floor(total / 4)
    w = F.split(F.lower(text), r"\s+")
    among = lambda ws: F.size(F.filter(w, lambda x: x.isin(*ws)))
    counts = {k: among(ws) for k, ws in LANGUAGE_WORDS.items()}
    top = F.greatest(*counts.values())
    latin = F.when(top < 3, "en")
    for k, c in counts.items():
        latin = latin.when(c == top, k)
    return (
        F.when(total < 50, None).when((n["cjk"] > quarter) & (n["kana"] > 0), "ja").when(n["cjk"] > quarter, "zh").when(n["hangul"] > quarter, "ko")
        .when(n["arabic"] > quarter, "ar").when(n["cyrillic"] > quarter, "ru").when(n["devanagari"] > quarter, "hi").when(n["latin"] > quarter, latin)
    )


def article_of(value: object) -> dict:
    """The article node of structured data: a node, a list or a @graph."""
    nodes = value if isinstance(value, list) else value.get("@graph", [value]) if isinstance(value, dict) else []
    for n in nodes if isinstance(nodes, list) else [nodes]:
        if not isinstance(n, dict):
            continue
        kinds = n.get("@type") or ""
        kinds = [str(k).lower() for k in (kinds if isinstance(kinds, list) else [kinds])]
        if any("article" in k or k in ("blogposting", "report") for k in kinds):
            return n
    return {}


def _author(v: object) -> str | None:
    if isinstance(v, list):
        return ", ".join(filter(None, map(_author, v))) or None
    if isinstance(v, dict):
        return v.get("name") if isinstance(v.get("name"), str) else None
    return v if isinstance(v, str) else None


def _loads(text: str) -> object:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _balanced(text: str, at: int) -> str | None:
    """The bracketed value that starts at `at`."""
    depth, i, quoted = 0, at, False
    while i < len(text):
        c = text[i]
        if quoted:
            i += c == "\\"
            quoted = not (c == '"' and text[i] == '"') if i < len(text) else False
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == 0:
                return text[at : i + 1]
        i += 1
    return None


# Where applications leave their state, and what its fields are called.
STATE_NAMES = ("__NUXT__", "__INITIAL_STATE__", "__APOLLO_STATE__", "__PRELOADED_STATE__", "__DATA__")
FIELDS = {
    "body": "body content articlebody bodytext text html bodyhtml contenthtml".split(),
    "title": "title headline".split(),
    "description": "description summary excerpt dek standfirst".split(),
    "author": "author byline authorname".split(),
    "published": "publishedat datepublished publishdate published date createdat".split(),
}
_FIELD_OF = {n: f for f, ns in FIELDS.items() for n in ns}


def harvest(value: object, depth: int = 12) -> dict[str, str]:
    """Title, description, author, date and the longest body anywhere in a state, keys compared without case and marks."""
    out: dict[str, str] = {}

    def walk(v: object, left: int) -> None:
        if left < 0:
            return
        if isinstance(v, dict):
            for k, x in v.items():
                f = _FIELD_OF.get(re.sub(r"[^a-z0-9]", "", k.lower()))
                if f and isinstance(x, str):
                    s = " ".join(H.unescape(re.sub(r"<[^>]*>", " ", x)).split())
                    if f == "body":
                        if len(s) > len(out.get("body", "")):
                            out["body"] = s
                    elif s and f not in out and len(s) <= 500:
                        out[f] = s
                elif f == "author" and "author" not in out and _author(x):
                    out["author"] = _author(x)
                walk(x, left - 1)
        elif isinstance(v, list):
            for x in v:
                walk(x, left - 1)

    walk(value, depth)
    return out


def hydration(source: str) -> dict[str, str]:
    """The first meaningful application state of a page: body of 200 characters, or title with description."""
    found: list[tuple[str, object]] = []
    for label, ident in (("next", "__NEXT_DATA__"), ("nuxt", "__NUXT_DATA__")):
        m = re.search(rf"<script\b[^>]*\bid\s*=\s*[\"']{ident}[\"'][^>]*>(.*?)</script>", source, re.I | re.S)
        if m:
            v = _loads(m[1].strip())
            if isinstance(v, dict) and isinstance(v.get("props"), dict):
                v = v["props"].get("pageProps", v)
            found.append((label, v))
    for name in STATE_NAMES:
        m = re.search(rf"window\.{name}\s*=\s*(?=[{{\[])", source)
        if m and (part := _balanced(source, m.end())):
            found.append(("state", _loads(part)))
    chunks = re.findall(r"self\.__next_f\.push\(\[\d+,\s*(\"(?:[^\"\\]|\\.)*\")\]\)", source)
    if chunks:
        flat = "".join(x for x in map(_loads, chunks) if isinstance(x, str))
        got = {f: v for ns in FIELDS.values() for n in ns for m in [re.search(rf"\"{n}\"\s*:\s*(\"(?:[^\"\\]|\\.)*\")", flat, re.I)] if m for f, v in [(_FIELD_OF[n], _loads(m[1]))] if isinstance(v, str)}
        found.append(("flight", got))
    for label, v in found:
        got = harvest(v)
        if len(got.get("body", "")) >= 200 or (got.get("title") and got.get("description")):
            return got | {"source": label}
    return {}


def richer(new: str, old: str) -> bool:
    return len(new) >= 200 and (len(old) < 50 or len(new) > 1.2 * len(old))


def extract(source: str | None, url: str | None, data_layers: bool = True) -> dict:
    """One page: title, text, confidence, extractor, metadata, headings, links, tables."""
    source, url = source or "", url or ""
    t = Tree(_DROP.sub("", source))
    a, b = block_pass(t), box_pass(t)
    body, sure, by = (*a, "blocks") if a[1] >= b[1] else (*b, "boxes")
    body = without_css(body)
    if a[0] and b[0]:
        sure = min(1.0, sure * 1.1)
    heads = [(int(e.tag[1]), x) for e in t.page.elements if re.fullmatch("h[1-6]", e.tag) and not t.boiler(e.id) and (x := t.text(e.id).strip())]
    m = metas(source)
    title = t.page.title.split(" - ")[0].strip() or next((x for n, x in heads if n == 1), "") or m.get("og:title", "")
    ld = next((v for x in _JSONLD.findall(source) if (v := _loads(x.strip())) is not None), None)
    art = article_of(ld) if ld is not None else {}
    author = m.get("author") or m.get("article:author")
    if not author:
        for e in t.page.elements:
            if ("author" in t.name(e.id) or "byline" in t.name(e.id) or t.attrs.get(e.id, {}).get("rel") == "author") and 0 < len(x := t.text(e.id).strip()) < 100:
                author = x
                break
    stamp = re.search(r"<time\b[^>]*datetime\s*=\s*[\"']([^\"']+)", source, re.I)
    dates = [m.get(k) for k in ("article:published_time", "date", "pubdate", "dc.date")] + [stamp[1] if stamp else None]
    published = next((d for d in map(parse_date, dates) if d), None)
    lang = re.search(r"<html\b[^>]*\blang\s*=\s*[\"']?([\w-]+)", source, re.I)
    description = m.get("description") or m.get("og:description")
    # structured data fills gaps and may bring the better text
    text = art.get("articleBody") if isinstance(art.get("articleBody"), str) else ""
    title = title or (art.get("headline") if isinstance(art.get("headline"), str) else "") or m.get("og:title", "")
    description = description or (art.get("description") if isinstance(art.get("description"), str) else None)
    author = author or _author(art.get("author"))
    published = published or parse_date(art.get("datePublished") if isinstance(art.get("datePublished"), str) else None)
    if data_layers and text and richer(text, body):
        body, sure, by = text, max(sure, 0.75), "structured"
    if data_layers and (sure < 0.6 or len(body) < 200):
        h = hydration(source)
        if h.get("body") and richer(h["body"], body):
            body, sure, by = h["body"], max(sure, 0.75), "hydration"
        title, description, author = title or h.get("title", ""), description or h.get("description"), author or h.get("author")
        published = published or parse_date(h.get("published"))
    tables = []
    for e in t.page.elements:
        if e.tag != "table":
            continue
        head, rows = [], []
        for r in (x for x in t.page.elements if x.tag == "tr" and any(p.id == e.id for p in t.page.ancestors(x.id))):
            cells = [t.page.elements[c] for c in t.children.get(r.id, [])]
            ths, tds = [t.text(c.id) for c in cells if c.tag == "th"], [t.text(c.id) for c in cells if c.tag == "td"]
            if ths and not head:
                head = ths
            elif tds:
                rows.append(tds)
        if head or rows:
            tables.append({"headers": head, "rows": rows})
    return {
        "title": title, "body_text": body, "confidence": round(sure, 4), "extractor": by, "author": author, "published": published,
        "language": lang[1].lower() if lang else m.get("content-language"), "description": description,
        "headings": [{"level": n, "text": x} for n, x in sorted(heads, key=lambda p: p[0])],
        "links": links(source, url), "tables": tables,
        "og_title": m.get("og:title"), "og_type": m.get("og:type"), "og_site_name": m.get("og:site_name"), "json_ld": json.dumps(ld) if ld is not None else None,
    }


_A = re.compile(r"<a\b([^>]*)>(.*?)</a\s*>", re.I | re.S)


def links(source: str, base: str) -> list[dict]:
    """Links with resolved http(s) target, text, whether external, and rel; script, mail, phone, data and fragment links left out."""
    out, own = [], urlsplit(base).hostname if base else None
    for m in _A.finditer(source):
        a = markup.attributes(m[1])
        href = a.get("href", "").strip()
        if not href or href.startswith("#") or re.match(r"(?:javascript|mailto|tel|data):", href, re.I):
            continue
        try:
            target = urljoin(base, href)
            host = urlsplit(target).hostname
        except ValueError:
            continue
        if target.startswith(("http://", "https://")):
            out.append({"url": target, "anchor_text": " ".join(H.unescape(re.sub(r"<[^>]*>", "", m[2])).split()), "is_external": host != own, "rel": a.get("rel")})
    return out


RESULT = (
    "title string, body_text string, confidence double, extractor string, author string, published string, language string, description string, "
    "headings array<struct<level:int,text:string>>, links array<struct<url:string,anchor_text:string,is_external:boolean,rel:string>>, "
    "tables array<struct<headers:array<string>,rows:array<array<string>>>>, og_title string, og_type string, og_site_name string, json_ld string"
)
_LINK = pa.struct([("url", pa.string()), ("anchor_text", pa.string()), ("is_external", pa.bool_()), ("rel", pa.string())])
_ARROW = {
    "confidence": pa.float64(), "headings": pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string())])), "links": pa.list_(_LINK),
    "tables": pa.list_(pa.struct([("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))])),
}


def extracted(pages: DataFrame, id_col: str, source_col: str, url_col: str, data_layers: bool = True) -> DataFrame:
    """(id, url, ...RESULT): every page extracted; pages without markup give empty text. data_layers: whether structured data and hydration may fill thin bodies."""
    names = [x.strip().split(" ")[0] for x in re.split(r", (?![^<]*>)", RESULT)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                got = [extract(s, u, data_layers) for u, s in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                cols = [pa.array([g[n] for g in got], _ARROW.get(n, pa.string())) for n in names]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=["id", "url", *names])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(source_col).alias("source"))
    return rows.mapInArrow(run, f"id long, url string, {RESULT}")


def looks_scripted(source: Column) -> Column:
    """A shell that scripts fill: an empty mount point, or little visible text with scripts in a large page, or a long noscript notice."""
    text = F.coalesce(source, F.lit(""))
    mount = text.rlike(r"(?i)<div id=\"(?:root|app|__next|__nuxt)\">\s*</div>")
    bare = text
    for tag in ("script", "style", "noscript"):
        bare = F.regexp_replace(bare, rf"(?si)<{tag}\b[^>]*>.*?</{tag}>", "")
    bare = F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", ""), r"\s+", "")
    scripted = F.contains(F.lower(text), F.lit("<script"))
    notice = F.length(F.regexp_extract(text, r"(?si)<noscript[^>]*>(.*?)</noscript>", 1)) > 100
    return mount | ((F.length(bare) < 500) & scripted & (F.octet_length(text) > 5000)) | notice
