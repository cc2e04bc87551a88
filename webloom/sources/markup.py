"""A small HTML reader: one pass over the tags with an element stack, giving lines of text and their place.

It closes void elements and open paragraphs the way browsers do, skips script-like content, decodes
entities and removes inline tags without trace.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template svg iframe textarea select math object canvas".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
BLOCK = frozenset(
    "html head body p div li ul ol h1 h2 h3 h4 h5 h6 blockquote section article main header footer nav aside table thead tbody tfoot tr td th "
    "dl dt dd figure figcaption form fieldset pre address details summary dialog hgroup center".split()
)
_CLOSES_P = BLOCK - {"html", "head", "body", "td", "th", "tr"}


@dataclass(slots=True)
class Element:
    id: int
    tag: str
    parent: int
    attrs: str
    lines: int = 0
    blocks: int = 0


@dataclass(slots=True)
class Line:
    text: str
    element: int
    link_chars: int
    bold: bool = False


@dataclass(slots=True)
class Page:
    elements: list[Element] = field(default_factory=list)
    lines: list[Line] = field(default_factory=list)
    title: str = ""

    def ancestors(self, element: int):
        while element >= 0:
            e = self.elements[element]
            yield e
            element = e.parent


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)}


def read(source: str) -> Page:
    """Parse HTML of any quality; never raises on text."""
    page = Page()
    elements = page.elements
    elements.append(Element(0, "#root", -1, ""))
    stack = [0]
    parts: list[str] = []
    links = 0
    in_link = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                holder = next((e for e in reversed(stack) if elements[e].tag in BLOCK or e == 0), 0)
                elements[holder].lines += 1
                page.lines.append(Line(text, holder, min(links, len(text))))
            parts.clear()
        links = 0

    at, skip_until = 0, ""
    size = len(source)
    lower = None
    while at < size:
        m = _TOKEN.search(source, at)
        if m is None:
            chunk, at = source[at:], size
        else:
            chunk, at = source[at : m.start()], m.end()
        if chunk:
            parts.append(chunk)
            if in_link:
                links += len(chunk.strip())
        if m is None:
            break
        if m[1] is not None:
            parts.append(m[1])
            continue
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "a" and in_link:
                in_link -= 1
            if tag in BLOCK:
                flush()
            depth = next((i for i in range(len(stack) - 1, 0, -1) if elements[stack[i]].tag == tag), 0)
            if depth:
                del stack[depth:]
            continue
        if tag in RAW or tag in SKIPPED:
            if m[4].rstrip().endswith("/") and tag not in RAW:
                continue
            lower = source.lower() if lower is None else lower
            end = lower.find(f"</{tag}", at)
            inner = source[at : end if end >= 0 else size]
            close = source.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else size
            if tag == "title" and not page.title:
                page.title = " ".join(html.unescape(inner).split())
            continue
        if tag == "br":
            flush()
            continue
        if tag in VOID:
            continue
        if tag in BLOCK:
            flush()
            if tag in _CLOSES_P and elements[stack[-1]].tag == "p":
                stack.pop()
            if tag in ("li", "dt", "dd", "tr", "td", "th") and elements[stack[-1]].tag == tag:
                stack.pop()
            holder = stack[-1]
            elements[holder].blocks += 1
            in_link = 0
        elif tag == "a":
            in_link += 1
        if not m[4].rstrip().endswith("/"):
            elements.append(Element(len(elements), tag, stack[-1], m[4]))
            stack.append(len(elements) - 1)
    flush()
    return page
