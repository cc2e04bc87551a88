"""Feeds, sitemaps, robots rules, archive captures, result pages, pagination and line-wise JSON."""

from __future__ import annotations

import html as H
import json
import re
from collections.abc import Iterator
from urllib.parse import parse_qsl, quote, unquote, urlencode, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.text import strip
from webloom.functions.urls import feed_form
from webloom.sources import markup

FEED_TYPES = ("application/rss+xml", "application/atom+xml", "application/feed+json")
WELL_KNOWN = ("/feed", "/rss", "/rss.xml", "/atom.xml", "/feed.json", "/feed.xml", "/index.xml")


def feed_links(page: str, base: str) -> list[dict]:
    """Announced feeds with resolved href and type."""
    out = []
    for m in re.finditer(r"<link\b([^>]*)>", page, re.I):
        a = markup.attributes(m[1])
        if "alternate" in a.get("rel", "").lower().split() and a.get("type", "").lower() in FEED_TYPES and a.get("href"):
            out.append({"url": urljoin(base, a["href"]), "type": a["type"].lower(), "title": a.get("title")})
    return out


def probe_urls(base: str, page: str = "", most: int = 8) -> list[str]:
    """Announced feeds first, then the usual places, each once."""
    root = "{0.scheme}://{0.netloc}".format(urlsplit(base))
    return list(dict.fromkeys([x["url"] for x in feed_links(page, base)] + [root + p for p in WELL_KNOWN]))[:most]


def _field(block: str, tag: str) -> str | None:
    m = re.search(rf"<{tag}\b[^>]*>(.*?)</{tag}\s*>", block, re.I | re.S)
    if not m:
        return None
    text = m[1].strip()
    cdata = re.fullmatch(r"<!\[CDATA\[(.*?)\]\]>", text, re.S)
    return (cdata[1] if cdata else H.unescape(text)).strip() or None


def parse_feed(body: str | None) -> list[dict]:
    """Items of an RSS, Atom or JSON feed: url, title, summary, content, published. Anything else gives none."""
    body = (body or "").lstrip("﻿").strip()
    out = []
    if body.startswith("{"):
        try:
            data = json.loads(body)
        except ValueError:
            return []
        for x in data.get("items") or []:
            if isinstance(x, dict):
                out.append({"url": x.get("url") or x.get("id"), "title": x.get("title"), "summary": x.get("summary"), "content": x.get("content_html") or x.get("content_text"), "published": x.get("date_published")})
        return out
    if re.search(r"<feed\b", body, re.I):
        for e in re.findall(r"<entry\b[^>]*>(.*?)</entry\s*>", body, re.I | re.S):
            link = None
            for m in re.finditer(r"<link\b([^>]*)/?>", e, re.I):
                a = markup.attributes(m[1])
                if a.get("rel", "alternate") == "alternate" and a.get("href"):
                    link = a["href"]
                    break
            out.append({"url": link, "title": _field(e, "title"), "summary": _field(e, "summary"), "content": _field(e, "content"), "published": _field(e, "published") or _field(e, "updated")})
        return out
    for e in re.findall(r"<item\b[^>]*>(.*?)</item\s*>", body, re.I | re.S):
        out.append({"url": _field(e, "link") or _field(e, "guid"), "title": _field(e, "title"), "summary": _field(e, "description"), "content": _field(e, "content:encoded"), "published": _field(e, "pubDate")})
    return out


def _listed(batch: pa.RecordBatch, found: list[tuple[int, int, dict]], names: tuple[str, ...]) -> pa.RecordBatch:
    """Rows (id of the batch's row, position, text columns) of what was found in each row."""
    ids = batch.column(0).take(pa.array([i for i, _, _ in found], pa.int64()))
    return pa.RecordBatch.from_arrays([ids, pa.array([n for _, n, _ in found], pa.int32()), *[pa.array([x[k] for _, _, x in found], pa.string()) for k in names]], names=["id", "position", *names])


def feed_items(feeds: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """(id, position, url, title, summary, content, published)."""
    names = ("url", "title", "summary", "content", "published")
    kind = dict(feeds.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_feed(b) for b in batch.column(1).to_pylist()]
            yield _listed(batch, [(i, n, x) for i, items in enumerate(found) for n, x in enumerate(items)], names)

    return feeds.select(F.col(id_col).alias("id"), body_col).mapInArrow(run, f"id {kind}, position int, " + ", ".join(f"{n} string" for n in names))


def item_for_url(items: DataFrame, wanted: DataFrame, url: str) -> DataFrame:
    """Items whose loose URL equals a wanted one."""
    w = wanted.select(feed_form(F.col(url)).alias("__k")).distinct()
    return items.withColumn("__k", feed_form(F.col("url"))).join(w, "__k", "left_semi").drop("__k")


def sitemap_urls(body: Column) -> Column:
    """Every http <loc>; a body without any is read as a list of URLs, one a line. Natively."""
    locs = F.transform(F.regexp_extract_all(body, F.lit(r"(?si)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))
    plain = F.transform(F.split(body, r"\s+"), lambda x: F.trim(x))
    http = lambda xs: F.filter(xs, lambda x: x.rlike("^https?://"))
    return F.when(F.size(locs) > 0, http(locs)).otherwise(http(plain))


def is_sitemap_index(body: Column) -> Column:
    return body.rlike(r"(?i)<sitemapindex\b")


def sitemap_children(body: Column, part: str | None = None) -> Column:
    """The sitemaps an index lists, those whose URL contains `part` if given."""
    urls = F.when(is_sitemap_index(body), sitemap_urls(body)).otherwise(F.array().cast("array<string>"))
    return F.filter(urls, lambda u: F.contains(u, F.lit(part))) if part else urls


def news_entries(sitemaps: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """(id, loc, title, publication_date, publication_name) of news sitemaps; entries without loc are left out."""
    each = F.explode(F.regexp_extract_all(F.col(body_col), F.lit(r"(?si)<url>(.*?)</url>"), F.lit(1)))
    rows = sitemaps.select(F.col(id_col).alias("id"), each.alias("e"))
    get = lambda tag: F.nullif(strip(F.regexp_extract("e", rf"(?si)<{tag}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{tag}>", 1)), F.lit(""))
    return rows.select("id", get("loc").alias("loc"), get("news:title").alias("title"), get("news:publication_date").alias("publication_date"), get("news:name").alias("publication_name")).where("loc is not null")


def parse_robots(text: str | None, agent: str) -> dict:
    """Rules for an agent: its own group replaces the wildcard's; sitemaps are global."""
    groups: dict[str, dict] = {}
    current: list[dict] = []
    in_agents, sitemaps = False, []
    for line in (text or "").splitlines():
        line = line.split("#")[0].strip()
        key, _, value = (x.strip() for x in line.partition(":"))
        key = key.lower()
        if key == "sitemap" and value:
            sitemaps.append(value)
        elif key == "user-agent":
            if not in_agents:
                current = []
            current.append(groups.setdefault(value.lower(), {"disallow": [], "allow": [], "delay": None}))
            in_agents = True
        elif key:
            in_agents = False
            for g in current:
                if key in ("allow", "disallow") and value:
                    g[key].append(value)
                elif key == "crawl-delay":
                    try:
                        g["delay"] = float(value)
                    except ValueError:
                        pass
    own = next((g for a, g in groups.items() if a != "*" and a and a in agent.lower()), groups.get("*", {"disallow": [], "allow": [], "delay": None}))
    return {"disallow": own["disallow"], "allow": own["allow"], "crawl_delay": own["delay"], "sitemaps": sitemaps}


def _rule(path: Column, rule: Column) -> Column:
    """Length of a rule that matches the path, else -1; * is any run, a final $ the end."""
    escaped = F.regexp_replace(rule, r"([.\\+?^(){}\[\]|])", r"\\$1")
    rx = F.concat(F.lit("^"), F.regexp_replace(F.replace(escaped, F.lit("*"), F.lit(".*")), r"\$(?!$)", r"\\$"))
    return F.when(F.regexp_like(path, rx), F.length(rule)).otherwise(-1)


def robots_allowed(path: Column, disallow: Column, allow: Column) -> Column:
    """The longest matching rule decides; allow wins ties; no rule allows. Null rules count as none."""
    none = F.array().cast("array<string>")
    longest = lambda rules: F.coalesce(F.array_max(F.transform(F.coalesce(rules, none), lambda r: _rule(path, r))), F.lit(-1))
    d, a = longest(disallow), longest(allow)
    return (d < 0) | (a >= d)


def newest_capture(rows: DataFrame, key: str, as_of: str | None = None, max_age_days: int | None = None) -> DataFrame:
    """Per key the newest capture of status 200 with a valid 14-digit time, not older than max_age_days at as_of; ties to the smallest digest."""
    at = F.try_to_timestamp(F.when(F.col("timestamp").rlike("^[0-9]{14}$"), F.col("timestamp")), F.lit("yyyyMMddHHmmss"))
    ok = rows.withColumn("__at", at).where((F.col("status") == 200) & F.col("__at").isNotNull())
    if max_age_days is not None:
        ok = ok.where(F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp("__at") <= max_age_days * 86400)
    best = ok.groupBy(key).agg(F.max("timestamp").alias("timestamp"))
    return ok.join(best, [key, "timestamp"]).groupBy(key, "timestamp").agg(F.min("digest").alias("digest"))


def capture_rows(responses: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, original, timestamp, status, mimetype, digest) of a capture API's array-of-arrays answer, columns found by header name."""
    table = F.from_json(F.col(json_col), "array<array<string>>")
    rows = responses.select(F.col(id_col).alias("id"), table.alias("t")).where(F.size("t") > 1)
    rows = rows.select("id", F.col("t")[0].alias("h"), F.explode(F.slice("t", F.lit(2), F.size("t") - 1)).alias("r"))
    get = lambda *names: F.coalesce(*[F.when(F.array_position("h", n) > 0, F.get("r", (F.array_position("h", n) - 1).cast("int"))) for n in names])
    return rows.select("id", get("original", "url").alias("original"), get("timestamp").alias("timestamp"), get("statuscode", "status").try_cast("int").alias("status"), get("mimetype", "mime").alias("mimetype"), get("digest").alias("digest"))


def raw_capture_url(base: Column, timestamp: Column, url: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/web/"), timestamp, F.lit("id_/"), url)


def capture_query(base: str, url: str) -> str:
    return f"{base.rstrip('/')}?url={quote(url, safe='')}&output=json&filter=statuscode:200"


# Result pages by host, hosts that are noise in results, and most results taken.
ENGINES = [
    ("scholar", r"scholar\.google\.com"), ("google", r"google\.com"), ("bing", r"bing\.com"), ("brave", r"search\.brave\.com"), ("mojeek", r"mojeek\.com"),
    ("duckduckgo", r"duckduckgo\.com"), ("wikipedia", r"wikipedia\.org"), ("arxiv", r"arxiv\.org"), ("reddit", r"reddit\.com"), ("hackernews", r"algolia\.com"),
    ("pubmed", r"pubmed\.ncbi\.nlm\.nih\.gov"), ("metasearch", r"searx|search\."),
]
NOISE = [
    "youtube.com/watch", "facebook.com", "twitter.com/", "x.com/", "instagram.com", "tiktok.com", "pinterest.com", "amazon.com/dp/", "amazon.com/gp/",
    "ebay.com", "play.google.com", "apps.apple.com", "linkedin.com/in/", "linkedin.com/company/",
]
_WANTED = {"wikipedia": r"/wiki/(?!Special:)", "arxiv": r"/(?:abs|pdf)/", "reddit": r"/comments/", "pubmed": r"/\d+/?$"}
_TITLE_CLASS = {"brave": r"\b(?:l1|title)\b", "mojeek": r"\btitle\b", "duckduckgo": r"result__a", "pubmed": r"docsum-title"}
_OWN = {"google": "google.com", "bing": "bing.com", "brave": "brave.com", "mojeek": "mojeek.com", "duckduckgo": "duckduckgo.com", "scholar": "google.com"}
_MOST = {"wikipedia": 10, "arxiv": 15, "pubmed": 15, "reddit": 15}


def engine_of(url: str) -> str | None:
    host = (urlsplit(url).hostname or "").lower()
    for name, rx in ENGINES:
        if re.search(rx, host) and (name not in ("wikipedia", "arxiv", "reddit") or "search" in url) and (name != "metasearch" or "format=json" in url) and not (name == "google" and "news" in host):
            return name
    return None


def redirect_target(href: str) -> str:
    """The target inside a result page's redirect link."""
    q = dict(parse_qsl(urlsplit(href).query))
    for key in ("uddg", "q", "u", "url"):
        v = unquote(q.get(key, ""))
        if v.startswith("http"):
            return v
    return href


def is_noise(url: Column) -> Column:
    return url.rlike("|".join(re.escape(n) for n in NOISE))


def parse_results(url: str | None, body: str | None, most: int = 20) -> list[dict]:
    """(engine, url, title, snippet, position) of a result page; the first of repeated targets stays, own and noise hosts go."""
    engine = engine_of(url or "")
    body = body or ""
    if engine is None:
        try:
            engine = "hackernews" if isinstance(json.loads(body).get("hits"), list) else None
        except (ValueError, AttributeError):
            return []
        if engine is None:
            return []
    found: dict[str, dict] = {}
    if engine in ("hackernews", "metasearch"):
        try:
            data = json.loads(body)
        except ValueError:
            return []
        for x in data.get("hits" if engine == "hackernews" else "results") or []:
            target = x.get("url") or ""
            if target.startswith("http") and "ycombinator.com" not in target:
                found.setdefault(target, {"title": x.get("title") or "", "snippet": x.get("content") or x.get("story_text") or ""})
    else:
        for m in re.finditer(r"<a\b([^>]*)>(.*?)</a\s*>(?=(.{0,600}))", body, re.I | re.S):
            a = markup.attributes(m[1])
            href = H.unescape(a.get("href", ""))
            target = urljoin(url, redirect_target(href))
            title = " ".join(H.unescape(re.sub(r"<[^>]*>", " ", m[2])).split())
            host = urlsplit(target).hostname or ""
            if not target.startswith("http") or not title or (engine in _OWN and host.endswith(_OWN[engine])):
                continue
            if (engine in _WANTED and not re.search(_WANTED[engine], target)) or (engine in _TITLE_CLASS and not re.search(_TITLE_CLASS[engine], f"{a.get('class', '')} {m[2]}")):
                continue
            if any(n in target for n in NOISE):
                continue
            text = " ".join(H.unescape(re.sub(r"<[^>]*>", " ", re.split(r"<a\b", m[3], maxsplit=1, flags=re.I)[0])).split())
            found.setdefault(target, {"title": title, "snippet": text[:300]})
    return [{"engine": engine, "url": u, **v, "position": i + 1} for i, (u, v) in enumerate(list(found.items())[: _MOST.get(engine, most)])]


def result_rows(pages: DataFrame, id_col: str, url_col: str, body_col: str) -> DataFrame:
    """(id, position, engine, url, title, snippet) of result pages."""
    names = ("engine", "url", "title", "snippet")
    kind = dict(pages.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_results(u, b) for u, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield _listed(batch, [(i, x["position"], x) for i, items in enumerate(found) for x in items], names)

    return pages.select(F.col(id_col).alias("id"), url_col, body_col).mapInArrow(run, f"id {kind}, position int, " + ", ".join(f"{n} string" for n in names))


def metasearch_rows(responses: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, position, url, title, content): http results of a metasearch answer, the first of each URL. Natively."""
    data = F.from_json(F.col(json_col), "results array<struct<url:string,title:string,content:string>>")
    rows = responses.select(F.col(id_col).alias("id"), F.posexplode(data["results"]).alias("position", "r")).select("id", "position", "r.*").where(F.col("url").rlike("^https?://"))
    return rows.groupBy("id", "url").agg(F.min_by(F.struct("position", "title", "content"), "position").alias("x")).select("id", "x.position", "url", "x.title", "x.content")


_PAGE = re.compile(r"^(?:page|p|pg|pagenum)$")
_OFFSET = re.compile(r"^(?:offset|start|skip)$")


def pagination(url: str | None) -> tuple[str, str | None]:
    """(kind, name): query, offset, cursor, path or none."""
    parts = urlsplit(url or "")
    for k, v in parse_qsl(parts.query):
        if _PAGE.match(k) and v.isdigit():
            return "query", k
        if _OFFSET.match(k) and v.isdigit():
            return "offset", k
        if k == "cursor":
            return "cursor", k
    return ("path", None) if re.search(r"/page/\d+", parts.path) else ("none", None)


def next_page(url: str | None, page_size: int = 20) -> str | None:
    kind, name = pagination(url)
    parts = urlsplit(url or "")
    if kind in ("query", "offset"):
        step = 1 if kind == "query" else page_size
        pairs = [(k, str(int(v) + step) if k == name else v) for k, v in parse_qsl(parts.query, keep_blank_values=True)]
        return urlunsplit(parts._replace(query=urlencode(pairs)))
    if kind == "path":
        return urlunsplit(parts._replace(path=re.sub(r"/page/(\d+)", lambda m: f"/page/{int(m[1]) + 1}", parts.path)))
    return None


def pagination_kind(url: Column) -> Column:
    """query, offset, cursor, path or none. Natively."""
    return (
        F.when(url.rlike(r"[?&](?:page|p|pg|pagenum)=\d+(?:&|#|$)"), "query").when(url.rlike(r"[?&](?:offset|start|skip)=\d+(?:&|#|$)"), "offset")
        .when(url.rlike(r"[?&]cursor="), "cursor").when(url.rlike(r"/page/\d+"), "path").otherwise("none")
    )


def page_size(body: str) -> int:
    n = len(re.findall(r"<article\b", body, re.I))
    return n if 6 <= n <= 99 else 20


def next_link(page: str | None, base: str) -> str | None:
    """rel=next, else the first link whose text, class or label says so."""
    page = page or ""
    for m in re.finditer(r"<(?:a|link)\b([^>]*)>", page, re.I):
        a = markup.attributes(m[1])
        if "next" in a.get("rel", "").lower().split() and a.get("href"):
            return urljoin(base, a["href"])
    for m in re.finditer(r"<a\b([^>]*)>(.*?)</a\s*>", page, re.I | re.S):
        a = markup.attributes(m[1])
        said = " ".join([re.sub(r"<[^>]*>", " ", m[2]), a.get("class", ""), a.get("aria-label", "")]).lower()
        if a.get("href") and ("next" in said or "›" in said or "»" in said):
            return urljoin(base, a["href"])
    return None


def seeds(query: Column, base: str | None, templates: list[str], officials: Column) -> Column:
    """Seed URLs of a query: site-restricted ones for official domains first, then the base's or the templates' ({q} stands for the query)."""
    from webloom.functions.urls import simple_query_encoding

    q = simple_query_encoding(query)
    own = F.transform(officials, lambda d: F.concat(F.lit(templates[0].split("{q}")[0]), q, F.lit("+site:"), d))
    rest = [f"{base.rstrip('/')}/search?q={{q}}&format=json"] if base else templates
    parts = [F.concat(F.lit(t.split("{q}")[0]), q, F.lit(t.split("{q}")[1])) for t in rest]
    return F.concat(own, F.array(*parts))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with blank lines and # or // comments left out; malformed rows are null in every field."""
    lines = spark.read.text(path).where(~F.trim("value").rlike(r"^(?:#|//|$)"))
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")
