"""Main text of web pages: structure and nearest-URL page differencing."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import frugal, neighbour_partitions, ranges

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Elements whose text is never the article's.
OUTSIDE = {"nav", "footer", "aside", "form", "button", "select", "noscript", "template", "svg", "math", "dialog", "menu", "object", "canvas", "video", "audio", "head", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
#: Words of class and id names that mark menus, notices, adverts, comments and the like.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "notice", "gdpr", "popup", "modal", "newsletter", "subscribe", "signup", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "comment", "comments", "reply", "replies", "respond", "disqus", "share", "sharing", "social", "related", "recommended", "recommendations", "widget", "toolbar", "pagination", "pager", "login", "search", "hidden", "copyright", "alert", "disclaimer", "toc"}
_WORDS = re.compile(r"[a-z]+")
#: These hold the page or the article, whatever their class.
_NEVER_MARKED = {"html", "body", "article", "main", "h1"}
_SELF_CLOSING = {"p", "li", "dt", "dd", "option", "tr", "td", "th"}


def _outside(tag: str, attributes: str, within: bool) -> bool:
    if tag in OUTSIDE or tag == "header" and not within:
        return True
    if not attributes.strip():
        return False
    got = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    if "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "").lower():
        return True
    if got.get("role", "").lower() in ROLES:
        return True
    names = f"{got.get('class', '')} {got.get('id', '')}".lower()
    return (tag != "article" or within) and tag not in _NEVER_MARKED - {"article"} and any(w in MARKS for w in _WORDS.findall(names))


def page_lines(source: str | None) -> list[tuple[str, int]]:
    """Text lines in page order, each with 0 outside the article by structure, 1 in no marked place, 2 in an article or main element."""
    source = source or ""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    closed, depth, within, at = "", 0, [], 0  # the element that is left out, its nesting, open article and main elements

    def flush():
        line = " ".join("".join(text).split())
        if line:
            out.append((line, 0 if closed else 2 if within else 1))
        text.clear()

    end_of_tags = source.rfind(">") + 1  # beyond it nothing is a tag, and no tag need be looked for
    found = _TOKEN.search(source, 0, end_of_tags)
    while found:
        if found.start() > at:
            text.append(html.unescape(source[at : found.start()]))
        at = found.end()
        if found[0].startswith("<!--") and not found[0].endswith("-->"):  # never closed
            at = len(source)
            break
        tag = (found[2] or found[5] or "").lower()
        if tag:
            ending, attributes = found[1] or found[4], found[3] or found[6] or ""
            if tag in BLOCK:
                flush()
            if ending:
                if closed:
                    depth -= tag == closed
                    if not depth or tag in ("body", "html"):
                        closed = ""
                elif tag in ("article", "main") and tag in within:
                    while within.pop() != tag:
                        pass
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
            elif tag not in VOID and not attributes.endswith("/"):
                if closed in _SELF_CLOSING and tag in BLOCK:
                    closed = ""
                if closed:
                    depth += tag == closed
                elif _outside(tag, attributes, bool(within)):
                    flush()
                    closed, depth = tag, 1
                elif tag in ("article", "main"):
                    within.append(tag)
        found = _TOKEN.search(source, at, end_of_tags)
    text.append(html.unescape(source[at:].partition("<!--")[0]))
    flush()
    return out


def shared_lines(own: list[str], other: list[str]) -> set[int]:
    """Indexes of own lines in a longest common subsequence with other lines (bit-parallel, one word operation a line)."""
    head = 0
    while head < min(len(own), len(other)) and own[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(len(own), len(other)) - head and own[-1 - tail] == other[-1 - tail]:
        tail += 1
    found = {*range(head), *range(len(own) - tail, len(own))}
    a, b = own[head : len(own) - tail], other[head : len(other) - tail]
    if not a or not b:
        return found
    places: dict[str, int] = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows, v = [], full
    for line in a:
        hit = v & places.get(line, 0)
        v = ((v + hit) | (v - hit)) & full
        rows.append(v)
    j = len(b) - 1
    for i in range(len(a) - 1, -1, -1):  # a zero bit: the subsequence gets longer there
        while j >= 0 and rows[i] >> j & 1:
            j -= 1
        if j < 0:
            break
        above = rows[i - 1] if i else full
        if above >> j & 1:
            found.add(head + i)
            j -= 1
    return found


def common_prefix(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def choose(lines: list[tuple[str, int]], shared: set[int]) -> str:
    """The article's lines. With an article or main element those within it; else lines in no marked place and not shared with the nearest page, or, if all are shared, the unmarked ones."""
    if any(k == 2 for _, k in lines):
        return " ".join(t for t, k in lines if k == 2)
    plain = [(i, t) for i, (t, k) in enumerate(lines) if k == 1]
    return " ".join([t for i, t in plain if i not in shared] or [t for _, t in plain])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_lines, n_shared of every page.

    Pages are sorted by host, path and page_id; each is compared with that neighbour on its host whose path
    has the longer common prefix (on ties the one before), and shared lines are found by longest common
    subsequence. Shared lines outside an article or main element are deleted; inside one they stay, as copies
    of an article share all of it. A null html is empty, a null url a host and path without characters; a
    null page_id sorts first; of rows equal in url and page_id input order decides. Extra columns are
    ignored. html is shuffled once, by key range.
    """
    bare = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$", "")
    host, path = F.lower(F.substring_index(bare, "/", 1)), F.regexp_extract(bare, r"^[^/]*(/.*)?$", 1)
    key = F.concat(host, F.lit("\u0001"), path, F.lit("\u0001"), F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, "0"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", key.alias("key_"))
    dealt = neighbour_partitions(rows, "key_", ranges(pages.sparkSession))
    columns = [("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_lines", pa.int32()), ("n_shared", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]):
        def parsed():
            for b in batches:
                for page, url, source, key, role in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "key_", "role_")), strict=True):
                    host, path, _ = key.rsplit("\u0001", 2) if key.count("\u0001") == 2 else (key, "", "")
                    yield page, url, page_lines(source), host, path, role

        def report(before, now, after):
            best = max((x for x in (before, after) if x and x[3] == now[3]), key=lambda x: common_prefix(x[4], now[4]), default=None)
            shared = shared_lines([t for t, _ in now[2]], [t for t, _ in best[2]]) if best else set()
            text = choose(now[2], shared)
            return now[0], now[1], text, len(text), len(now[2]), len(shared)

        def all_rows():
            before = now = None
            for after in parsed():
                if now and now[5] == 0:
                    yield report(before, now, after)
                if after[5] > 0:
                    return
                before, now = now, after
            if now and now[5] == 0:
                yield report(before, now, None)

        out, size = [], 0
        for row in all_rows():
            out.append(row)
            size += row[3]
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), columns, strict=True)], [n for n, _ in columns])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), columns, strict=True)], [n for n, _ in columns])

    return dealt.select("page_id", "url", "html", "key_", "role_").mapInArrow(frugal(run), "page_id long, url string, text string, n_chars long, n_lines int, n_shared int")
