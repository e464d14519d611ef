"""Main-text extraction: page structure first, then a suffix array per host over what structure leaves open.

A scanner cuts each page into blocks of four zones: ``main`` (within an article or main element), ``chrome`` (menus, headers,
footers, sidebars, notices, adverts, forms, comments), ``open`` (neither) and ``doubt`` (within an article, under a class or
id that may name chrome or a subject: share, social, related, notice). A page with main blocks is its article. On a page
without, open blocks are the candidates. Of open and doubtful blocks what the host repeats is boilerplate: the token streams of
all the host's blocks outside articles, and of its doubtful ones, are put into a suffix array, suffixes that agree in
``REPEAT`` tokens or more with a suffix of another page are marked, the marked runs are removed and the unique runs kept.
Main blocks are never touched by it: articles that quote or copy each other stay whole, since a passage shared within
articles is no boilerplate.

A token lies in a substring of ``REPEAT`` or more tokens that occurs elsewhere just if some window of ``REPEAT`` tokens that
covers it does. So the suffixes are ordered by their first ``REPEAT`` tokens' hash within each host: equal neighbours are the
repeated prefixes, longer ones are runs of them, and no host is gathered in one place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import map_rows, materialize

#: Tokens from which a substring that another page of the host has too is boilerplate.
REPEAT = 8
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]{0,4096}"|'[^']{0,4096}')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>]|\Z)""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
#: Element names of HTML.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr", "br"}
CONTAINER = {"html", "body", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "menu", "dl", "table", "tbody", "thead", "tfoot", "tr", "figure", "details", "dialog", "fieldset", "blockquote", "center", "noscript", "template", "svg", "math", "head", "select", "button", "object", "audio", "video", "canvas"}
DROPPED = {"nav", "footer", "aside", "form", "menu", "dialog", "noscript", "template", "svg", "math", "head", "select", "button", "object", "audio", "video", "canvas", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Words of a class or id that name chrome anywhere, those that may also name a subject, and those that name chrome outside articles only.
CHROME = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "gdpr", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "comment", "comments", "disqus", "newsletter", "subscribe", "popup", "modal", "signup", "login", "paywall", "pagination"}
DOUBTFUL = {"notice", "share", "sharing", "social", "related", "subscription", "widget"}
OUTSIDE = {"header", "banner", "masthead", "topbar", "toolbar", "search"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


@dataclass
class _Open:
    """An open element, with what holds inside it (its ancestors' marks included) and the place of the innermost container up to it."""

    name: str
    chrome: bool
    main: bool
    doubt: bool
    header: bool
    #: Chrome for another reason than a header.
    beyond: bool
    container: int
    #: Of an inline element: the text of its block so far, which goes on after it.
    held: list[str] | None = None


@dataclass
class Page:
    blocks: list[tuple[str, str]] = field(default_factory=list)

    def texts(self, *zones: str) -> list[str]:
        return [t for z, t in self.blocks if z in zones]


def parse(source: str) -> Page:
    """Blocks of a page in order, in time linear in its length. Unclosed and stray tags, quotes without an end and truncated pages are tolerated."""
    page, stack, pieces, at = Page(), [], [], 0
    places: dict[str, list[int]] = {}
    zone = "open"
    root = _Open("", False, False, False, False, False, -1)

    def flush() -> None:
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                page.blocks.append((zone, text))

    def now() -> str:
        e = stack[-1] if stack else root
        return "chrome" if e.chrome else ("doubt" if e.doubt else "main") if e.main else "open"

    def push(name: str, chrome: bool = False, main: bool = False, doubt: bool = False, header: bool = False, held: list[str] | None = None) -> None:
        up = stack[-1] if stack else root
        places.setdefault(name, []).append(len(stack))
        container = len(stack) if name in CONTAINER else up.container
        stack.append(_Open(name, up.chrome or chrome, up.main or main, up.doubt or doubt, up.header or header, up.beyond or chrome and not header, container, held))

    def close(i: int) -> None:
        nonlocal zone
        flush()
        for e in stack[i:]:
            places[e.name].pop()
            if e.held is not None:
                pieces.extend([*e.held, " "])
        del stack[i:]
        zone = now()

    while found := _TAG.search(source, at):
        if found.start() > at:
            pieces.append(source[at : found.start()])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            if found[0].startswith("<![CDATA["):
                pieces.append(found[0][9:].removesuffix("]]>"))
            continue
        closing, said = bool(found[1] or found[4]), found[3] or found[6] or ""
        if name in INLINE and not (stack and stack[-1].name == name) and (closing or "=" not in said and "hidden" not in said.lower()):
            if name == "br":
                pieces.append(" ")
            continue
        if closing:
            if name not in INLINE:
                while stack and stack[-1].name in INLINE:
                    close(len(stack) - 1)
                flush()
            i = places[name][-1] if places.get(name) else -1
            if i >= 0 and (name in CONTAINER or stack[-1].container <= i):
                close(i)
            continue
        if name not in INLINE:
            # A block ends a marked paragraph, list item or inline element that was left open.
            while stack and stack[-1].name not in CONTAINER:
                close(len(stack) - 1)
            flush()
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        attributes = {k.lower(): (v or "").strip("\"'").lower() for k, v in _ATTRIBUTE.findall(said)}
        named = {*_SPLIT.split(attributes.get("class", "")), *_SPLIT.split(attributes.get("id", ""))}
        up = stack[-1] if stack else root
        role, inside = attributes.get("role", ""), up.main
        chrome = name in DROPPED or role in ROLES or bool(named & CHROME) or "hidden" in attributes or attributes.get("aria-hidden") == "true" or not inside and (name == "header" or bool(named & (OUTSIDE | DOUBTFUL)))
        doubt = inside and bool(named & DOUBTFUL)
        # Whole bodies are often classed for their layout; that says nothing of what they hold.
        if name in ("html", "body"):
            chrome = doubt = False
        main = not chrome and (name in ("article", "main") or role in ("main", "article"))
        header = inside and name == "header"
        if header or up.header and name in HEADINGS:
            # Of a header within an article its headings belong to the article.
            flush()
            push(name, header, header=header)
            zone = ("chrome" if up.beyond else "main") if name in HEADINGS else now()
            continue
        if name in INLINE and (chrome or doubt) and name not in VOID:
            push(name, chrome, main, doubt, held=[*pieces])
            pieces.clear()
            zone = now()
        elif name not in VOID and name not in INLINE and (name in CONTAINER or chrome or main or doubt):
            push(name, chrome, main, doubt)
            zone = now()
    pieces.append(re.sub(r"<[a-zA-Z/!][^<]*\Z", "", source[at:]))
    flush()
    return page


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def window_hashes(tokens: list[str], width: int = REPEAT) -> list[int]:
    """Hashes of all windows of ``width`` tokens, of the whole stream if it is shorter."""
    n = len(tokens)
    return [xxhash.xxh64_intdigest("\x1f".join(tokens[i : i + width])) - (1 << 63) for i in range(max(1, n - width + 1))] if n else []


def _windows(page: Page) -> list[int]:
    """Windows of all that lies outside articles, as one stream, and of each doubtful block for itself."""
    out = window_hashes(" ".join(page.texts("open", "chrome")).split())
    for block in page.texts("doubt"):
        out += window_hashes(block.split())
    return out


def _scan(pages: DataFrame, page: str, url: str, html: str) -> DataFrame:
    """(key, url, mark, host, main, open, stream): mark is the page's hash; main holds the article's blocks, each with its zone
    (null if there is none), open the candidates where there is none, stream the windows that the host may repeat."""
    kind = pages.schema[page].dataType.simpleString()
    zoned = pa.list_(pa.struct([("zone", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for u, h in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                source = h.as_py() or ""
                found = parse(source)
                main = [{"zone": z, "text": t} for z, t in found.blocks if z in ("main", "doubt")]
                whole = any(b["zone"] == "main" for b in main)
                rows.append((xxhash.xxh64_intdigest(source) - (1 << 63), host_of(u), main if whole else None, [] if whole else found.texts("open"), _windows(found)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.string(), zoned, pa.list_(pa.string()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["key", "url", "mark", "host", "main", "open", "stream"])

    picked = pages.select(F.col(page).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    return map_rows(picked, run, f"key {kind}, url string, mark long, host string, main array<struct<zone:string,text:string>>, open array<string>, stream array<long>")


def repeated_runs(scanned: DataFrame) -> DataFrame:
    """(host, suffix): the windows that begin suffixes of two or more different pages of a host.

    Pages with the same stream count as one, so mirrored pages don't make each other boilerplate. Each host's windows meet
    by hash with partial aggregation: a host of any size is spread over all tasks.
    """
    suffixes = scanned.select("host", F.xxhash64("stream").alias("page"), F.explode("stream").alias("suffix"))
    return suffixes.groupBy("host", "suffix").agg(F.min("page").alias("a"), F.max("page").alias("b")).where("a <> b").select("host", "suffix")


def unique_runs(blocks: list[str], marked: set[int], apart: bool) -> list[str]:
    """Blocks without the tokens that marked windows cover; windows run over all blocks, or ``apart`` within each."""
    tokens = [b.split() for b in blocks]
    streams = tokens if apart else [[t for b in tokens for t in b]]
    covered = []
    for stream in streams:
        part = [False] * len(stream)
        for i, h in enumerate(window_hashes(stream)):
            if h in marked:
                part[i : i + REPEAT] = [True] * len(part[i : i + REPEAT])
        covered += part
    left, at = [], 0
    for b in tokens:
        left.append(" ".join(t for t, c in zip(b, covered[at : at + len(b)], strict=True) if not c))
        at += len(b)
    return left


def extract(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page, url, text, n_chars): the main text of every page, one row for each.

    Null and empty pages give an empty text. Null urls share one nameless host. Repeated rows give repeated rows. Only pages
    without an article, or with doubtful blocks in it, take the way over their host's suffix array; those blocks alone are
    joined, not whole pages. Each page is parsed once.
    """
    kind = pages.schema[page].dataType.simpleString()
    scanned = materialize(_scan(pages, page, url, html), "scanned")
    unsure = F.col("main").isNull() | F.exists("main", lambda b: b["zone"] == "doubt")
    loose = scanned.where(unsure)
    windows = map_rows(loose.select("host", "mark", "main", "open"), _loose_windows, "host string, mark long, suffix long")
    met = windows.distinct().join(repeated_runs(scanned), ["host", "suffix"]).groupBy("host", "mark").agg(F.collect_set("suffix").alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for main, blocks, found in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                marked = set(found or ())
                if main is None:
                    left = unique_runs(blocks, marked, False)
                else:
                    doubt = iter(unique_runs([b["text"] for b in main if b["zone"] == "doubt"], marked, True))
                    left = [b["text"] if b["zone"] == "main" else next(doubt) for b in main]
                texts.append("\n".join(t for t in left if t))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["key", "url", "text"])

    rest = map_rows(loose.select("key", "url", "main", "open", "host", "mark").join(met, ["host", "mark"], "left").select("key", "url", "main", "open", "found"), run, f"key {kind}, url string, text string")
    whole = scanned.where(~unsure).select("key", "url", F.array_join(F.transform("main", lambda b: b["text"]), "\n").alias("text"))
    return whole.unionByName(rest).select(F.col("key").alias(page), "url", "text", F.length("text").cast("long").alias("n_chars"))


def _loose_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, marks, found = [], [], []
        for h, m, main, blocks in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            streams = [" ".join(blocks)] if main is None else [b["text"] for b in main if b["zone"] == "doubt"]
            own = [w for s in streams for w in window_hashes(s.split())]
            hosts += [h] * len(own)
            marks += [m] * len(own)
            found += own
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(marks, pa.int64()), pa.array(found, pa.int64())], names=["host", "mark", "suffix"])
