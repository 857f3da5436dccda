"""Main text of web pages by a site style tree.

Pages are parsed into trees of elements; a branch's *style* is its path of
tags and classes from the root.  Pages of one host are merged into one style
tree by counting, for each host and style, the pages that have the style and
the pages that have each content there.

Presentation decides first: branches whose tag, class, id or role names a
page part that is no article text (menu, footer, advert, form, comments ...)
have no importance, and where a page marks its article (``article``, ``main``,
``articleBody``), the branches outside have none either.  A name is weak
evidence on a layout wrapper: an element that holds the page's article mark is
no page part, whatever its names (see ``_Page.kept``).  All remaining
branches, those inside marked articles and wrappers too, are decided by the
style tree:

* a content that ``c`` of the ``m`` pages with this style share has the
  content importance ``1 - H``, where ``H = log c / log m`` is the normalised
  entropy of the content over the pages: 1 for a content of its own, 0 for one
  that all pages show;
* a style whose pages differ in their contents has the presentation
  importance of the normalised entropy of the contents under it;
* a branch is removed when the mean of both is below ``least``, seen on
  ``MIN_PAGES`` pages or more.

Branches take part in the merge as fixed-size hashes; texts move only for
pages that lose some.  Pages of a host that are alike in all branches count
once: copies of one page say nothing about what a site's pages share.

Cases: null or empty html has the empty text; markup that is never closed ends
with the page; a url without a host is a host of its own name; repeated rows
are extracted each; pages of any size are parsed whole.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .io import BROADCAST_ROWS, lean, prepare, small, table

MIN_PAGES = 4

#: Element names of HTML by the part they play here.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
NO_TEXT = {"head", "nav", "footer", "aside", "form", "template", "svg", "canvas", "object", "audio", "video", "button", "select", "option", "dialog", "menu", "math", "map"}
ARTICLE = {"article", "main"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of classes, ids and roles that name page parts.
PARTS = {
    "ad", "ads", "adsense", "advert", "adverts", "advertisement", "advertising", "alert", "author", "banner", "breadcrumb", "breadcrumbs", "byline", "captcha",
    "comment", "comments", "consent", "contentinfo", "cookie", "cookies", "copyright", "disclaimer", "discussion", "disqus", "dropdown", "footer", "gdpr", "login", "masthead",
    "menu", "menus", "meta", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pager", "pagination", "paywall", "popup",
    "privacy", "promo", "promoted", "promotion", "recommended", "related", "replies", "respond", "responses", "search", "share", "sharing", "sidebar", "signup", "skip",
    "social", "sponsor", "sponsored", "subscribe", "tags", "teaser", "toolbar", "tracking", "widget", "widgets",
}
_HEADERS = {"header", "topbar"}
#: Words beside those that tell a layout wrapper from the part.
LAYOUT = {"body", "box", "col", "cols", "column", "columns", "container", "content", "grid", "has", "layout", "main", "no", "outer", "page", "results", "row", "site", "with", "without", "wrap", "wrapper"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|</?[A-Za-z][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[a-z]+")


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), entities.unescape(value[1:-1] if value[:1] in "\"'" and value else value))
    return out


def _names(attributes: dict[str, str]) -> set[str]:
    text = " ".join(attributes.get(k, "") for k in ("class", "id", "role"))
    return set(_NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", text).lower())) if text.strip() else set()


class _Part:
    """An open element whose names are those of a page part."""

    def __init__(self, layout: bool) -> None:
        self.layout = layout
        self.main = self.article = False  # marks inside
        self.size = 0


class _Page:
    """Text blocks of one page: (text, style, in an article, parts around it)."""

    def __init__(self) -> None:
        self.blocks: list[tuple[str, str, bool, tuple[_Part, ...]]] = []
        # open elements: tag, style, dropped, inside (1 main, 2 article), parts
        self.stack: list[tuple[str, str, bool, int, tuple[_Part, ...]]] = [("", "", False, 0, ())]
        self.marks: list[tuple[_Part, ...]] = []
        self.parts: list[str] = []

    def text(self, raw: str) -> None:
        if not self.stack[-1][2]:
            self.parts.append(entities.unescape(raw))

    def kept(self) -> list[tuple[str, str]]:
        """(text, style) of the blocks that presentation leaves.

        A part that holds ``main`` or ``articleBody``, or an article under a
        layout word, is a wrapper.  Where no text is in an article then, so is
        a part with any article, and in a page without marks one with a layout
        word and most of the text.  Comments and teasers marked as articles
        beside the page's own stay parts."""

        def left(wrapper) -> list[tuple[str, str, bool, tuple[_Part, ...]]]:
            return [b for b in self.blocks if all(wrapper(p) for p in b[3])]

        rules = [lambda p: p.main or p.article and p.layout, lambda p: p.main or p.article]
        for wrapper in rules:
            inside = [(text, style) for text, style, inside, _ in left(wrapper) if inside]
            if inside:
                return inside
        if any(all(map(rules[-1], parts)) for parts in self.marks):
            return []
        total = sum(len(b[0]) for b in self.blocks)
        for text, _, _, parts in self.blocks:
            for p in parts:
                p.size += len(text)
        return [b[:2] for b in left(lambda p: p.layout and 2 * p.size > total)]

    def end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts.clear()
            if text:
                at = len(self.stack) - 1
                while self.stack[at][0] in INLINE:
                    at -= 1
                self.blocks.append((text, self.stack[at][1], self.stack[at][3] > 0, self.stack[at][4]))

    def close(self, depth: int) -> None:
        """Close all open elements from ``depth`` on."""
        if any(tag not in INLINE for tag, *_ in self.stack[depth:]):
            self.end_block()
        del self.stack[depth:]

    def open(self, tag: str, raw: str, closed: bool) -> None:
        if tag in CLOSES_P:
            self._close_open({"p"}, CLOSES_P - {"p"})
        if tag in SIBLINGS:
            self._close_open(SIBLINGS[tag], {"ul", "ol", "dl", "table", "select"})
        if tag not in INLINE:
            self.end_block()
        if tag in VOID or closed and tag not in RAW:
            return
        _, style, dropped, inside, parts = self.stack[-1]
        attributes = _attributes(raw) if raw.strip() else {}
        names = _names(attributes) if attributes else set()
        role = attributes.get("role", "").lower()
        body = tag == "main" or role == "main" or attributes.get("itemprop", "").lower() == "articlebody"
        article = body or tag in ARTICLE or role == "article"
        named = bool(names & PARTS) or bool(names & _HEADERS and not inside) or (tag == "header" and not inside)
        hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        dropped = dropped or hidden or (tag in NO_TEXT and not article)
        if article and not dropped:
            # an article in another one, or named a page part, is not the page's
            if body or not named and inside < 2:
                for p in parts:
                    p.main |= body
                    p.article = True
            inside = max(inside, 1 if body else 2)
            self.marks.append(parts)
        elif named and tag not in ("html", "body"):
            parts += (_Part(bool(names & LAYOUT)),)
        kind = ".".join(sorted(attributes.get("class", "").split()))
        self.stack.append((tag, f"{style}/{tag}.{kind}" if tag not in INLINE else style, dropped, inside, parts))

    def _close_open(self, tags: set[str], until: set[str]) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth][0] in tags:
                self.close(depth)
                return
            if self.stack[depth][0] in until:
                return

    def end(self, tag: str) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth][0] == tag:
                self.close(depth)
                return


def parse(html: str) -> _Page:
    page, at = _Page(), 0
    while True:
        m = _TOKEN.search(html, at)
        if m is None:
            page.text(html[at:])
            break
        if m.start() > at:
            page.text(html[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            page.end(tag)
            continue
        page.open(tag, m[3], m[3].rstrip().endswith("/"))
        if tag in RAW:  # nothing in it is markup, nor text of the article
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            at = close.end() if close else len(html)
            page.end(tag)
    page.close(1)
    page.end_block()
    return page


#: ``mark``: 2 for the first block of its style in the page, 1 for the first
#: with its style and text, 0 for a repeat of one.
_BLOCK = pa.struct([("text", pa.string()), ("style", pa.string()), ("mark", pa.int32())])


def _host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or url or "").lower()
    except ValueError:
        return url or ""


def _blocks(page: _Page) -> list[dict]:
    out: list[dict] = []
    styles: set[str] = set()
    seen: set[tuple[str, str]] = set()
    for text, style in page.kept():
        out.append(dict(text=text, style=style, mark=2 if style not in styles else int((style, text) not in seen)))
        styles.add(style)
        seen.add((style, text))
    return out


def _name(host: str, blocks: list[dict]) -> bytes:
    """The same for pages of a host that are alike in all branches."""
    digest = hashlib.blake2b(digest_size=16)
    for part in (host, *(b[k] for b in blocks for k in ("style", "text"))):
        raw = part.encode("utf-8", "surrogatepass")
        digest.update(len(raw).to_bytes(8, "little") + raw)
    return digest.digest()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in range(0, b.num_rows, 256):
            part = b.slice(s, 256)
            blocks = [_blocks(parse(raw or "")) for raw in part["html"].to_pylist()]
            hosts = [_host(url) for url in part["url"].to_pylist()]
            pages = [_name(host, own) for host, own in zip(hosts, blocks)]
            yield pa.RecordBatch.from_arrays([part["row"], pa.array(hosts, pa.string()), pa.array(pages, pa.binary()), pa.array(blocks, pa.list_(_BLOCK))], names=["row", "host", "page", "blocks"])


def extract(pages: DataFrame, least: float = 0.3) -> DataFrame:
    """``pages`` (url, html and others) with ``main_text``."""
    prepare(pages.sparkSession)
    names = [c for c in pages.columns if c not in ("html", "main_text")]
    packed = pages.select(F.struct(F.lit(0).alias("_"), *names).alias("row"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    row = packed.schema["row"].dataType.simpleString()
    parsed = table(packed.mapInArrow(lean(_parse), f"row {row}, host string, page binary, blocks array<struct<text:string,style:string,mark:int>>"), "pages")

    # the merged tree: pages of a style, pages of a content in a style
    branch = lambda b: F.struct(F.xxhash64(b["style"]).alias("style"), F.xxhash64(b["text"]).alias("content"))
    marked = F.transform(F.filter("blocks", lambda b: b["mark"] > 0), lambda b: F.struct(branch(b).alias("at"), (b["mark"] == 2).alias("lead")))
    shown = parsed.where("size(blocks) > 0").select("page", F.xxhash64("host").alias("host"), marked.alias("branches"))
    each = shown.dropDuplicates(["page"]).select("host", F.explode("branches").alias("b")).select("host", "b.at.*", "b.lead")
    contents = table(each.groupBy("host", "style", "content").agg(F.count("*").alias("c"), F.count_if("lead").alias("leads")), "contents")
    styles = contents.groupBy("host", "style").agg(F.sum("leads").alias("m"), F.sum("c").alias("total"), F.sum(F.col("c") * F.log("c")).alias("clogc")).where(F.col("m") >= MIN_PAGES)
    entropy = F.when(F.col("total") > 1, (F.log("total") - F.col("clogc") / F.col("total")) / F.log("total")).otherwise(F.lit(1.0))
    content = 1 - F.log(F.least("c", "m")) / F.log("m")
    # one part of the mean alone may reach ``least``
    styles = styles.withColumn("entropy", entropy).where(F.col("entropy") < 2 * least).select("host", "style", "m", "entropy")
    often = contents.where("c > 1") if least <= 0.5 else contents
    low = table(often.join(styles, ["host", "style"]).where((content + F.col("entropy")) / 2 < least).select("host", "style", "content"), "low")

    found = shown.select("page", "host", F.explode("branches").alias("b")).select("page", "host", "b.at.*")
    gone = found.join(small(low, BROADCAST_ROWS // 2), ["host", "style", "content"]).groupBy("page").agg(F.collect_set(F.struct("style", "content")).alias("gone"))
    gone = table(gone, "gone")
    hit = small(gone.select("page"))
    losing = parsed.join(hit, "page", "left_semi").join(gone, "page")
    losing = losing.withColumn("blocks", F.filter("blocks", lambda b: ~F.array_contains(F.col("gone"), branch(b))))
    out = parsed.join(hit, "page", "left_anti").select("row", "blocks").unionByName(losing.select("row", "blocks"))
    return out.select(*[F.col("row")[c].alias(c) for c in names], F.array_join(F.transform("blocks", lambda b: b["text"]), " ").alias("main_text"))
