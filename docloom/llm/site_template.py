"""Operator 12, HTML extraction by removal of site templates.

A page is read into its runs of text and its elements, each an interval of runs with a hash
of its subtree (tags, text and children). Container elements (lists, divisions, sections,
tables and the like) are counted per host in Spark: how many pages of the host hold the
subtree, and beside how many different contents, a page's content being its longest block. What recurs beside
LEAST different contents belongs to the site and goes. Inside an article, and on pages that mark
none, it must also be at least half as many contents as pages, so that an article with many near copies
isn't taken for a template; paragraphs and headings alone never are.

What a host shows too seldom to be counted is removed by what its markup says: elements for
menus, page headers, footers, side columns, forms, scripts and styles, and classes, ids and
roles that name them, notices, adverts or comments. Of what is left the text of the article is
taken (``article``, else ``main``, else the body): a block is what lies between
block elements, with its white space as single spaces.

Pages meet their templates by the digest of their row, so that a host with a third of
all pages is dealt like any other, and a page gets no more hashes than it has elements.

Edge cases: null or empty HTML, or one without text, gives an empty text; markup that isn't
closed, cut tags and references are read as browsers do, a cut reference stays as it is; a null
url is the host of the empty string; repeated rows and copies get equal texts, and count as one
content; a tie for the longest block goes to the first; very long pages are read
whole; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from docloom.llm.common import bounded_batches, tidy, written
from docloom.llm.url_filter import host_of

#: Different contents beside which a subtree must recur.
LEAST = 5
#: Templates that are broadcast (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_TEMPLATES = 1_000_000

# What HTML says of its elements.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noframes", "xmp"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li",
    "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "template", "tfoot", "thead", "tr", "ul",
}
#: Elements that an element of the key ends where it begins.
ENDS = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
    "option": {"option"}, "body": {"head"},
}
#: Elements that hold what they end back: an li ends one of its own list only.
HOLDS = {"ul", "ol", "menu", "dl", "table", "select"}
CONTAINERS = {"div", "section", "nav", "aside", "header", "footer", "ul", "ol", "dl", "table", "form", "center", "figure", "details", "fieldset", "menu", "dialog", "search"}
#: Elements that are no part of a text.
OUT = {"script", "style", "noscript", "template", "title", "head", "nav", "footer", "aside", "menu", "dialog", "search", "select", "button", "textarea", "iframe", "noframes", "xmp", "object", "svg", "canvas"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
#: Words of classes and ids.
NAMED = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "sidebar", "sidenav", "widget", "footer", "masthead",
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsbygoogle", "sponsor", "sponsored", "promo", "promotion", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "newsletter", "subscribe", "signup", "login", "search", "share", "sharing", "social", "related", "toolbar",
}
PAGE_HEAD = {"header", "topbar", "masthead"}
TALK = {"comment", "comments", "commentlist", "disqus", "respond", "replies"}

TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)>""")
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
LABEL = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")

# What an element is, beside its tag.
TEXT_ROOT, MAIN_ROOT, DROPPED, DOUBTED = 1, 2, 4, 8


def kind_of(tag: str, attributes: str, in_article: bool) -> int:
    """TEXT_ROOT or MAIN_ROOT, DROPPED (always goes), DOUBTED (goes unless it holds the content)."""
    words, role = set(), ""
    if "=" in attributes:
        for name, *values in LABEL.findall(attributes):
            value = "".join(values)
            if name.lower() == "role":
                role = value.strip().lower()
            else:
                words |= {x.lower() for x in WORDS.findall(value)}
    if tag in ("html", "body"):
        return 0
    if words & TALK:
        return DROPPED
    if tag == "article":
        return TEXT_ROOT
    if tag == "main" or role == "main":
        return MAIN_ROOT
    if tag in OUT or role in ROLES:
        return DROPPED
    if tag == "header" or words & PAGE_HEAD:
        return 0 if in_article else DROPPED
    return DOUBTED if tag == "form" or words & NAMED else 0


class Page:
    """Runs of text (None: a block ends) and elements (tag, kind, first run, last run, hash, in an article, children's runs)."""

    def __init__(self, html: str | None) -> None:
        self.runs: list[str | None] = []
        self.elements: list[tuple[int, int, int, int, str, bool]] = []
        self.open: list[list] = []
        self.depth: dict[str, int] = {}
        self.articles = 0
        self.read(html or "")
        while self.open:
            self.close()

    def read(self, html: str) -> None:
        at, end, tag = 0, len(html), TAG
        last = html.rfind(">")
        while at < end:
            k = html.find("<", at)
            if k < 0:
                k = end
            if k > at:
                self.text(html[at:k])
            if k == end:
                break
            if html.startswith("<!--", k):
                stop = html.find("-->", k + 4)
                at = end if stop < 0 else stop + 3
                continue
            if html.startswith(("<!", "<?"), k):
                stop = html.find(">", k)
                at = end if stop < 0 else stop + 1
                continue
            found = tag.match(html, k)
            if found is None and tag is TAG and LOOSE.match(html, k):
                tag = LOOSE  # a quote isn't closed: from here on a tag ends at the next >
                found = tag.match(html, k)
            if found is None:
                if k > last and (html.startswith("</", k) or html[k + 1 : k + 2].isalpha()):
                    break  # a tag that is cut off
                self.text("" if html.startswith("</", k) else "<")
                at = k + 1 + html.startswith("</", k)
                continue
            at, name = found.end(), found[2].lower()
            if found[1]:
                self.end(name)
                continue
            self.begin(name, found[3])
            if name in RAW and not found[3].endswith("/"):
                stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                inside = html[at : stop.start() if stop else end]
                if name in ("title", "textarea"):
                    self.text(inside)
                at = stop.start() if stop else end

    def text(self, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        self.runs.append(text)
        if self.open:
            said = " ".join(text.split())
            if said:
                self.open[-1][4].append(said)

    def begin(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.runs.append(" ")
            return
        if tag in BLOCK:
            if tag not in ("option",) and self.depth.get("p"):
                self.end("p", implied=True)
            self.runs.append(None)
        if tag in ENDS:
            self.end_before(ENDS[tag])
        if tag in VOID:
            return
        kind = kind_of(tag, attributes, self.articles > 0)
        self.depth[tag] = self.depth.get(tag, 0) + 1
        self.articles += kind & (TEXT_ROOT | MAIN_ROOT) > 0
        # Tag, kind, first run, in an article, what the hash is made of, first and last run of the only child.
        self.open.append([tag, kind, len(self.runs), self.articles > 0, [], None, 0])

    def end_before(self, tags: set[str]) -> None:
        """Close open elements of ``tags`` down to the list or table that the new one is in."""
        for k in range(len(self.open) - 1, max(-1, len(self.open) - 12), -1):
            if self.open[k][0] in HOLDS:
                return
            if self.open[k][0] in tags:
                while len(self.open) > k:
                    self.close()
                return self.end_before(tags)

    def end(self, tag: str, implied: bool = False) -> None:
        if tag in BLOCK:
            self.runs.append(None)
        if not self.depth.get(tag):
            return
        if tag not in BLOCK or implied:  # doesn't close a block that began inside it
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    break
                if self.open[k][0] in BLOCK or self.open[k][0] in HOLDS:
                    return
        while self.open[-1][0] != tag:
            self.close()
        self.close()

    def close(self) -> None:
        tag, kind, first, inside, parts, child, children = self.open.pop()
        self.depth[tag] -= 1
        self.articles -= kind & (TEXT_ROOT | MAIN_ROOT) > 0
        if not parts:
            return
        digest = xxh64_intdigest("\x1f".join((tag, *parts)))
        if self.open:
            self.open[-1][4].append(f"\x1e{digest:x}")
        self.elements.append((kind, first, len(self.runs), digest, tag, inside))

    def longest(self) -> tuple[int, str]:
        """Where the longest block that isn't left out for sure begins, and the block."""
        out = self.hidden(DROPPED)
        best, where = "", 0
        for first, block in self.blocks(out, 0, len(self.runs)):
            if len(block) > len(best):
                best, where = block, first
        return where, best

    def hidden(self, kinds: int) -> bytearray:
        out = bytearray(len(self.runs))
        for kind, first, last, *_ in self.elements:
            if kind & kinds:
                out[first:last] = b"\1" * (last - first)
        return out

    def blocks(self, out: bytearray, first: int, last: int) -> Iterator[tuple[int, str]]:
        held: list[str] = []
        begin = first
        for k in range(first, last):
            run = self.runs[k]
            if run is None:
                if held:
                    if text := " ".join("".join(held).split()):
                        yield begin, text
                    held = []
            elif not out[k]:
                if not held:
                    begin = k
                held.append(run)
        if held and (text := " ".join("".join(held).split())):
            yield begin, text

    def candidates(self, host: int) -> tuple[int, list[int]]:
        """The page's content, and hashes of the containers that may be its site's (odd: inside an article)."""
        marked = any(kind & (TEXT_ROOT | MAIN_ROOT) for kind, *_ in self.elements)
        roots = [(first, last) for kind, first, last, *_ in self.elements if kind & (TEXT_ROOT | MAIN_ROOT)]
        out = {
            mark(host, digest, inside or not marked)
            for kind, first, last, digest, tag, inside in self.elements
            if tag in CONTAINERS and not kind & (TEXT_ROOT | MAIN_ROOT) and not any(first <= a and b <= last for a, b in roots)
        }
        return xxh64_intdigest(self.longest()[1]) - (1 << 63), sorted(out)

    def main_text(self, host: int, templates: set[int]) -> tuple[str, int]:
        """The text, and the number of elements that went as templates."""
        marked = any(kind & (TEXT_ROOT | MAIN_ROOT) for kind, *_ in self.elements)
        out, gone = self.hidden(DROPPED), 0
        where = self.longest()[0]
        for kind, first, last, digest, tag, inside in self.elements:
            site = bool(templates) and tag in CONTAINERS and mark(host, digest, inside or not marked) in templates
            gone += site
            if site or kind & DOUBTED and not first <= where < last:
                out[first:last] = b"\1" * (last - first)
        for wanted in (TEXT_ROOT, MAIN_ROOT, 0):
            roots = [(first, last) for kind, first, last, *_ in self.elements if kind & wanted and not all(out[first:last])] if wanted else [(0, len(self.runs))]
            if roots:
                break
        text, end = [], 0
        for first, last in sorted(roots):
            if first >= end:  # an article within an article is part of it
                text += [block for _, block in self.blocks(out, first, last)]
                end = last
        return "\n".join(text), gone


def mark(host: int, digest: int, inside: bool) -> int:
    """A subtree of a host as a signed 64-bit number, odd inside an article."""
    return (xxh64_intdigest(digest.to_bytes(8, "little"), host) & ~1 | inside) - (1 << 63)


def keys() -> tuple[Column, Column]:
    """128 bits of a page's row."""
    return F.xxhash64("page_id", "url", "html").alias("k1"), F.xxhash64(F.lit("page"), "html", "url", "page_id").alias("k2")


def hosted(batch: pa.RecordBatch) -> Iterator[tuple[int, str | None]]:
    """The host's hash and the HTML of each page."""
    for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
        yield xxh64_intdigest(host), html


def subtrees(pages: DataFrame) -> DataFrame:
    """(k1, k2, content, marks): what each page holds that may be its site's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Page(html).candidates(host) for host, html in hosted(batch)]
            made = [pa.array([c for c, _ in found], pa.int64()), pa.array([m for _, m in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), *made], names=["k1", "k2", "content", "marks"])

    rows = pages.select(*keys(), host_of(F.col("url")).alias("host"), "html")
    return rows.mapInArrow(tidy(run), "k1 long, k2 long, content long, marks array<long>")


def templates(held: DataFrame, least: int = LEAST) -> DataFrame:
    """(mark): subtrees that recur beside ``least`` contents of their host."""
    beside = held.select(F.explode("marks").alias("mark"), "content").groupBy("mark", "content").agg(F.count("*").alias("pages"))
    n = beside.groupBy("mark").agg(F.count("*").alias("contents"), F.sum("pages").alias("pages"))
    return n.where((F.col("contents") >= least) & ((F.col("mark") % 2 == 0) | (2 * F.col("contents") >= F.col("pages")))).select("mark")


def extract(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, text, n_chars, n_templates): the main text of each page."""
    bounded_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")
    held = written(subtrees(pages), "subtrees")
    site = written(templates(held, least), "templates")
    known = F.broadcast(site) if site.count() <= BROADCAST_TEMPLATES else site
    met = held.select("k1", "k2", F.explode("marks").alias("mark")).join(known, "mark").groupBy("k1", "k2").agg(F.collect_set("mark").alias("marks"))
    rows = pages.select("*", *keys(), host_of(F.col("url")).alias("host")).join(met, ["k1", "k2"], "left").select("page_id", "url", "host", "html", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [Page(html).main_text(host, set(marks or ())) for (host, html), marks in zip(hosted(batch), batch.column("marks").to_pylist())]
            text = pa.array([x for x, _ in made], pa.string())
            sizes = pa.array([len(x) for x, _ in made], pa.int64()), pa.array([n for _, n in made], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), text, *sizes], names=["page_id", "url", "text", "n_chars", "n_templates"])

    return rows.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long, n_templates long")
