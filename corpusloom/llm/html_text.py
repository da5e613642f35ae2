"""HTML extraction by site template removal.

Pages are parsed once into a flat list of elements with the hash of each one's subtree (names, attributes and
text). Block subtrees are counted per host in Spark, a page counting once; subtrees that recur on many pages of a
host, on at least half of these outside the main content, are its template and are deleted, within the main content
too. Elements that say what they are (navigation, header, footer, sidebar, notice, advert, form, script, style,
comments; by name, role, class or id) go anyway. If a page marks its main content (article or main), only that is
kept; what recurs mostly in it is content, as a page's text and its copies are. Such an element and what it lies in
are never template, nor chrome by class or id; but where some articles lie in fewer elements named as chrome than
others do, those are the page's (so that comments marked as articles go).

Defined results: a null html is an empty text, as is a page without text. Broken markup never fails: an end tag
closes the nearest open element of its name, or nothing; a cut-off tag at the end is dropped; a script or style
without an end runs to the end of the page; where a value's quote is never closed, that tag and later ones end at the next >.
Parsing takes time in proportion to the page, however long and broken it is; memory holds one page. A null or odd url has an empty host, which is a host like others.
Hosts with fewer than min_pages copies of a block have no template of it. Repeated pages count as pages. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import BROADCAST_ROWS, cut, small
from corpusloom.llm.url_filter import host_and_path

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: What a tag goes on to: its end, or a value in quotes.
NEXT = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements without content, raw text, blocks, and what is no main text by its name.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
CHROME = frozenset("nav header footer aside form script style noscript template iframe object embed svg canvas button select input textarea dialog menu head title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
WORDS = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo banner cookie cookies consent gdpr notice newsletter subscribe popup modal sidebar sidebars nav navbar navigation menu breadcrumb breadcrumbs footer header masthead comment comments respond disqus share sharing social related widget".split())
#: Parts that a class or id may have besides words of chrome and still be named by these.
PLACES = frozenset("area bar block body bottom box buttons container entry global group holder icons inner item items links list main outer page panel post posts primary respond row secondary section side site slot top unit wrap wrapper".split())
#: An open p ends where one of these begins.
ENDS_P = BLOCK - {"br", "body", "html", "head"}
#: An inline end tag closes nothing beyond these.
WALLS = ("body", "html", "article", "main", "td", "table")
#: What ends an open element of its own kind, unless one of LISTS is between the two.
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = ("ul", "ol", "dl", "table", "tr", "select", "div", "body", "menu")
MAIN = frozenset(("article", "main"))


def _says_chrome(token: str) -> bool:
    """Whether a class or id is a word of chrome: all its parts are, or places and numbers (comment-list, site-header)."""
    parts = [x for x in re.split(r"[-_]+", token.lower()) if x]
    return any(x in WORDS for x in parts) and all(x in WORDS or x in PLACES or x.isdigit() for x in parts)


def _named_chrome(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element says by name, role or state that it is chrome, and whether by class or id."""
    if tag in CHROME:
        return True, False
    if not attrs.strip():
        return False, False
    by_word = False
    for m in ATTRIBUTE.finditer(attrs):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name == "role" and value.strip().lower() in ROLES or name in ("hidden",) or name == "aria-hidden" and value == "true":
            return True, False
        if name in ("class", "id") and tag not in ("body", "html"):
            by_word = by_word or any(map(_says_chrome, value.split()))
    return False, by_word


class Page:
    """Elements in page order as [tag, parent, chrome, hash of the subtree, in main, digest state], and runs of text."""

    def __init__(self, source: str):
        self.tags, self.parents, self.chrome, self.hashes, self.main = ["#"], [-1], [False], [0], [False]
        self.worded = [False]  # named as chrome by class or id
        self.around = [True]  # is or holds main content
        self.runs: list[tuple[int, str]] = []  # element, text; a block boundary is an empty text
        self.has_main = False
        self._parse(source)
        self._settle()

    def _parse(self, source: str) -> None:
        stack, states, blocks = [0], [xxhash.xxh64()], []
        place: dict[str, list[int]] = {}  # where in the stack each name is
        n, last = len(source), source.rfind(">")
        begun = at = 0  # of the text not yet taken, and where to look on
        quotes = True

        def text(piece: str, raw: bool = False) -> None:
            if piece:
                if not raw and "&" in piece:
                    piece = html_lib.unescape(piece)
                states[-1].update(" ".join(piece.split()))
                self.runs.append((stack[-1], piece))

        def nearest(names: tuple[str, ...]) -> int:
            return max((place[x][-1] for x in names if place.get(x)), default=0)

        def close(to: int) -> None:
            while len(stack) > to:
                i, h = stack.pop(), states.pop().intdigest()
                self.hashes[i] = h
                if states:
                    states[-1].update(h.to_bytes(8, "little"))
                tag = self.tags[i]
                if i:
                    place[tag].pop()
                if tag in BLOCK:
                    blocks.pop()
                    self.runs.append((stack[-1], ""))

        def tag_end(pos: int) -> int:
            """Where a tag ends, or -1: beyond values in quotes, as long as all quotes were closed."""
            nonlocal quotes
            if pos > last:
                return -1
            look = pos
            while quotes:
                m = NEXT.search(source, look)
                if m is None:
                    quotes = False
                elif not m[1]:
                    return m.start()
                else:
                    look = source.find(m[1], m.end()) + 1
                    quotes = look > 0
            return source.find(">", pos)

        while (lt := source.find("<", at)) >= 0:
            kind = source[lt + 1 : lt + 2]
            if kind in ("!", "?"):
                text(source[begun:lt])
                mark = "-->" if source.startswith("<!--", lt) else ">"
                end = source.find(mark, lt + 2)
                begun = at = end + len(mark) if end >= 0 else n
                continue
            m = NAME.match(source, lt) if lt < last else None
            end = tag_end(m.end()) if m else -1
            if end < 0:
                if (kind == "/" or kind.isascii() and kind.isalpha()) and lt > last and source.find("<", lt + 1) < 0:
                    text(source[begun:lt])  # a tag cut off at the end
                    begun = n
                    break
                at = lt + 1
                continue
            text(source[begun:lt])
            begun = at = end + 1
            tag, attrs = m[1].lower(), source[m.end() : end]
            if kind == "/":
                if tag == "p" and not place.get("p") or tag == "br":
                    self.runs.append((stack[-1], ""))
                k = nearest((tag,))
                if k and (tag in BLOCK or k > nearest(WALLS)):
                    close(k)
                continue
            if tag in ENDS_P and blocks and self.tags[stack[blocks[-1]]] == "p":
                close(blocks[-1])
            if tag in ITEMS:
                k = nearest(ITEMS[tag])
                if k and k > nearest(tuple(x for x in LISTS if x != tag)):
                    close(k)
            i = len(self.tags)
            parent = stack[-1]
            self.tags.append(tag)
            self.parents.append(parent)
            named, worded = _named_chrome(tag, attrs)
            self.chrome.append(self.chrome[parent] or named)
            self.worded.append(worded)
            self.hashes.append(0)
            if tag in BLOCK:
                self.runs.append((parent, ""))
            state = xxhash.xxh64(f"<{tag} {' '.join(attrs.split())}>")
            if tag in VOID or attrs.endswith("/") and tag not in BLOCK | RAW:
                self.hashes[i] = state.intdigest()
                states[-1].update(self.hashes[i].to_bytes(8, "little"))
                continue
            if tag in BLOCK:
                blocks.append(len(stack))
            place.setdefault(tag, []).append(len(stack))
            stack.append(i)
            states.append(state)
            if tag in RAW:
                done = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                text(source[at : done.start()] if done else source[at:], raw=tag not in ("title", "textarea"))
                begun = at = done.end() if done else n
                close(len(stack) - 1)
        text(source[begun:])
        close(1)

    def _settle(self) -> None:
        """Finds the main content, and with it what is chrome by class or id."""
        n = len(self.tags)
        doubt = [0] * n  # elements named so, from the page down to here
        for i in range(1, n):
            doubt[i] = doubt[self.parents[i]] + self.worded[i]
        mains = [i for i in range(1, n) if self.tags[i] in MAIN and not self.chrome[i]]
        mains = [i for i in mains if not self.worded[i]] or mains
        holds = [False] * n
        for i in mains:
            k = self.parents[i]
            while k >= 0 and not holds[k]:
                holds[k] = True
                k = self.parents[k]
        mains = [i for i in mains if not holds[i]]  # the inner ones
        least = min((doubt[i] for i in mains), default=0)
        self.around = [False] * n
        for k in mains:
            while doubt[k] <= least and k >= 0 and not self.around[k]:
                self.around[k] = True
                k = self.parents[k]
        for i in range(1, n):
            up = self.parents[i]
            self.chrome[i] = self.chrome[i] or self.chrome[up] or (self.worded[i] and not self.around[i])
            self.main.append(self.main[up] or (self.tags[i] in MAIN and not self.chrome[i]))
        self.has_main = any(self.main)

    def template_hashes(self) -> dict[int, bool]:
        """Subtrees that may be template, and whether they stand outside the main content."""
        out: dict[int, bool] = {}
        for t, h, m, around in zip(self.tags, self.hashes, self.main, self.around, strict=True):
            if h and t in BLOCK and t not in ("html", "head", "body", "br", "hr", "article", "main") and not around:
                out[h] = out.get(h, False) or not m
        return out

    def text(self, template: frozenset[int] | set[int] = frozenset()) -> str:
        gone = list(self.chrome)
        for i in range(1, len(gone)):
            gone[i] = gone[i] or gone[self.parents[i]] or (self.tags[i] not in MAIN and not self.around[i] and self.hashes[i] in template)
        out = []
        for i, piece in self.runs:
            if not piece:
                out.append(" ")
            elif not gone[i] and (self.main[i] or not self.has_main):
                out.append(piece)
        return " ".join("".join(out).split())


def host_of(url):
    return host_and_path(url)[0]


def template_subtrees(pages: DataFrame, min_pages: int = 8, min_share: float = 0.2) -> DataFrame:
    """(host, subtree): blocks found on at least min_pages pages and min_share of the pages of a host, and on at least
    half of those pages outside the main content."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, hashes, outside = [], [], []
            for host, source in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = Page(source.as_py()).template_hashes()
                hosts += [host] * (len(found) + 1)
                hashes += [None, *(h - (1 << 63) for h in found)]  # null: the page itself
                outside += [1, *map(int, found.values())]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(outside, pa.int32())], ["host", "subtree", "outside"])

    counts = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, "host string, subtree bigint, outside int")
    counts = counts.groupBy("host", "subtree").agg(F.count("*").alias("count"), F.sum("outside").alias("outside"))
    counts = cut(counts.where(F.col("subtree").isNull() | (F.col("count") >= min_pages) & (2 * F.col("outside") >= F.col("count"))))
    total = counts.where("subtree IS NULL").select("host", F.col("count").alias("n_pages"))
    return counts.where("subtree IS NOT NULL").join(total, "host").where(F.col("count") >= min_share * F.col("n_pages")).select("host", "subtree")


def extract(pages: DataFrame, min_pages: int = 8, min_share: float = 0.2) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    template = cut(template_subtrees(pages, min_pages, min_share).groupBy("host").agg(F.collect_list("subtree").alias("__subtrees")))  # at most (elements of a page) / min_share a host
    if small(template.select(F.explode("__subtrees")), BROADCAST_ROWS):
        template = F.broadcast(template)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host")).join(template, "host", "left")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [Page(s.as_py()).text({h + (1 << 63) for h in t.as_py() or ()}) for s, t in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "__subtrees").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
