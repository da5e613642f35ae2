"""HTML to text by the standard library's parser, in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Elements that begin and end a line, page chrome by class, and elements without text.
LINE_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p div pre blockquote br hr ul ol li dl dt dd table thead tbody tr th td caption".split())
CHROME_CLASSES = frozenset(("navheader", "navfooter"))
SILENT_TAGS = frozenset(("script", "style"))
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLANK_RUN = re.compile(r"\n{3,}")


class _Text(HTMLParser):
    """Collects text, a line feed around line elements; inside dropped subtrees only depth is kept."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.body: list[str] | None = None
        self.open: list[tuple[str, bool]] = []  # element, whether it is dropped with all below

    def _dropped(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    def handle_starttag(self, tag, attrs):
        classes = set((dict(attrs).get("class") or "").split())
        drop = self._dropped() or tag in SILENT_TAGS or bool(classes & CHROME_CLASSES) or (tag == "a" and "id_link" in classes)
        if tag == "body" and self.body is None:
            self.parts, self.body = [], []
        if tag in LINE_TAGS and not drop:
            self.parts.append("\n")
        if tag not in VOID_TAGS:
            self.open.append((tag, drop))
        elif tag in LINE_TAGS and not drop:
            self.parts.append("\n")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None:
            return
        dropped = self.open[at][1]
        del self.open[at:]
        if tag in LINE_TAGS and not dropped:
            self.parts.append("\n")
        if tag == "body" and self.body is not None and not self.body:
            self.body = list(self.parts)

    def handle_data(self, data):
        if not self._dropped():
            self.parts.append(data)

    def text(self) -> str:
        return "".join(self.body or self.parts)


def html_to_text(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    lines = (x.strip() for x in parser.text().replace("\xa0", " ").splitlines())
    return BLANK_RUN.sub("\n\n", "\n".join(lines)).strip()


@F.pandas_udf(StringType())
def _convert(html: pd.Series) -> pd.Series:
    return html.map(html_to_text, na_action="ignore")


def extract_text(html: Column) -> Column:
    return _convert(html)


def strip_tags(html: Column) -> Column:
    """A plain variant in regular expressions that Java and RE2 read alike: scripts, styles, comments and tags go,
    a few references are decoded, white space is squeezed."""
    t = html
    for pattern, to in STRIP_RULES:
        t = F.regexp_replace(t, pattern, to)
    return F.btrim(t)


#: Patterns of strip_tags, in order.
STRIP_RULES = (
    (r"(?is)<script[^>]*>.*?</script>", " "), (r"(?is)<style[^>]*>.*?</style>", " "), (r"(?s)<!--.*?-->", " "), (r"(?s)<[^>]*>", " "),
    (r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;", "\""), (r"&nbsp;", " "), (r"&copy;", "©"), (r"&middot;", "·"), (r"&amp;", "&"), (r"[ \t\r\n\f]+", " "),
)
