"""Text, links and sections of HTML, with the standard parser, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Elements whose text nobody reads, and those that begin a new line (fixed values).
DROPPED = {"script", "style", "iframe", "noscript", "nav", "footer", "header", "svg"}
BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "blockquote"}
_IS_HTML = re.compile(r"<[a-z][\s\S]*>", re.I)
LINKS = ArrayType(StructType([StructField("url", StringType()), StructField("text", StringType())]))
SECTIONS = ArrayType(StructType([StructField("heading", StringType()), StructField("body", StringType())]))


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0
        self.links: list[list[str]] = []
        self.open_link: list[str] | None = None
        self.parts: list[list[str]] = []
        self.in_heading = False

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.hidden += 1
        if tag == "br" or tag in BLOCKS:
            self._say("\n")
        if tag == "a" and (href := dict(attrs).get("href")):
            self.open_link = [href, ""]
        if re.fullmatch(r"h[1-6]", tag) and not self.hidden:
            self.parts.append(["", ""])
            self.in_heading = True

    def handle_endtag(self, tag):
        if tag in DROPPED and self.hidden:
            self.hidden -= 1
        if tag in BLOCKS:
            self._say("\n")
        if tag == "a" and self.open_link:
            self.links.append(self.open_link)
            self.open_link = None
        if re.fullmatch(r"h[1-6]", tag):
            self.in_heading = False

    def handle_data(self, data):
        if self.open_link is not None:
            self.open_link[1] += data
        self._say(data)

    def _say(self, data):
        if self.hidden:
            return
        self.out.append(data)
        if self.parts:
            self.parts[-1][0 if self.in_heading else 1] += data


def _read(html: str) -> _Reader:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader


def tidy(text: str) -> str:
    """Single spaces, no spaces at line ends, at most one blank line."""
    text = re.sub(r"[ \t\xa0]+", " ", text)
    text = re.sub(r" ?\n ?", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


#: Longest text kept of a page, unless asked otherwise.
MOST = 2000


def text_of(html: str | None, most: int | None = MOST) -> str | None:
    """The readable text of HTML; other texts with their white space collapsed. At most `most` characters, all for None."""
    if html is None:
        return None
    text = tidy("".join(_read(html).out)) if _IS_HTML.search(html) else " ".join(html.split())
    return text if most is None else text[:most]


def links_of(html: str | None, base: str | None) -> list[dict]:
    """The links of a page as absolute addresses with their text, in order, each address once."""
    out, seen = [], set()
    for href, text in _read(html).links if html else []:
        try:
            url = urljoin(base or "", href.strip())
        except ValueError:
            continue
        if re.match(r"(?i)https?://", url) and url not in seen:
            seen.add(url)
            out.append({"url": url, "text": " ".join(text.split())})
    return out


def sections_of(html: str | None) -> list[dict]:
    """The headings of a page with the text up to the next heading."""
    return [{"heading": " ".join(h.split()), "body": tidy(b)} for h, b in (_read(html).parts if html else []) if h.strip()]


@F.pandas_udf(StringType())
def html_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """text_of over a column."""
    for s in pages:
        yield s.map(text_of)


@F.pandas_udf(LINKS)
def page_links(pages: pd.Series, bases: pd.Series) -> pd.Series:
    """links_of over a column of pages and one of their addresses."""
    return pd.Series([links_of(p, b) for p, b in zip(pages, bases)], dtype="object")


@F.pandas_udf(SECTIONS)
def page_sections(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """sections_of over a column."""
    for s in pages:
        yield pd.Series([sections_of(p) for p in s], dtype="object")
