"""The texts of a record: its description and the page kept in its raw data."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAGS = "html|head|body|title|meta|link|style|script|noscript|div|p|span|li|ul|ol|dl|dt|dd|a|nav|main|article|aside|footer|header|section|h[1-6]|br|hr|strong|em|b|i|u|small|table|thead|tbody|tr|td|th|img|button|form|input|label|iframe|svg|figure|figcaption|blockquote|pre|code"
TAG = re.compile(rf"(?<!<)<(/?)({_TAGS})\b([^<>]*)>", re.I)
_CLASS = re.compile(r"""\b(?:class|id)\s*=\s*["']?([^"'>]*)""", re.I)
_VOID = {"br", "hr", "img", "input", "meta", "link"}
#: Tags that only dress a piece of text: what holds them is the leaf or the node.
_DRESS = {"a", "b", "i", "em", "strong", "u", "small", "span", "li", "p"}


def page_texts(grants: DataFrame, key: str = "grant_id") -> DataFrame:
    """(key, host, title, field, kind, text): one row per description, live text and HTML page.

    `field` is "description" or "raw_data"; `kind` "text" or "html". Null texts, raw data that is
    no JSON object and missing members give no row.
    """
    page = F.when(F.col("raw_data").contains('"liveBodyText"') | F.col("raw_data").contains('"pageHtml"'), F.from_json("raw_data", "liveBodyText string, pageHtml string"))
    host = F.lower(F.regexp_extract("source_url", r"^[a-zA-Z]+://(?:www\.)?([^/?#]+)", 1))
    rows = grants.select(F.col(key).alias("gm_key"), host.alias("host"), F.coalesce("title", F.lit("")).alias("title"), "description", page.alias("gm_page"))
    part = lambda field, kind, text: F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), F.col(text).alias("text"))
    texts = F.array(part("description", "text", "description"), part("raw_data", "text", "gm_page.liveBodyText"), part("raw_data", "html", "gm_page.pageHtml"))
    rows = rows.select("gm_key", "host", "title", F.explode(F.filter(texts, lambda x: x["text"].isNotNull())).alias("x"))
    return rows.select(F.col("gm_key").alias(key), "host", "title", "x.field", "x.kind", "x.text")


def without_tags(text: str, kind: str) -> str:
    """A text with its tags as line breaks; texts that are no HTML lose the few tags they may have."""
    return TAG.sub("\n", text) if "<" in text else text


def title_key(text: str) -> str:
    """Letters and digits of a title, in lower case."""
    return re.sub(r"[\W_]+", "", text.lower())


def is_title(text: str, own: str) -> bool:
    """Whether a text is the title with this key and nothing else."""
    return bool(own) and len(own) <= len(text) <= 2 * len(own) + 30 and title_key(text) == own


class Line(NamedTuple):
    """A line of a page with the text it shows and where it hangs in the page."""

    number: int
    text: str
    path: str  # tags and classes from the root to the leaf; empty in plain text
    linked: int  # characters inside links
    node: int = 0  # which element of the page holds the leaf


def lines_of(text: str, kind: str) -> list[Line]:
    """The lines of a text that show something, counted from 1 and split at line feeds.

    In HTML the open tags carry over from line to line; entities are decoded. A line's path is
    that of its first visible text.
    """
    if kind != "html":
        return [Line(i, s, "", 0) for i, x in enumerate(text.split("\n"), 1) if (s := x.strip())]
    out, stack, nodes, links, count = [], [], [0], 0, 0
    for i, raw in enumerate(text.split("\n"), 1):
        shown, path, linked, at, node = [], None, 0, 0, 0
        for m in [*TAG.finditer(raw), None]:
            piece = raw[at : m.start() if m else len(raw)]
            if piece.strip():
                s = html.unescape(piece)
                shown.append(s)
                linked += len(s.strip()) if links else 0
                if path is None:
                    path = "/".join(stack)
                    # the leaf is the first element that is no mere dress; its parent holds it
                    k = len(stack)
                    while k > 1 and stack[k - 1].split(".")[0] in _DRESS:
                        k -= 1
                    node = nodes[max(0, k - 1 if k == len(stack) else k)]
            if m is None:
                break
            at, name = m.end(), m[2].lower()
            if m[1]:
                while stack:
                    nodes.pop()
                    top = stack.pop().split(".")[0]
                    links -= top == "a"
                    if top == name:
                        break
            elif name not in _VOID and not m[3].rstrip().endswith("/"):
                c = _CLASS.search(m[3])
                stack.append(name + ("." + c[1].strip().replace(" ", ".") if c and c[1].strip() else ""))
                count += 1
                nodes.append(count)
                links += name == "a"
        if shown:
            out.append(Line(i, " ".join(" ".join(shown).split()), path or "", linked, node))
    return out
