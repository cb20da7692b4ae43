"""HTML functions: native expressions where regular expressions do, a parser in a vectorised UDF elsewhere."""

from __future__ import annotations

from html.parser import HTMLParser
from typing import Any

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tarnweave.functions.text import collapse
from tarnweave.session import ship

# Tags and selectors that hold no main text, and where main text is looked for, in order.
NON_CONTENT = ("script", "style", "noscript", "svg", "img", "picture", "video", "audio", "canvas", "form", "button")
BOILERPLATE = (
    "header", "footer", "nav", "aside", ".navbar", ".nav", ".navigation", ".site-header", ".site-footer", ".footer", "#header", "#footer",
    "#nav", "#navbar", ".cookie", ".cookie-banner", "#cookie-banner", ".banner",
)
MAIN = ("main", "article", "#main", ".main", ".main-content", "#content", ".content", ".page-content", ".layout__content")
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
BLOCKS = ("script", "style", "noscript", "svg", "picture", "video", "audio", "canvas", "form", "button", "header", "footer", "nav", "aside")
CLOSES_P = frozenset({"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "section", "article", "main", "footer", "header", "nav", "aside", "form", "blockquote", "pre"})


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def matches(self, selector: str) -> bool:
        if selector[0] == ".":
            return selector[1:] in (self.attrs.get("class") or "").split()
        if selector[0] == "#":
            return self.attrs.get("id") == selector[1:]
        return self.tag == selector

    def walk(self):
        """This node and all below it, in document order, without recursion."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            if isinstance(node, Node):
                stack.extend(reversed(node.children))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.at.tag == "p" and tag in CLOSES_P:
            self.at = self.at.parent
        if self.at.tag == tag == "li":
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def _elements(root: Node) -> list[Node]:
    return [n for n in root.walk() if isinstance(n, Node)]


def page_language(root: Node) -> str | None:
    """Of <html lang>, else a content-language or language <meta>; the part before `,` and `-`, lower case."""
    found = next((n.attrs.get("lang") for n in _elements(root) if n.tag == "html"), None)
    for key, word in (("http-equiv", "content-language"), ("name", "language")):
        if not found:
            found = next((n.attrs.get("content") for n in _elements(root) if n.tag == "meta" and word in n.attrs.get(key, "").lower()), None)
    return (found or "").strip().lower().split(",")[0].split("-")[0] or None


def without_boilerplate(root: Node) -> Node:
    """Takes non-content tags and boilerplate containers out of the tree, in place."""
    drop = (*NON_CONTENT, *BOILERPLATE)
    for node in _elements(root):
        node.children = [c for c in node.children if not (isinstance(c, Node) and any(c.matches(s) for s in drop))]
    return root


def main_text(root: Node) -> str:
    """Text of the main region of a tree without boilerplate, its pieces joined by one space."""
    nodes = _elements(root)
    region = next((n for s in MAIN for n in nodes if n.matches(s)), None) or next((n for n in nodes if n.tag == "body"), root)
    return " ".join(" ".join(x.strip() for x in region.walk() if isinstance(x, str) and x.strip()).split())


def links(root: Node) -> list[str]:
    return [n.attrs["href"] for n in _elements(root) if n.tag == "a" and "href" in n.attrs]


PARSED = StructType([StructField("lang", StringType()), StructField("text", StringType()), StructField("hrefs", ArrayType(StringType()))])


def _parse_all(html: pd.Series) -> pd.DataFrame:
    rows: list[tuple[Any, ...]] = []
    for h in html:
        root = parse(h)
        lang = page_language(root)
        without_boilerplate(root)
        rows.append((lang, main_text(root), links(root)))
    return pd.DataFrame(rows, columns=["lang", "text", "hrefs"])


def parsed(html: Column) -> Column:
    """Struct `lang, text, hrefs`; links are those left after boilerplate was removed."""
    ship(SparkSession.active())
    return F.pandas_udf(_parse_all, PARSED)(html)


def lang_native(html: Column) -> Column:
    """Language by expressions only: double-quoted attributes, `lang` before other values."""
    tries = [
        r'(?is)<html\b[^>]*?\blang="([^"]*)"',
        r'(?is)<meta\b[^>]*?\bhttp-equiv="[^"]*content-language[^"]*"[^>]*?\bcontent="([^"]*)"',
        r'(?is)<meta\b[^>]*?\bname="[^"]*language[^"]*"[^>]*?\bcontent="([^"]*)"',
    ]
    found = F.coalesce(*(F.nullif(F.regexp_extract(html, t, 1), F.lit("")) for t in tries))
    short = F.substring_index(F.substring_index(F.lower(F.trim(found)), ",", 1), "-", 1)
    return F.nullif(short, F.lit(""))


def text_native(html: Column) -> Column:
    """Text by expressions only: blocks, comments and tags out, the commonest entities decoded."""
    out = html
    for tag in BLOCKS:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    region = F.regexp_extract(out, r"(?is)<main\b[^>]*>(.*)</main>", 1)
    out = F.regexp_replace(F.when(region != "", region).otherwise(out), r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse(out)


def links_native(html: Column) -> Column:
    """All double-quoted hrefs of anchors, boilerplate included."""
    return F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
