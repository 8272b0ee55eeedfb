"""A page as a tree: content root, link classes, blocks of its sections, and chunks for a reader that sees tokens only.

All is linear in the page: what an element stands in is kept when it opens, texts are read once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from cartoloom.functions.pages import slices

# Elements without an end, and blocks; blocks of text, those of running text among them; headings.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("p div ul ol li table thead tbody tr td th h1 h2 h3 h4 h5 h6 section article aside header footer nav blockquote figure form dl dt dd main pre figcaption".split())
RUNNING = frozenset("p li td th dd blockquote figcaption div".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT = RUNNING | HEADINGS | {"dt", "pre"}
# What in a class or id marks the content, and each kind of container, in the order of checks; elements that are one.
ROOTS = ("ct-inner-content", "entry-content", "post-content", "article-content", "wp-block-post-content", "elementor-widget-theme-post-content")
CONTAINERS = {
    "header": ("oxy-header", "site-header", "masthead", "elementor-location-header"),
    "footer": ("site-footer", "colophon", "elementor-location-footer"),
    "breadcrumb": ("breadcrumb", "rank-math-breadcrumb", "yoast-breadcrumb"),
    "nav": ("menu", "navigation", "navbar", "nav-links-main"),
    "toc": ("lwptoc", "ez-toc", "toc_container", "rank-math-toc", "table-of-contents", "wp-block-table-of-contents", "toc-"),
    "author_box": ("saboxplugin", "author-box", "about-author", "abh_box", "author-bio", "vcard author"),
    "pagination": ("repeater-pages", "page-numbers", "pagination", "nav-links", "post-navigation"),
    "related_repeater": ("oxy-dynamic-list", "oxy-repeater", "_dynamic_list", "related-posts", "related_posts", "yarpp", "jp-relatedposts", "crp_related", "wp-block-latest-posts", "wp-block-query", "elementor-posts"),
    "sidebar": ("sidebar", "widget-area", "widget_"),
}
ELEMENTS = {"header": "header", "footer": "footer", "nav": "nav", "aside": "sidebar"}
# Elements whose text is no text of a section; containers that no section enters; levels that open a section.
SILENT = frozenset("script style noscript template svg form aside nav header footer figure iframe button select".split())
CLOSED = ("toc", "author_box", "pagination", "related_repeater", "breadcrumb", "sidebar")
LEVELS = frozenset("h2 h3 h4".split())
_KINDS = list(CONTAINERS)


def squeezed(text: str) -> str:
    return " ".join(text.split())


def words(text: str) -> str:
    """Letters and digits, one blank between words."""
    return " ".join(re.findall("[a-z0-9]+", text.lower()))


def absolute(href: str, base: str) -> str | None:
    """A link's address without its fragment; null for other schemes."""
    href = href.strip()
    if not href or href.startswith(("mailto:", "tel:", "javascript:", "data:", "sms:")):
        return None
    try:
        p = urlsplit(urljoin(base, href))
    except ValueError:
        return None
    return urlunsplit((p.scheme, p.netloc.lower(), p.path or "/", p.query, "")) if p.scheme in ("http", "https") and p.netloc else None


def host(url: str) -> str:
    return urlsplit(url).netloc.lower().removeprefix("www.")


class Tree(HTMLParser):
    """Elements by number: tag, attributes, mark (class and id), parent, children (numbers and texts), depth-first span, containers.

    Element 0 is the document.  A block ends a paragraph, an item ends an item, a cell or a row those before it.
    """

    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.attrs, self.mark, self.up = ["#document"], [{}], [""], [-1]
        self.children: list[list[int | str]] = [[]]
        self.inside, self.last = [0], [0]
        self.at = 0
        self.open: dict[str, list[int]] = {}
        self.feed(source)
        self.close()
        while self.at:
            self._leave()
        self.last[0] = len(self.tag)

    def _leave(self) -> None:
        self.last[self.at] = len(self.tag)
        self.open[self.tag[self.at]].pop()
        self.at = self.up[self.at]

    def _end(self, tag: str) -> None:
        if self.open.get(tag):
            upto = self.open[tag][-1]
            while self.at >= upto and self.at:
                self._leave()

    def _add(self, tag: str, attrs: list) -> int:
        own = {k: v or "" for k, v in attrs}
        mark = f"{own.get('class', '')} {own.get('id', '')}".lower()
        bits = sum(1 << n for n, kind in enumerate(_KINDS) if ELEMENTS.get(tag) == kind or (mark != " " and any(x in mark for x in CONTAINERS[kind])))
        k = len(self.tag)
        for column, value in ((self.tag, tag), (self.attrs, own), (self.mark, mark), (self.up, self.at), (self.children, []), (self.inside, self.inside[self.at] | bits), (self.last, k + 1)):
            column.append(value)
        self.children[self.at].append(k)
        return k

    def handle_starttag(self, tag: str, attrs: list) -> None:
        here = self.tag[self.at]
        if tag not in VOID:
            if here == "p" and tag in BLOCK:
                self._end("p")
            here = self.tag[self.at]
            if here == tag == "li" or (here in ("td", "th") and tag in ("td", "th")):
                self._end(here)
            if tag == "tr" and self.tag[self.at] in ("td", "th", "tr"):
                self._end("tr")
        k = self._add(tag, attrs)
        if tag not in VOID:
            self.open.setdefault(tag, []).append(k)
            self.at = k

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._add(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID:
            self._end(tag)

    def handle_data(self, data: str) -> None:
        self.children[self.at].append(data)

    def holds(self, outer: int, k: int) -> bool:
        """Whether an element stands inside another: numbers are given depth first."""
        return outer < k < self.last[outer]

    def above(self, k: int) -> Iterator[int]:
        while (k := self.up[k]) >= 0:
            yield k

    def first(self, wanted) -> int | None:
        return next((k for k in range(1, len(self.tag)) if wanted(k)), None)

    def root(self) -> int:
        """The content: a marked element, else main or article, else what is around the first h1, else the body."""
        found = self.first(lambda k: any(r in self.mark[k] for r in ROOTS))
        if found is None:
            found = self.first(lambda k: self.tag[k] in ("main", "article"))
        if found is None and (h1 := self.first(lambda k: self.tag[k] == "h1")) is not None:
            found = next((k for k in self.above(h1) if self.tag[k] in ("section", "main", "article")), None)
        if found is None:
            found = self.first(lambda k: self.tag[k] == "body")
        return found or 0

    def pieces(self, k: int, skip: frozenset[str] = frozenset()) -> Iterator[str]:
        """Texts of an element in order; blocks and line breaks stand apart."""
        stack = [iter(self.children[k])]
        ends = [""]
        while stack:
            c = next(stack[-1], None)
            if c is None:
                stack.pop()
                yield ends.pop()
            elif isinstance(c, str):
                yield c
            elif self.tag[c] == "br":
                yield " "
            elif self.tag[c] not in skip:
                gap = " " if self.tag[c] in BLOCK else ""
                yield gap
                stack.append(iter(self.children[c]))
                ends.append(gap)

    def text(self, k: int, skip: frozenset[str] = frozenset()) -> str:
        return squeezed("".join(self.pieces(k, skip)))


def _more_than_link(tree: Tree, block: int, anchor: str) -> bool:
    """Whether two words of a block are left once the anchor is taken out; no more is read than it takes to tell."""
    said, n, enough = [], 0, 8 * len(anchor) + 256
    for piece in tree.pieces(block):
        said.append(piece)
        n += len(piece)
        if n >= enough:
            if len(words("".join(said)).split()) - len(words(anchor).split()) >= 4:
                return True
            enough *= 2
    return len(words("".join(said)).replace(words(anchor), "", 1).split()) >= 2


def link_rows(source: str | None, url: str | None) -> list[dict]:
    """``href, destination, anchor, class, block`` of every link with a target, in order."""
    tree, url = Tree(source or ""), url or ""
    root, out = tree.root(), []

    def class_of(k: int, href: str, to: str | None, anchor: str) -> tuple[str, str]:
        if to is None:
            return "non_http", ""
        around = tree.inside[tree.up[k]]
        place = next((kind for n, kind in enumerate(_KINDS) if around >> n & 1), None)
        place = place or next((kind for kind in ("pagination", "author_box") if any(x in tree.mark[k] for x in CONTAINERS[kind])), None)
        if href.startswith("#"):
            return (place if place in ("header", "footer", "nav") else "toc"), ""
        if place:
            return place, ""
        if host(to) != host(url):
            return "external", ""
        if not tree.holds(root, k):
            return "template", ""
        if to == url:
            return "self_link", ""
        block = next((b for b in tree.above(k) if tree.tag[b] in TEXT), None)
        tag = tree.tag[block] if block is not None else ""
        if block is None or tag in HEADINGS:
            return ("other" if block is None else "heading_link"), tag
        if not _more_than_link(tree, block, anchor):
            return "link_list", tag
        return ("contextual" if tag in RUNNING else "other"), tag

    for k, tag in enumerate(tree.tag):
        href = tree.attrs[k].get("href", "").strip() if tag == "a" else ""
        if href:
            to, anchor = absolute(href, url), tree.text(k)
            kind, block = class_of(k, href, to, anchor)
            out.append({"href": href, "destination": to if to is not None else href, "anchor": anchor, "class": kind, "block": block})
    return out


def _block(tree: Tree, k: int, url: str) -> tuple[str, list[dict]]:
    """Text of a block without lists and tables inside it, and its links."""
    said, links, stack = [], [], [iter(tree.children[k])]
    while stack:
        c = next(stack[-1], None)
        if c is None:
            stack.pop()
        elif isinstance(c, str):
            said.append(c)
        elif tree.tag[c] == "br":
            said.append(" ")
        elif tree.tag[c] == "a":
            anchor, to = tree.text(c, SILENT), absolute(tree.attrs[c].get("href", ""), url)
            said.append(f" {anchor} ")
            if anchor and to:
                links.append({"href": to, "anchor": anchor})
        elif tree.tag[c] not in SILENT and not (tree.tag[c] in ("ul", "ol", "table") and tree.tag[c] != tree.tag[k]):
            stack.append(iter(tree.children[c]))
    return squeezed("".join(said)), links


def section_blocks(source: str | None, url: str | None) -> list[dict]:
    """``section, heading, level, tag, text, links`` of the blocks of a page's content; sections without blocks have no number."""
    tree, out = Tree(source or ""), []
    heading, level, number, fresh = "", "intro", 0, True
    closed = lambda c: tree.tag[c] in SILENT or any(x in tree.mark[c] for kind in CLOSED for x in CONTAINERS[kind])

    def add(k: int) -> None:
        nonlocal number, fresh
        text, links = _block(tree, k, url or "")
        if text:
            number, fresh = number + fresh, False
            out.append({"section": number, "heading": heading, "level": level, "tag": tree.tag[k], "text": text, "links": links})

    stack = [iter(tree.children[tree.root()])]
    while stack:
        c = next(stack[-1], None)
        if c is None:
            stack.pop()
        elif isinstance(c, str) or closed(c) or tree.tag[c] in ("h1", "h5", "h6"):
            continue
        elif tree.tag[c] in LEVELS:
            heading, level, fresh = tree.text(c, SILENT), tree.tag[c], True
        elif tree.tag[c] in TEXT - {"div"}:
            add(c)
            inner = [x for x in tree.children[c] if not isinstance(x, str) and tree.tag[x] in ("ul", "ol", "table") and not closed(x)]
            stack += [iter(tree.children[x]) for x in reversed(inner)]
        elif tree.tag[c] == "div" and not any(not isinstance(x, str) and tree.tag[x] in BLOCK for x in tree.children[c]):
            add(c)
        else:
            stack.append(iter(tree.children[c]))
    return out


# Elements whose text is no part of an article; those that stand apart.
_CHROME = frozenset("style noscript template svg iframe nav header footer aside".split())
_APART = frozenset("p div li tr table ul ol br section article blockquote".split())


class _Tokens(HTMLParser):
    """``open, close, text`` of what is part of the article, and ``data`` of each JSON-LD block."""

    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tokens: list[tuple[str, str]] = []
        self.hidden: list[str] = []
        self.data: list[str] | None = None
        self.feed(source)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "script" and (dict(attrs).get("type") or "").strip().lower() == "application/ld+json":
            self.data = []
        elif tag == "script" or tag in _CHROME:
            self.hidden.append(tag)
        elif not self.hidden:
            self.tokens.append(("open", tag))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _CHROME and tag != "script":
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "script" and self.data is not None:
            self.tokens.append(("data", "".join(self.data)))
            self.data = None
        elif self.hidden:
            if self.hidden[-1] == tag:
                self.hidden.pop()
        else:
            self.tokens.append(("close", tag))

    def handle_data(self, data: str) -> None:
        if self.data is not None:
            self.data.append(data)
        elif not self.hidden:
            self.tokens.append(("text", data))


def _types(block: str) -> list[str]:
    """Every type that a JSON-LD block declares, in order; none if it can't be read."""
    try:
        todo = [json.loads(block)]
    except ValueError:
        return []
    out = []
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            kind = x.get("@type")
            out += [y for y in (kind if isinstance(kind, list) else [kind]) if isinstance(y, str)]
            todo += reversed(list(x.values()))
        elif isinstance(x, list):
            todo += reversed(x)
    return out


def chunks(source: str | None, most: int = 500, most_lists: int = 5) -> dict:
    """``title, h1, chunks, lists, types, words``: what stands under each h2 and h3, the first lists, the declared types.

    A chunk is ``level, path, text, content``: the path is the h2 above an h3; a content or list ends after ``most`` letters.
    """
    title, h1, body, types, lists = [], "", [], [], []
    parts: list[dict] = []
    into: dict | None = None
    naming: tuple[str, list[str]] | None = None
    titled, depth, items = False, 0, None

    def name() -> None:
        nonlocal h1, into, naming
        if naming and (said := squeezed("".join(naming[1]))):
            if naming[0] != "h1":
                above = next((p["text"] for p in reversed(parts) if p["level"] == "h2"), "") if naming[0] == "h3" else ""
                into = {"level": naming[0], "path": above, "text": said, "content": []}
                parts.append(into)
            elif not h1:
                h1, into = said, None
        naming = None

    def say(text: str) -> None:
        body.append(text)
        if into is not None:
            into["content"].append(text)

    for kind, value in _Tokens(source or "").tokens:
        if kind == "data":
            types += _types(value)
        elif kind == "text":
            if titled:
                title.append(value)
            elif naming:
                naming[1].append(value)
            else:
                say(value)
                if items is not None:
                    items.append(value)
        elif value == "title":
            titled = kind == "open"
        elif kind == "open" and value in ("h1", "h2", "h3"):
            name()
            naming = (value, [])
        elif kind == "close" and naming and naming[0] == value:
            name()
        elif value in ("ul", "ol"):
            if kind == "open":
                depth += 1
                if depth == 1 and len(lists) < most_lists:
                    items = []
            else:
                if depth == 1 and items is not None:
                    if said := squeezed("".join(items)):
                        lists.append(said[:most])
                    items = None
                depth = max(0, depth - 1)
        elif kind == "open" and value == "li" and items is not None:
            items.append("- ")
        elif value in _APART:
            say(" ")
    return {
        "title": "".join(title), "h1": h1, "chunks": [p | {"content": squeezed("".join(p["content"]))[:most]} for p in parts], "lists": lists,
        "types": list(dict.fromkeys(types)), "words": len("".join(body).split()),
    }


def _rows(fields: str) -> T.ArrayType:
    """An array of structs of strings; a field may name its type."""
    kinds = {"int": T.IntegerType()}
    named = [f.partition(":") for f in fields.split()]
    return T.ArrayType(T.StructType([T.StructField(n, kinds.get(k, T.StringType())) for n, _, k in named]))


LINK_SCHEMA = _rows("href destination anchor class block")
BLOCK_SCHEMA = _rows("section:int heading level tag text")
BLOCK_SCHEMA.elementType.add("links", _rows("href anchor"))
CHUNK_SCHEMA = T.StructType().add("title", T.StringType()).add("h1", T.StringType()).add("chunks", _rows("level path text content")).add("lists", T.ArrayType(T.StringType())).add("types", T.ArrayType(T.StringType())).add("words", T.IntegerType())


@pandas_udf(LINK_SCHEMA)
def link_classes(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A page's links with what kind each is: by its container, its target, its block and the words around it."""
    for source, url in slices(batches, 2):
        yield pd.Series([link_rows(s, u) for s, u in zip(source, url, strict=True)])


@pandas_udf(BLOCK_SCHEMA)
def page_blocks(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The blocks of a page's sections; see :func:`section_blocks`."""
    for source, url in slices(batches, 2):
        yield pd.Series([section_blocks(s, u) for s, u in zip(source, url, strict=True)])


@pandas_udf(CHUNK_SCHEMA)
def page_chunks(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """A page's chunks, lists and types; see :func:`chunks`."""
    for (source,) in slices(batches):
        yield pd.DataFrame([chunks(s) for s in source], columns=CHUNK_SCHEMA.fieldNames())
