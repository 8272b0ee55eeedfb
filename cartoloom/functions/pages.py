"""HTML and JSON-LD functions."""

from __future__ import annotations

import html
import json
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Elements without an end, without text, that break lines, and the areas of a page.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_AREAS = ("nav", "header", "footer", "aside", "article", "main")
_SKIP = {"script", "style", "noscript", "template", "svg"}
_BLOCK = {"p", "div", "li", "ul", "ol", "section", "article", "header", "footer", "nav", "main", "table", "tr", "td", "th", "br", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"}
PAGE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("title", "canonical", "description", "robots")]
    + [T.StructField("words", T.IntegerType()), T.StructField("text", T.StringType())]
    + [T.StructField("headings", T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType())])))]
    + [T.StructField("links", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("href", "anchor", "area")] + [T.StructField("nofollow", T.BooleanType())])))]
    + [T.StructField("types", T.ArrayType(T.StringType()))]
)


class _Pieces(HTMLParser):
    """A page as a list of pieces: (elements around it, kind, value).

    An element is a number; ``elements`` holds its tag and attributes.  Columns are folded from the pieces afterwards.
    """

    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[tuple[str, dict[str, str]]] = []
        self.pieces: list[tuple[tuple[int, ...], str, str]] = []
        self.around: tuple[int, ...] = ()
        self.areas: list[str] = []
        self.feed(source)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = (*self.around, len(self.elements))
        self.elements.append((tag, {k: v or "" for k, v in attrs}))
        self.areas.append(tag if tag in _AREAS else self.areas[self.around[-1]] if self.around else "body")
        self.pieces.append((own, "open", tag))
        if tag not in _VOID:
            self.around = own

    def handle_endtag(self, tag: str) -> None:
        depth = next((d for d in range(len(self.around), 0, -1) if self.elements[self.around[d - 1]][0] == tag), 0)
        self.pieces.append((self.around[:depth] if depth else self.around, "close", tag))
        if depth:
            self.around = self.around[: depth - 1]

    def handle_data(self, data: str) -> None:
        self.pieces.append((self.around, "text", data))

    def tags(self, around: tuple[int, ...]) -> list[str]:
        return [self.elements[k][0] for k in around]

    def texts(self, wanted: Callable[[str, dict], bool], *, raw: bool = False) -> dict[int, str]:
        """Text of each wanted element, by number; the innermost one takes it."""
        found = {k: [] for k, (tag, own) in enumerate(self.elements) if wanted(tag, own)}
        for around, kind, value in self.pieces:
            if kind == "text" and (raw or not _SKIP & set(self.tags(around))):
                inner = next((k for k in reversed(around) if k in found), None)
                if inner is not None:
                    found[inner].append(value)
        return {k: "".join(v) if raw else " ".join("".join(v).split()) for k, v in found.items()}

    def lines(self) -> list[str]:
        """Text line by line; a block's start and end break lines."""
        out = [""]
        for around, kind, value in self.pieces:
            if kind != "text":
                out += [""] if value in _BLOCK else []
            elif not (_SKIP | {"title"}) & set(self.tags(around)):
                out[-1] += value
        return [x for x in (" ".join(line.split()) for line in out) if x]

    def meta(self) -> dict[str, str]:
        """Content of meta elements by name or property and the canonical address, the first of each."""
        pairs = [((own.get("name") or own.get("property") or "").lower(), own.get("content", "")) for tag, own in self.elements if tag == "meta"]
        pairs += [("canonical", own.get("href", "")) for tag, own in self.elements if tag == "link" and "canonical" in own.get("rel", "").lower().split()]
        return dict(reversed(pairs))

    def area(self, element: int) -> str:
        return self.areas[element]


def _walk(x, found: list) -> None:
    if isinstance(x, dict):
        t = x.get("@type")
        found += t if isinstance(t, list) else [t] if t else []
        for v in x.values():
            _walk(v, found)
    elif isinstance(x, list):
        for v in x:
            _walk(v, found)


def jsonld(block: str) -> tuple[object, str | None]:
    """A block's value and a flag: empty, unparsed or none."""
    own = block.strip().removeprefix("<!--").removesuffix("-->").strip().removeprefix("//<![CDATA[").removeprefix("<![CDATA[").removesuffix("]]>").removesuffix("//").strip()
    if not own:
        return {}, "empty"
    for text in (own, html.unescape(own)):
        try:
            return json.loads(text), None
        except ValueError:
            continue
    return None, "unparsed"


def _page(source: str | None) -> dict:
    p = _Pieces(source or "")
    types: list = []
    for block in p.texts(lambda tag, own: tag == "script" and "ld+json" in own.get("type", ""), raw=True).values():
        _walk(jsonld(block)[0], types)
    headings = p.texts(lambda tag, _: tag in ("h1", "h2", "h3", "h4"))
    anchors = p.texts(lambda tag, own: tag == "a" and bool(own.get("href")))
    meta, lines = p.meta(), p.lines()
    return {
        "title": " ".join(p.texts(lambda tag, _: tag == "title").values()), "canonical": meta.get("canonical"), "description": meta.get("description"), "robots": meta.get("robots"),
        "words": sum(len(x.split()) for x in lines), "text": "\n".join(lines), "headings": [{"level": int(p.elements[k][0][1]), "text": x} for k, x in headings.items()],
        "links": [{"href": p.elements[k][1]["href"], "anchor": x, "area": p.area(k), "nofollow": "nofollow" in p.elements[k][1].get("rel", "")} for k, x in anchors.items()], "types": [str(x) for x in types],
    }


# Fixed value: pages read at once; what they give is handed on before the next ones are read, however long a batch is.
_SLICE = 64


def slices(batches: Iterator, width: int = 1) -> Iterator[tuple]:
    """Columns of each batch in slices of a few rows."""
    for batch in batches:
        columns = batch if width > 1 else (batch,)
        for at in range(0, len(columns[0]), _SLICE):
            yield tuple(c.iloc[at : at + _SLICE] for c in columns)


@pandas_udf(PAGE_SCHEMA)
def parse_page(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """A page as one struct."""
    for (source,) in slices(batches):
        yield pd.DataFrame([_page(s) for s in source], columns=PAGE_SCHEMA.fieldNames())


def hrefs(source: Column) -> Column:
    """Targets of links by regular expression, for scans that need nothing else."""
    return F.regexp_extract_all(source, F.lit('href="([^"]+)"'), F.lit(1))


def sitemap_locations(xml: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)))


def tag_ids(source: Column) -> Column:
    """Analytics identifiers, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(source, F.lit(r"\b(GTM-[A-Z0-9]{4,}|G-[A-Z0-9]{6,}|UA-[0-9]{4,}-[0-9]+)\b"), F.lit(1))))


def client_rendered(words: Column, source: Column) -> Column:
    """Few words together with an application shell or many scripts."""
    scripts = F.size(F.regexp_extract_all(source, F.lit("(?i)(<script)"), F.lit(1)))
    return (words < 150) & (source.rlike('(?i)id="(root|app|__next|__nuxt)"') | (scripts >= 5))


def robots_rules(robots: Column) -> Column:
    """Lines of a robots file as (field, value)."""
    lines = F.transform(F.split(robots, "\r?\n"), lambda s: F.trim(F.regexp_replace(s, "#.*$", "")))
    return F.transform(F.filter(lines, lambda s: F.contains(s, F.lit(":"))), lambda s: F.struct(F.lower(F.trim(F.regexp_extract(s, "^([^:]+):", 1))).alias("field"), F.trim(F.regexp_extract(s, "^[^:]+:(.*)$", 1)).alias("value")))


def csp_sources(policy: Column, directive: str, fallbacks: tuple[str, ...] = ("default-src",)) -> Column:
    """Sources that a policy lists for a directive, or for the first fallback it has; null where it restricts nothing."""
    parts = F.transform(F.split(F.lower(policy), ";"), lambda p: F.trim(p))

    found = F.coalesce(*[F.try_element_at(F.filter(parts, _starts(d)), F.lit(1)) for d in (directive, *fallbacks)])
    return F.filter(F.slice(F.split(found, r"\s+"), 2, 1000), lambda s: s != "")


def _starts(name: str):
    return lambda p: p.startswith(name + " ") | (p == name)
