"""Functions on JSON, markdown and report text."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from cartoloom.functions.pages import jsonld


def percent(value: Column, places: int = 0) -> Column:
    """A share as text with a percent sign; a dash for null."""
    return F.when(value.isNull(), "-").otherwise(F.concat(F.format_number(F.round(value * 100, places), places), F.lit("%")))


def grouped(value: Column) -> Column:
    """A whole number with thousands separators; a dash for null."""
    return F.when(value.isNull(), "-").otherwise(F.format_number(F.bround(value.cast("double")), 0))


def _objects(value: object) -> Iterator[dict]:
    if isinstance(value, dict):
        yield value
    for inner in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        yield from _objects(inner)


@pandas_udf(T.ArrayType(T.StringType()))
def objects(documents: pd.Series) -> pd.Series:
    """Every object of a JSON text as JSON, outer ones first; none for text that is no JSON."""

    def walk(text: str | None) -> list[str]:
        try:
            return [json.dumps(o, ensure_ascii=False, sort_keys=True) for o in _objects(json.loads(text or "null"))]
        except ValueError:
            return []

    return documents.map(walk)


def of_type(found: Column, name: str) -> Column:
    """Objects whose ``@type`` is a name or a list with it."""
    kind = lambda o: F.get_json_object(o, "$['@type']")
    return F.filter(found, lambda o: F.coalesce((kind(o) == name) | F.contains(kind(o), F.lit(f'"{name}"')), F.lit(False)))


def rating_of(found: Column) -> Column:
    """``value, count`` of the first aggregate rating among objects."""
    first = F.try_element_at(of_type(found, "AggregateRating"), F.lit(1))
    number = lambda *paths: F.coalesce(*[F.get_json_object(first, f"$.{p}") for p in paths]).try_cast("double")
    return F.struct(number("ratingValue").alias("value"), number("reviewCount", "ratingCount").cast("long").alias("count"))


def _described(block: str | None) -> str:
    value, flag = jsonld(block or "")
    if flag:
        return flag.upper()

    def name(x: object) -> str:
        kind = x.get("@type") if isinstance(x, dict) else None
        return "+".join(map(str, kind)) if isinstance(kind, list) else str(kind or "?")

    graph = value.get("@graph") if isinstance(value, dict) else None
    if isinstance(graph, list):
        return f"@graph({'+'.join(map(name, graph))})"
    return ", ".join(map(name, value)) if isinstance(value, list) else name(value)


@pandas_udf(T.StringType())
def described(blocks: pd.Series) -> pd.Series:
    """What a JSON-LD block holds: its types, ``@graph(A+B)``, ``EMPTY`` or ``UNPARSED``."""
    return blocks.map(_described)


def page_stats(source: Column) -> Column:
    """``rating, reviews`` by the wording of a page, for pages without structured data."""
    rating = F.regexp_extract(source, r"(?i)([0-5](?:\.[0-9]{1,2})?)\s*(?:out of|/)\s*5", 1)
    count = F.regexp_replace(F.regexp_extract(source, r"(?i)([0-9][0-9,]*)\s+(?:customer\s+)?(?:reviews|ratings)", 1), ",", "")
    return F.struct(rating.try_cast("double").alias("rating"), count.try_cast("long").alias("reviews"))


def markdown_blocks(text: Column) -> Column:
    """Blocks of a markdown text: kind (heading, table, comment, paragraph), level and text, in order."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n|\n(?=#{1,6} )|(?<=\n)(?=<!--)"), lambda p: F.trim(p, F.lit(" \n"))), lambda p: p != "")

    def block(p: Column) -> Column:
        marks = F.regexp_extract(p, r"^(#{1,6})\s", 1)
        kind = F.when(marks != "", "heading").when(p.startswith("<!--"), "comment").when(p.startswith("|"), "table").otherwise("paragraph")
        return F.struct(kind.alias("kind"), F.length(marks).alias("level"), F.when(marks != "", F.trim(F.regexp_replace(p, r"^#{1,6}\s+", ""))).otherwise(p).alias("text"))

    return F.transform(parts, block)


def metadata(comment: Column) -> Column:
    """Fields of a comment such as ``<!-- bucket: a; sources: b, c -->`` as a map."""
    inner = F.regexp_extract(comment, r"(?s)^<!--\s*(.*?)\s*-->", 1)
    pairs = F.filter(F.transform(F.split(inner, r"\s*;\s*"), lambda x: F.split(x, r"\s*:\s*", 2)), lambda x: F.size(x) == 2)
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.lower(x[0]).alias("key"), x[1].alias("value"))))


def cleanly_in(text: Column, phrase: Column) -> Column:
    """Whether a phrase occurs, in any case, between word ends or where glued words change from lower to upper case."""
    start, end = r"(?:(?<![\p{L}\p{N}_])|(?-i:(?<=\p{Ll})(?=\p{Lu})))", r"(?:(?![\p{L}\p{N}_])|(?-i:(?<=\p{Ll})(?=\p{Lu})))"
    return F.coalesce(F.regexp_like(text, F.concat(F.lit(f"(?i){start}" + r"\Q"), phrase, F.lit(r"\E" + end))), F.lit(False))


def judged(answer: Column, field: str) -> Column:
    """A probability of an answer; null where it is missing or no number in 0 to 1, never 0."""
    p = F.get_json_object(answer, f"$.{field}").try_cast("double")
    return F.when(p.between(0, 1), p)


def polarity(score: Column) -> Column:
    """A score of 0 to 4 as -2 to 2."""
    return F.greatest(F.lit(-2), F.least(F.lit(2), F.bround(score).cast("int") - 2))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with ``{name}`` replaced; a template that is one name alone keeps a null as null."""
    out = template
    for name, value in values.items():
        out = F.when(template == "{" + name + "}", value.cast("string")).otherwise(F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit(""))))
    return out


def request(system: str, **parts: Column) -> Column:
    """A request as JSON with its fields in order of name, so that equal requests are equal texts."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in sorted({"system": F.lit(system), **parts}.items())]))
