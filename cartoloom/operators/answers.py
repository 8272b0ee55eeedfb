"""Answers of engines: citations, domains, mentions, searches, costs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _filled(*options: Column) -> Column:
    """The first option that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.when(x != "", x) for x in options], F.lit(""))


def citations(answers: DataFrame, *, key: str, items: str) -> DataFrame:
    """``key, place, url, title``: each address once, with the title it first came with.

    items: structs of url, link, href, title and name, of which any may be null.
    """
    each = answers.select(key, F.posexplode(items).alias("place", "x")).select(key, "place", _filled(*[F.col(f"x.{c}") for c in ("url", "link", "href")]).alias("url"), _filled(F.col("x.title"), F.col("x.name")).alias("title"))
    first = each.where("url <> ''").groupBy(key, "url").agg(F.min(F.struct("place", "title")).alias("x"))
    return first.select(key, "x.place", "url", "x.title")


def under(host: Column, domains: Sequence[str]) -> Column:
    """Whether a host is one of the domains or below one."""
    out = F.lit(False)
    for d in domains:
        out = out | (host == d) | host.endswith("." + d)
    return out


def domain_class(host: Column, *, own: Sequence[str] = (), platforms: Sequence[str] = (), competitors: Sequence[str] = ()) -> Column:
    """Own before platform before competitor; the rest is third-party, or unlabelled while nobody's own domain is known."""
    return F.when(under(host, own), "own").when(under(host, platforms), "platform").when(under(host, competitors), "competitor").otherwise("third-party" if own else "unlabelled")


def cited_domains(cited: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """``domain, citations, engines, urls, dead`` of rows with domain, engine, url; status: url, code of checked links."""
    rows = cited if status is None else cited.join(status.groupBy("url").agg(F.max("code").alias("code")), "url", "left")
    dead = F.lit(None).cast("long") if status is None else F.count_distinct(F.when(F.col("code").isin(404, 410) | (F.col("code") < 0), F.col("url")))
    return rows.groupBy("domain").agg(F.count("*").alias("citations"), F.count_distinct("engine").alias("engines"), F.count_distinct("url").alias("urls"), dead.alias("dead"))


def spend(calls: DataFrame, *, provider: str, cost: str, dry: Column) -> DataFrame:
    """Calls and cost of each provider; dry runs don't count."""
    return calls.where(~F.coalesce(dry, F.lit(False))).groupBy(provider).agg(F.count("*").alias("calls"), F.sum(F.coalesce(F.col(cost), F.lit(0.0))).alias("cost"))


def brand_pattern(brand: str, aliases: Sequence[str] = ()) -> str:
    """A pattern for any of the names, whole words, spaces or hyphens between them; a leading ``the`` may be left out."""
    names = dict.fromkeys(x.strip() for x in (brand, brand[4:] if brand.lower().startswith("the ") else "", *aliases))
    return r"(?i)(?<!\w)(?:" + "|".join(r"[\s\-]+".join(map(re.escape, n.split())) for n in names if n) + r")(?!\w)"


def mention(text: Column, pattern: str, width: int = 160) -> Column:
    """The text around the first mention, spaces collapsed; empty where there is none."""
    at = F.regexp_instr(text, F.lit(pattern))
    length = F.length(F.regexp_extract(text, pattern, 0))
    start = F.greatest(F.lit(1), at - width)
    cut = F.substring(text, start, at + length + width - start)
    return F.when(at > 0, F.trim(F.regexp_replace(cut, r"\s+", " "))).otherwise("")


def first_searches(searches: DataFrame, *, engine: str, prompt: str, query: str, most: int = 20) -> DataFrame:
    """Each engine's searches with the first prompt that led to them, up to a number for each engine."""
    first = searches.groupBy(engine, query).agg(F.min(prompt).alias(prompt))
    place = F.row_number().over(Window.partitionBy(engine).orderBy(prompt, query))
    return first.withColumn("place", place).where(F.col("place") <= most)


def named_words(text: Column, known: Sequence[str] = ()) -> Column:
    """Capitalised words that don't open the text, in lower case and order, known ones left out."""
    rest = F.regexp_replace(text, r"^\s*\S+", "")
    found = F.transform(F.regexp_extract_all(rest, F.lit(r"\b([A-Z][a-z]{2,})\b"), F.lit(1)), lambda w: F.lower(w))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(k) for k in known]).cast("array<string>"))
