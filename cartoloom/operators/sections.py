"""Sections, sentences and anchors of pages, and chunks of them, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartoloom.functions.structure import page_blocks, page_chunks

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Jr", "Sr", "St", "vs", "etc", "e\\.g", "i\\.e", "No", "approx", "Inc", "Ltd", "Co")


def prose_sentences(text: Column) -> Column:
    """Sentences of running text: an end sign, a closing quote perhaps, blanks, then a capital, a digit or an opening sign."""
    guarded = F.regexp_replace(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), rf"(?U)\b({'|'.join(ABBREVIATIONS)})\.", "$1\u0000")
    parts = F.split(guarded, "(?<=[.!?])[\"”’)]?\\s+(?=[\"“(A-Z0-9])")
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("\u0000"), F.lit(".")))), lambda s: s != "")


def plain_words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def section_sentences(pages: DataFrame, *, key: str, url: str, source: str) -> DataFrame:
    """``key, section, heading, level, sentence, tag, text, links, link_only``: each sentence of a page's content with its links.

    Sections are ``S01`` on, sentences ``S01.01`` on.  A link belongs to the first sentence of its block that holds its
    anchor (a block's links in order); a sentence of links alone has fewer than two other words.  Null pages have none.
    """
    blocks = pages.select(F.col(key).alias("key"), F.posexplode(page_blocks(F.col(source), F.col(url))).alias("place", "b"))
    said = blocks.select("key", "place", "b.*").withColumn("said", prose_sentences(F.col("text")))
    # place of each link: the first sentence that holds its anchor
    at = F.transform("links", lambda l: F.struct(l["href"].alias("href"), l["anchor"].alias("anchor"), F.array_position(F.transform("said", lambda s: F.contains(s, l["anchor"])), True).alias("at")))
    rows = said.withColumn("links", at).select("key", "section", "heading", "level", "place", "tag", "links", F.posexplode("said").alias("n", "text"))
    own = F.filter("links", lambda l: l["at"] == F.col("n") + 1)
    number = F.row_number().over(Window.partitionBy("key", "section").orderBy("place", "n"))
    rows = rows.withColumn("links", F.transform(own, lambda l: F.struct(l["href"].alias("href"), l["anchor"].alias("anchor")))).withColumn("number", number)
    # each anchor is taken out once
    left = F.aggregate("links", plain_words(F.col("text")), lambda x, l: _without(x, plain_words(l["anchor"])))
    alone = (F.size("links") > 0) & (F.size(F.filter(F.split(left, " "), lambda w: w != "")) < 2)
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    wide = lambda c: F.when(F.col(c) < 100, two(c)).otherwise(F.col(c).cast("string"))
    section = F.concat(F.lit("S"), wide("section"))
    return rows.select(F.col("key").alias(key), section.alias("section"), "heading", "level", F.concat(section, F.lit("."), wide("number")).alias("sentence"), "tag", "text", "links", alone.alias("link_only"))


def _without(text: Column, part: Column) -> Column:
    """A text without the first place of a part."""
    at = F.instr(text, part)
    return F.when((part == "") | (at == 0), text).otherwise(F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + F.length(part))))


def sections(sentences: DataFrame, *, key: str) -> DataFrame:
    """``key, section, heading, level, sentences, words``; sentences of links alone have no words."""
    counted = F.when(F.col("link_only"), 0).otherwise(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))
    return sentences.groupBy(key, "section", "heading", "level").agg(F.count("*").alias("sentences"), F.sum(counted).alias("words"))


def section_anchors(sentences: DataFrame, *, key: str) -> DataFrame:
    """``key, href, anchor, section, sentence`` of each link in a sentence."""
    return sentences.select(key, "section", "sentence", F.explode("links").alias("l")).select(key, "l.href", "l.anchor", "section", "sentence")


def chunked(pages: DataFrame, *, key: str, source: str) -> DataFrame:
    """``key, title, h1, chunks, lists, types, words, digest`` of each page; the digest tells whether what a reader gets has changed."""
    rows = pages.select(F.col(key), page_chunks(F.col(source)).alias("c")).select(key, "c.*")
    return rows.withColumn("digest", F.left(F.sha1(F.to_json(F.struct("title", "h1", "chunks", "lists", "types")).cast("binary")), F.lit(16)))
