"""Pages of a site: which to crawl first, which may be indexed, where files belong, what a page states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Addresses that no crawl needs; words that say something is absent, and that the claim is about a sitemap.
SKIP_URL = r"(?i)\.(jpg|jpeg|png|gif|webp|svg|pdf|zip|mp4|css|js)(\?|$)|/wp-(admin|json|content)/|/feed/?$|/tag/|/author/|/page/\d|[?&](s|p|replytocom)=|/cart|/checkout|/my-account|/privacy|/terms"
ABSENCE = r"(?i)\bnot (?:listed|shown|found|mentioned|on|in|there)\b|\bmissing\b|\babsent\b|\bno mention\b|\bdoes(?:n't| not) (?:list|show|mention|include)\b"


def crawlable(url: Column, site: Column) -> Column:
    """An http address of the site itself (www or not) that no rule excludes."""
    host = F.lower(F.regexp_extract(url, r"^https?://([^/?#]+)", 1))
    bare = lambda c: F.regexp_replace(F.lower(c), r"^www\.", "")
    return (host != "") & (bare(host) == bare(site)) & ~url.rlike(SKIP_URL)


def path_score(url: Column, rules: Sequence[tuple[str, int]]) -> Column:
    """Ten points for each point of the best rule that a path segment starts or ends with, less three for each segment.

    The home page scores 100; a page that no rule fits scores 0.  Rules are patterns with points.
    """
    path = F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?:[a-z][a-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)), "/+$", "")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    best = F.lit(0)
    for pattern, points in rules:
        rx = rf"^(?:{pattern})|(?:{pattern})$"
        best = F.greatest(best, F.when(F.exists(segments, _fits(rx)), points).otherwise(0))
    return F.when(F.size(segments) == 0, 100).when(best > 0, best * 10 - F.size(segments) * 3).otherwise(0)


def _fits(pattern: str):
    return lambda s: s.rlike(pattern)


def noindex(robots: Column, header: Column) -> Column:
    both = F.lower(F.concat_ws(" ", F.coalesce(robots, F.lit("")), F.coalesce(header, F.lit(""))))
    return F.contains(both, F.lit("noindex")) | F.array_contains(F.transform(F.split(both, ","), lambda x: F.trim(x)), "none")


def indexable(status: Column, url: Column, final: Column, canonical: Column, blocked: Column) -> Column:
    """Answered itself with 200, not blocked, and canonical to itself or to nothing."""
    return (status == 200) & (final == url) & ~blocked & (F.coalesce(canonical, F.lit("")).isin("") | (canonical == url))


def reachability(code: Column, final: Column, parameter: Column, probe: str) -> Column:
    """Whether an address answers and keeps its parameter."""
    return F.when(F.coalesce(code, F.lit(0)) == 0, "UNREACHABLE").when(code >= 400, "UNREACHABLE").when(F.coalesce(parameter, F.lit("")) == "", "REACHABLE").when(F.contains(final, F.lit(probe)), "REACHABLE").otherwise("PARAM-STRIPPED")


def claim_kind(value: Column, absent: Column) -> Column:
    """``text`` or ``sitemap`` for what says something is absent, null for a positive value."""
    return F.when(F.coalesce(absent, F.lit("")) != "", "text").when(~F.coalesce(value, F.lit("")).rlike(ABSENCE), F.lit(None).cast("string")).when(value.rlike(r"(?i)\bsitemap\b"), "sitemap").otherwise("text")


def signals(source: Column, families: dict[str, Sequence[str]]) -> Column:
    """Names of the signal families of which any pattern is in a page's source, in order."""
    found = [F.when(F.exists(F.array(*[F.lit(p) for p in patterns]), lambda p: F.regexp_like(source, p)), F.lit(name)) for name, patterns in families.items()]
    return F.array_compact(F.array(*found))


def confidence(families: Column) -> Column:
    n = F.size(families)
    return F.when(n >= 2, "high").when(n == 1, "medium").otherwise("low")


def palette_method(tokens: Column, colours: Column) -> Column:
    return F.when(tokens >= 3, "tokens").when(colours >= 3, "hex").otherwise("insufficient")


def frequent(values: DataFrame, column: str, pattern: str, most: int = 20) -> DataFrame:
    """The most frequent matches of a pattern, lower-cased: ``value, n``."""
    found = values.select(F.explode(F.regexp_extract_all(F.lower(column), F.lit(pattern), F.lit(0))).alias("value"))
    return found.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most)


def first_of_each(rows: DataFrame, key: str | Column, order: str) -> DataFrame:
    """The first row of each key, in order."""
    keyed = rows.withColumn("first_key", key if isinstance(key, Column) else F.col(key))
    rank = F.row_number().over(Window.partitionBy("first_key").orderBy(order))
    return keyed.withColumn("rn", rank).where("rn = 1").drop("rn", "first_key")


def wanted_pages(pages: DataFrame, wanted: DataFrame, *, key: Column, wanted_key: Column) -> tuple[DataFrame, DataFrame]:
    """Pages on a list, and the list's entries that no page has."""
    have, want = pages.withColumn("k", key), wanted.withColumn("k", wanted_key)
    return have.join(want.select("k").distinct(), "k", "left_semi").drop("k"), want.join(have.select("k").distinct(), "k", "left_anti").drop("k")


def picked(urls: DataFrame, *, by: str, order: str, url: str, score: Column, most: int = 3) -> DataFrame:
    """The best addresses of each group, fragments and closing slashes aside; ties by first place, negative scores out."""
    key = F.concat_ws("\n", F.col(by).cast("string"), F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", ""))
    once = first_of_each(urls, key, order).withColumn("score", score).where("score >= 0")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), order))
    return once.withColumn("rank", rank).where(F.col("rank") <= most)


def in_fixed_order(rows: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Rows with ``rank``: a label's place in a list, unknown ones after all."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return rows.withColumn("rank", F.when(rank > 0, rank - 1).otherwise(len(order)))


def closest_snapshot(pages: DataFrame, snapshots: DataFrame, *, key: str, wanted: str, taken: str, value: str) -> DataFrame:
    """The snapshot nearest to a wanted time, of equally near ones the earlier; null where there is none.

    Nearest below and above by ordered aggregates within one shuffle on the key, never all pairs.
    """
    marks = pages.select(key, F.col(wanted).alias("at"), F.lit(True).alias("asked"), F.lit(None).cast(dict(snapshots.dtypes)[value]).alias("v"))
    shots = snapshots.select(key, F.col(taken).alias("at"), F.lit(False).alias("asked"), F.col(value).alias("v"))
    both = marks.unionByName(shots).withColumn("x", F.when(~F.col("asked"), F.struct("at", "v")))
    order = Window.partitionBy(key).orderBy("at", "asked")
    before = F.last("x", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("x", ignorenulls=True).over(Window.partitionBy(key).orderBy("at", F.desc("asked")).rowsBetween(0, Window.unboundedFollowing))
    rows = both.withColumns({"before": before, "after": after}).where("asked")
    gap = lambda c: F.abs(F.unix_micros(F.col(f"{c}.at")) - F.unix_micros("at"))
    best = F.when(F.col("after").isNull() | (gap("before") <= gap("after")), F.col("before")).otherwise(F.col("after"))
    return rows.select(key, F.col("at").alias(wanted), best["at"].alias(taken), best["v"].alias(value))


def crawl_levels(links: DataFrame, start: DataFrame, *, depth: int) -> DataFrame:
    """``url, level``: the shortest way from the start pages along links, up to a depth; one join for each level."""
    edges = links.select("source", "destination").distinct()
    seen = start.select("url").distinct().withColumn("level", F.lit(0))
    last = seen
    for level in range(1, depth + 1):
        found = last.join(edges, F.col("url") == F.col("source")).select(F.col("destination").alias("url")).distinct()
        last = found.join(seen.select("url"), "url", "left_anti").withColumn("level", F.lit(level))
        seen = seen.unionByName(last)
    return seen


def with_quota(pages: DataFrame, *, group: str, score: str, url: str, budget: int) -> DataFrame:
    """The best pages within a budget, no group with more than a fifth of it (three at least)."""
    per = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), url))
    fair = pages.withColumn("rn", per).where(F.col("rn") <= max(3, budget // 5)).drop("rn")
    return fair.orderBy(F.desc(score), url).limit(budget)


def file_pages(files: DataFrame, *, name: str = "name", canonical: str = "canonical", og_url: str = "og_url") -> DataFrame:
    """Files with the ``url`` they hold and how it was found; rendered copies win, then the first name.

    By canonical address, else og:url, else the file's name; files that share a canonical address go by their names.
    """
    filled = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    shared = F.count("*").over(Window.partitionBy(canonical)) > 1
    by_name = name_to_url(F.col(name))
    url = F.when(filled(canonical).isNotNull() & ~shared, F.col(canonical)).otherwise(F.coalesce(F.when(shared, by_name), filled(canonical), filled(og_url), by_name))
    how = F.when(filled(canonical).isNotNull() & ~shared, "canonical").when(shared & by_name.isNotNull() & filled(canonical).isNotNull(), "name").when(filled(canonical).isNotNull(), "canonical").when(filled(og_url).isNotNull(), "og:url").when(by_name.isNotNull(), "name").otherwise("none")
    rows = files.withColumn("url", url).withColumn("how", how)
    rank = F.row_number().over(Window.partitionBy("url").orderBy(F.when(F.col(name).startswith("rendered_"), 0).otherwise(1), name))
    return rows.withColumn("rn", rank).where(F.col("url").isNull() | (F.col("rn") == 1)).drop("rn")


def name_to_url(name: Column) -> Column:
    """The address in a saved page's name, such as ``rendered_https_site.com_a_b.html``; null for other names."""
    pattern = r"^(?:original_|rendered_)?(https?)_([^_]+)_?(.*?)\.html?$"
    path = F.regexp_replace(F.regexp_extract(name, pattern, 3), "_", "/")
    return F.when(name.rlike(pattern), F.concat(F.regexp_extract(name, pattern, 1), F.lit("://"), F.regexp_extract(name, pattern, 2), F.lit("/"), path))


def entities(source: Column) -> dict[str, Column]:
    """Social profiles, addresses and numbers that a page's source names, sorted."""
    sets = lambda p, g=0: F.array_sort(F.array_distinct(F.regexp_extract_all(source, F.lit(p), F.lit(g))))
    social = sets(r"https?://(?:[a-z]{2,3}\.)?((?:linkedin\.com/(?:company|in|school)|facebook\.com|instagram\.com|youtube\.com|tiktok\.com|x\.com|github\.com)/[^/?#\s\"'<]+)", 1)
    noise = r"/(embed|tr|watch|share|sharer|intent|plugins|dialog|hashtag|search|privacy|policy|legal|help|terms|about)(/|\?|$)"
    return {"social": F.filter(social, lambda s: ~s.rlike(noise)), "emails": sets(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), "phones": sets(r"\+[0-9]{1,3}[ -]?\(?[0-9]{1,4}\)?(?:[ -]?[0-9]){6,10}")}


def first_path(document: Column, paths: Sequence[str]) -> Column:
    """The first value in a JSON document, by dotted paths, that is neither empty text, list nor object."""
    values = [F.get_json_object(document, "$." + p) for p in paths]
    return F.coalesce(*[F.when(~v.isin("", "[]", "{}", "null"), v) for v in values])


def section_ids(rows: DataFrame, *, page: str, order: str, sentences: str) -> DataFrame:
    """``section_id, sentence_id, sentence, position``: S01 and S01.01 in order, and where in the page a sentence stands (0 to 1)."""
    rank = F.row_number().over(Window.partitionBy(page).orderBy(order))
    sections = rows.withColumn("section_id", F.concat(F.lit("S"), F.lpad(rank.cast("string"), 2, "0")))
    each = sections.select(page, order, "section_id", F.posexplode(sentences).alias("i", "sentence"))
    w = Window.partitionBy(page)
    place = F.row_number().over(w.orderBy(order, "i"))
    return each.select(page, "section_id", F.concat("section_id", F.lit("."), F.lpad((F.col("i") + 1).cast("string"), 2, "0")).alias("sentence_id"), "sentence", ((place - 1) / F.count("*").over(w)).alias("position"))


def sitemap_pages(files: DataFrame, start: str, *, depth: int = 5) -> DataFrame:
    """``url`` of all pages that a sitemap lists, those of the sitemaps it names included; one join for each level.

    files: url, xml of saved sitemaps.
    """
    listed = files.select("url", F.contains("xml", F.lit("<sitemapindex")).alias("is_index"), F.explode(F.array_distinct(F.regexp_extract_all("xml", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)))).alias("loc"))
    level = files.sparkSession.range(1).select(F.lit(start).alias("url"))
    seen, pages = level, None
    for _ in range(depth):
        met = level.join(listed, "url")
        found = met.where("not is_index").select(F.col("loc").alias("url"))
        pages = found if pages is None else pages.unionByName(found)
        level = met.where("is_index").select(F.col("loc").alias("url")).distinct().join(seen, "url", "left_anti")
        seen = seen.unionByName(level)
    return pages.distinct()


def site_pages(robots: DataFrame, files: DataFrame, *, depth: int = 5, most: int | None = 4000) -> DataFrame:
    """``site, url, place`` of the pages that each site's sitemaps list, in the order of first sight, at most so many a site (all with None).

    robots: site, root, robots (text or null); files: url, xml of saved sitemaps.  A site's sitemaps are those its robots
    file names, then the usual places.  One join for each level of indexes; an index lists image, author, tag and
    category sitemaps last, and those of images and attachments are not read.  A sitemap is read once a site.
    """
    named = F.regexp_extract_all(F.coalesce("robots", F.lit("")), F.lit(r"(?im)^[ \t]*sitemap:[ \t]*(\S+)"), F.lit(1))
    usual = F.transform(F.array(*[F.lit(x) for x in ("sitemap_index.xml", "sitemap.xml", "wp-sitemap.xml")]), lambda x: F.concat(F.regexp_replace("root", "/+$", ""), F.lit("/"), x))
    level = robots.select("site", F.posexplode(F.array_distinct(F.concat(named, usual))).alias("i", "url")).select("site", "url", F.array("i").alias("way"))
    plain = lambda x: F.replace(F.replace(F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")), F.lit("&amp;"), F.lit("&")), F.lit("&#38;"), F.lit("&"))
    locs = F.transform(F.regexp_extract_all("xml", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), plain)
    index = F.contains("xml", F.lit("<sitemapindex"))
    last = lambda u: F.rlike(u, F.lit("image|author|tag|categor|attachment"))
    sorted_ = F.transform(F.array_sort(F.transform(locs, lambda u: F.struct(last(u).alias("l"), u.alias("u")))), lambda x: x["u"])
    order = F.when(index, F.filter(sorted_, lambda u: ~F.rlike(u, F.lit("image|attachment")))).otherwise(locs)
    listed = files.select("url", index.alias("is_index"), F.posexplode(order).alias("i", "loc"))
    seen, pages = level.select("site", "url"), None
    for _ in range(depth):
        met = level.join(listed, "url").select("site", "is_index", F.concat("way", F.array("i")).alias("way"), F.col("loc").alias("url"))
        found = met.where("not is_index").select("site", "url", "way")
        pages = found if pages is None else pages.unionByName(found)
        level = met.where("is_index").groupBy("site", "url").agg(F.min("way").alias("way")).join(seen, ["site", "url"], "left_anti")
        seen = seen.unionByName(level.select("site", "url"))
    # sitemaps are read level by level, so shorter ways come first
    first = pages.groupBy("site", "url").agg(F.min(F.struct(F.size("way").alias("n"), "way")).alias("way"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("way", "url")))
    return (placed if most is None else placed.where(F.col("place") <= most)).select("site", "url", "place")


def probe(pages: DataFrame, terms: Sequence[str], *, sitemap: DataFrame, key: str = "url") -> tuple[DataFrame, DataFrame]:
    """Pages whose address or title has a term, with ``in_sitemap``; and the terms without a page.

    pages: url, title and the key by which the sitemap has a page; of pages that share an address each may have its own.
    """
    text = F.lower(F.concat_ws(" ", "url", "title"))
    met = pages.select(*dict.fromkeys(["url", key]), F.explode(F.filter(F.array(*[F.lit(x) for x in terms]), lambda x: F.contains(text, F.lower(x)))).alias("term"))
    known = sitemap.select(key).distinct().withColumn("there", F.lit(True))
    every = pages.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in terms])).alias("term"))
    return met.join(known, key, "left").select("term", "url", F.coalesce("there", F.lit(False)).alias("in_sitemap")), every.join(met, "term", "left_anti")
