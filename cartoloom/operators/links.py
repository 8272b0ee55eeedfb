"""Link graph: classes, in and out counts, audit, broken links, anchors, need and strength."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartoloom.functions import urls


def anchors_by_regex(pages: DataFrame, *, url: str, source: str) -> DataFrame:
    """``source, href`` of every link target in the page's markup."""
    return pages.select(F.col(url).alias("source"), F.explode(F.regexp_extract_all(source, F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))


def anchored_by_regex(pages: DataFrame, *, url: str, source: str) -> DataFrame:
    """``source, href, anchor`` of every plain text link in the page's markup."""
    pattern = F.lit('<a href="([^"]+)"[^>]*>([^<]*)</a>')
    both = F.arrays_zip(F.regexp_extract_all(source, pattern, F.lit(1)).alias("href"), F.regexp_extract_all(source, pattern, F.lit(2)).alias("anchor"))
    return pages.select(F.col(url).alias("source"), F.explode(both).alias("x")).select("source", "x.href", F.trim("x.anchor").alias("anchor"))


def resolved(links: DataFrame) -> DataFrame:
    """Absolute destinations of relative targets, without fragments."""
    root = F.regexp_extract("source", "^([a-z]+://[^/]+)", 1)
    href = F.col("href")
    full = F.when(href.rlike("^[a-z]+:"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(F.regexp_replace("source", "[^/]*$", ""), href))
    return links.withColumn("destination", urls.fragment_less(full))


def link_class(position: Column, path: Column, internal: Column) -> Column:
    """Class by the crawler's link position and path, first match wins."""
    p, x = F.lower(F.coalesce(position, F.lit(""))), F.lower(F.coalesce(path, F.lit("")))
    return (
        F.when(~internal, "external").when(p.contains("nav") | x.contains("/nav"), "nav").when(p.contains("header") | x.contains("/header"), "header")
        .when(p.contains("footer") | x.contains("/footer"), "footer").when(p.contains("aside") | x.contains("/aside"), "related")
        .when(x.rlike("breadcrumb"), "breadcrumb").when(x.rlike("/(p|li|td|blockquote)(\\[|/|$)"), "contextual").otherwise("other")
    )


def page_degrees(links: DataFrame) -> DataFrame:
    """In and out counts of every page: all, distinct, by class.  Columns: source, destination, class."""
    by_class = links.groupBy(F.col("destination").alias("url"), "class").agg(F.count("*").alias("n")).groupBy("url").agg(F.sum("n").alias("inlinks"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "n")))).alias("in_by_class"))
    sources = links.groupBy(F.col("destination").alias("url")).agg(F.count_distinct("source").alias("unique_inlinks"))  # counted, never gathered
    into = by_class.join(sources, "url")
    out = links.groupBy(F.col("source").alias("url")).agg(F.count("*").alias("outlinks"), F.count_distinct("destination").alias("unique_outlinks"))
    return into.join(out, "url", "full_outer")


def consume_anchors(left: DataFrame, right: DataFrame, keys: list[str], order_left: str, order_right: str) -> DataFrame:
    """Bag join: the n-th row of a key on the left takes the n-th on the right, each at most once."""
    number = lambda frame, o: frame.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(o)))
    return number(left, order_left).join(number(right, order_right), [*keys, "__n"], "left").drop("__n")


def consume_in_passes(left: DataFrame, right: DataFrame, passes: list[list[str]], *, left_id: str, right_id: str, order_right: str, value: str) -> DataFrame:
    """Left rows with the ``value`` of a right row each, matched pass by pass on fewer keys; no right row serves twice."""
    open_left, open_right, done = left, right, None
    for keys in passes:
        met = consume_anchors(open_left, open_right.select(*keys, F.col(right_id).alias("__r"), F.col(order_right).alias("__o"), F.col(value).alias("__v")), keys, left_id, "__o").where("__r is not null")
        met = met.select(left_id, "__r", F.col("__v").alias(value))
        done = met if done is None else done.unionByName(met)
        open_left = left.join(done.select(left_id), left_id, "left_anti")
        open_right = right.join(done.select(F.col("__r").alias(right_id)), right_id, "left_anti")
    return left.join(done.drop("__r"), left_id, "left")


def broken(links: DataFrame) -> DataFrame:
    """Broken and redirected links in groups with what to do: remove, relink or unlink, update href."""
    final_ok = F.col("final_status").between(200, 299)
    action = (
        F.when((F.col("status") >= 400) | ~final_ok, "remove")
        .when(urls.is_home(F.col("final")) & ~urls.is_home(F.col("destination")), "relink or unlink").otherwise("update href")
    )
    bad = links.where(~F.col("status").between(200, 299))
    return bad.groupBy("source", "destination", "anchor", "status", "final", "final_status").agg(F.count("*").alias("n")).withColumn("action", action)


def template_and_body(links: DataFrame, template: tuple[str, ...] = ("nav", "header", "footer")) -> DataFrame:
    """Template fixes once for each old URL with the pages that have it; body fixes page by page."""
    t = links.where(F.col("class").isin(*template)).groupBy("destination").agg(F.count_distinct("source").alias("pages")).select(F.lit("template").alias("kind"), F.lit(None).cast("string").alias("source"), "destination", "pages")
    b = links.where(~F.col("class").isin(*template)).groupBy("source", "destination").agg(F.count("*").alias("pages")).select(F.lit("body").alias("kind"), "source", "destination", "pages")
    return t.unionByName(b)


def anchor_conflicts(links: DataFrame) -> DataFrame:
    """Anchors that point at more than one destination."""
    return links.where("anchor <> ''").groupBy("anchor").agg(F.count_distinct("destination").alias("destinations"), F.count("*").alias("n")).where("destinations > 1")


def title_suffix(titles: DataFrame, column: str, least: float = 0.5) -> DataFrame:
    """The most common ending after a dash or bar, if enough titles have it."""
    ending = F.regexp_extract(column, r"\s[-|–]\s([^-|–]+)$", 1)
    total = titles.agg(F.count("*").alias("n"))
    top = titles.select(ending.alias("suffix")).where("suffix <> ''").groupBy("suffix").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "suffix").limit(1)
    return top.crossJoin(F.broadcast(total)).where(F.col("k") >= F.col("n") * least).select("suffix", "k")


def eligibility(indexable: Column, self_canonical: Column, allowed: Column, excluded: Column) -> Column:
    """Why a page is no target, joined by semicolons; empty if it is one."""
    why = [F.when(~F.coalesce(c, F.lit(False)), F.lit(w)) for c, w in ((indexable, "not indexable"), (self_canonical, "canonical elsewhere"), (allowed, "page type"))]
    return F.array_join(F.array_compact(F.array(*why, F.when(F.coalesce(excluded, F.lit(False)), F.lit("excluded path")))), "; ")


def hubs(pages: DataFrame, url: str) -> DataFrame:
    """Pages whose address is the folder of another page; by an equi-join on parent folders."""
    key = F.regexp_replace(url, "/+$", "")
    parents = pages.select(F.regexp_extract(key, "^(.*)/[^/]+$", 1).alias("k")).distinct()
    return pages.withColumn("k", key).join(parents, "k", "left_semi").drop("k")


def target_need(position: Column, impressions: Column, ctr: Column, inlinks: Column, orphan: Column, depth: Column) -> Column:
    need = (
        F.lit(1.0) + F.when(position.between(4, 20), 0.25).otherwise(0.0) + F.when((impressions >= 50) & (ctr <= 0.02), 0.15).otherwise(0.0)
        + F.when(orphan, 0.35).when(inlinks <= 2, 0.25).otherwise(0.0) + F.when(depth > 3, 0.15).otherwise(0.0)
    )
    return F.least(F.lit(2.0), need)


def source_strength(impressions: Column, outlinks: Column) -> Column:
    return F.least(F.lit(1.5), F.greatest(F.lit(0.6), 1 + 0.1 * F.log10(1 + impressions) - 0.03 * outlinks))


def link_score(adds_value: Column, same_intent: Column, need: Column, strength: Column, block: Column, exists: Column, early: Column, same_silo: Column, outlinks: Column) -> Column:
    weight = F.when(block == "p", 1.0).when(block == "li", 0.9).when(block.isin("td", "th", "blockquote"), 0.8).when(block == "div", 0.85).otherwise(0.7)
    placement = weight * (0.5 + 0.5 * exists) + F.when(early, 0.05).otherwise(0.0)
    penalty = F.when(same_silo, 1.0).otherwise(0.8) * F.when(outlinks >= 45, 0.5).otherwise(1.0)
    return adds_value * F.when(same_intent, 1.0).otherwise(0.6) * need * strength * placement * penalty


def band(score: Column, anchor: Column) -> Column:
    return F.when((score >= 0.55) & (anchor >= 0.3), "auto").when(score >= 0.25, "review").otherwise("drop")


def token_budget(sentences: DataFrame, *, group: str, order: str, text: str, most: int) -> DataFrame:
    """Leading sentences of each group within a token budget (a quarter of the letters, plus one each); one always stays."""
    w = Window.partitionBy(group).orderBy(order)
    spent = F.sum(F.floor(F.length(text) / 4) + 1).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sentences.withColumn("spent", spent).withColumn("rn", F.row_number().over(w)).where((F.col("spent") <= most) | (F.col("rn") == 1)).drop("rn")


def heading_blocks(sections: DataFrame, *, page: str, order: str, level: str, top: int = 2) -> DataFrame:
    """Block numbers: a heading of the top level, or the first section, opens a block."""
    w = Window.partitionBy(page).orderBy(order)
    opens = (F.col(level) <= top) | (F.row_number().over(w) == 1)
    return sections.withColumn("__open", opens.cast("int")).withColumn("block", F.sum("__open").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__open")


def near_duplicate_pairs(pages: DataFrame, *, least: float = 0.95) -> DataFrame:
    """``a, b`` (ordered) of pages that a crawl calls near duplicates, or similar enough.  pages: url, near_duplicate, similar, score."""
    said = pages.where("near_duplicate is not null").select("url", F.col("near_duplicate").alias("other"))
    close = pages.where(F.col("similar").isNotNull() & (F.col("score") >= least)).select("url", F.col("similar").alias("other"))
    return said.unionByName(close).select(F.least("url", "other").alias("a"), F.greatest("url", "other").alias("b")).distinct()


def new_targets(candidates: DataFrame, existing: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Candidates (source, target, ...) without links to itself, links that are there already and near duplicates."""
    rows = candidates.where("source <> target").join(existing.select("source", F.col("destination").alias("target")).distinct(), ["source", "target"], "left_anti")
    keyed = rows.withColumn("a", F.least("source", "target")).withColumn("b", F.greatest("source", "target"))
    return keyed.join(duplicates.select("a", "b"), ["a", "b"], "left_anti").drop("a", "b")


def section_candidates(scores: DataFrame, sections: DataFrame, existing: DataFrame, duplicates: DataFrame, hubs_of: DataFrame, *, k: int = 12, least_words: int = 40) -> DataFrame:
    """``source, section, target, score, why``: the k best new targets of each section long enough, and the page's hub.

    scores: section, target, score; sections: section, source, words; hubs_of: source, target.
    """
    own = sections.where(F.col("words") >= least_words).select("section", "source")
    ranked = new_targets(scores.where("score > 0").join(own, "section"), existing, duplicates)
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("score"), "target"))
    best = ranked.withColumn("rn", rank).where(F.col("rn") <= k).select("source", "section", "target", "score", F.lit("bm25").alias("why"))
    hub = new_targets(own.join(hubs_of, "source"), existing, duplicates).join(best.select("section", "target"), ["section", "target"], "left_anti")
    return best.unionByName(hub.select("source", "section", "target", F.lit(0.0).alias("score"), F.lit("pillar").alias("why")))


def audit_flags(pages: DataFrame, *, deep: int = 3, few: int = 2, top: int = 15) -> DataFrame:
    """Pages with ``orphan``, ``deep`` and ``needs_links``.  pages: url, inlinks, contextual, depth, impressions.

    Orphans have no links in at all, or none from running text.  Of the pages with few such links and some impressions,
    those with most impressions need links.
    """
    orphan = F.when(F.col("inlinks") == 0, "no inlinks").when(F.col("contextual") == 0, "no contextual").otherwise("")
    need = pages.where((F.col("contextual") <= few) & (F.col("impressions") > 0)).orderBy(F.desc("impressions"), "url").limit(top).select("url", F.lit(True).alias("needs_links"))
    rows = pages.withColumn("orphan", orphan).withColumn("deep", F.coalesce(F.col("depth") > deep, F.lit(False)))
    return rows.join(need, "url", "left").withColumn("needs_links", F.coalesce("needs_links", F.lit(False)))


def lowest_coverage(scores: DataFrame, *, page: str, score: str, most: int) -> DataFrame:
    return scores.orderBy(score, page).limit(most)


def anchor_spans(sentence: Column, target: Column, *, stop: tuple[str, ...], breaks: tuple[str, ...] = (), generic: tuple[str, ...] = (), least: int = 2, most: int = 6, options: int = 5) -> Column:
    """Verbatim spans of two to six words for a link, best first.

    No stop word at either end, no break word inside, no punctuation, nothing generic.  Most words in common with the
    target's tokens first, then endings like a noun's, then fewest other words, then about three words, then the first.
    """
    words = F.regexp_extract_all(sentence, F.lit(r"[\p{L}\p{N}'’]+"), F.lit(0))

    def spans(w: Column) -> Column:
        def at(i: Column) -> Column:
            return F.transform(F.sequence(F.lit(least), F.lit(most)), lambda n: F.struct(i.alias("i"), n.alias("n"), F.slice(w, i + 1, n).alias("w")))

        return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.size(w) - 1), at)), lambda x: F.size(x["w"]) == x["n"])

    def scored(x: Column) -> Column:
        low = F.transform(x["w"], lambda v: F.lower(v))
        common = F.size(F.array_intersect(low, target))
        noun = F.when(F.element_at(low, -1).rlike("(ly|ing|ed)$"), 1).otherwise(0)
        return F.struct((-common).alias("a"), noun.alias("b"), (x["n"] - common).alias("c"), F.abs(x["n"] - 3).alias("d"), x["i"].alias("e"), F.array_join(x["w"], " ").alias("span"))

    def fits(x: Column) -> Column:
        low = F.transform(x["w"], lambda v: F.lower(v))
        text = F.array_join(x["w"], " ")
        inner = F.slice(low, 2, F.greatest(F.lit(0), F.size(low) - 2))
        return ~F.element_at(low, 1).isin(*stop) & ~F.element_at(low, -1).isin(*stop) & ~F.exists(inner, lambda v: v.isin(*breaks) if breaks else F.lit(False)) & F.contains(sentence, text) & (~F.lower(text).isin(*generic) if generic else F.lit(True))

    found = F.transform(F.array(words), lambda w: F.transform(F.filter(spans(w), fits), scored))[0]
    ranked = F.when(F.size(words) > 0, F.transform(F.array_sort(found), lambda x: x["span"])).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(ranked), 1, options)


def static_drop_reasons(candidates: DataFrame, pages: DataFrame, existing: DataFrame, duplicates: DataFrame, owners: DataFrame, *, generic: tuple[str, ...] = ()) -> DataFrame:
    """Candidates with what can be said of each alone, for :func:`cartoloom.operators.graph.select_links`.

    ``first_reason`` comes before the check for repeated pairs, ``second_reason`` after it; ``owner`` is the target that
    the site links the anchor to already.  pages: url, source_ok, target_ok; owners: anchor, target.
    """
    side = lambda c, flag: pages.select(F.col("url").alias(c), F.col(flag))
    rows = candidates.join(side("source", "source_ok"), "source", "left").join(side("target", "target_ok"), "target", "left")
    linked = existing.select("source", F.col("destination").alias("target")).distinct().withColumn("linked", F.lit(True))
    rows = rows.join(linked, ["source", "target"], "left").withColumn("a", F.least("source", "target")).withColumn("b", F.greatest("source", "target"))
    rows = rows.join(duplicates.select("a", "b").distinct().withColumn("dup", F.lit(True)), ["a", "b"], "left").withColumn("key", F.lower(F.trim("anchor")))
    rows = rows.join(owners.groupBy(F.lower(F.trim("anchor")).alias("key")).agg(F.min("target").alias("owner")), "key", "left")
    first = F.when(~F.coalesce("source_ok", F.lit(False)), "source not eligible").when(~F.coalesce("target_ok", F.lit(False)), "target not eligible").when(F.col("source") == F.col("target"), "self")
    words = F.size(F.filter(F.split("anchor", r"\s+"), lambda w: w != ""))
    blank = F.coalesce("anchor", F.lit("")) == ""
    second = F.when(F.col("linked"), "already linked").when(F.col("dup"), "near duplicate").when(blank, "no anchor").when(~F.contains("sentence_text", F.col("anchor")), "not verbatim").when(~words.between(2, 6), "anchor length").when(F.col("key").isin(*generic) if generic else F.lit(False), "generic anchor")
    return rows.select(*candidates.columns, first.alias("first_reason"), second.alias("second_reason"), "owner")
