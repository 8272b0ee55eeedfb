"""Checks of written claims: rules as rows (severity, rule, key)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartoloom.functions.pages import robots_rules


def rule(rows: DataFrame, key: str, name: str, broken: Column, severity: str = "error") -> DataFrame:
    return rows.where(F.coalesce(broken, F.lit(False))).select(F.lit(severity).alias("severity"), F.lit(name).alias("rule"), F.col(key).cast("string").alias("key"))


def all_rules(*found: DataFrame) -> DataFrame:
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def duplicates(rows: DataFrame, key: str, name: str = "duplicate id") -> DataFrame:
    return rule(rows.groupBy(key).count(), key, name, F.col("count") > 1)


def missing(rows: DataFrame, key: str, known: DataFrame, name: str) -> DataFrame:
    """Keys that a dimension lacks."""
    return rule(rows.select(key).distinct().join(known.select(key).distinct(), key, "left_anti"), key, name, F.lit(True))


def unverified_quotes(claims: DataFrame, pages: DataFrame, *, key: str, url: str, quote: str, text: str) -> DataFrame:
    """Claims whose page was not saved, or whose quote is not in it word for word (all normalised before)."""
    met = claims.join(pages.select(url, F.col(text).alias("__text")), url, "left")
    return all_rules(rule(met, key, "page not saved", F.col("__text").isNull()), rule(met, key, "quote not found", F.col("__text").isNotNull() & ~F.contains("__text", F.col(quote))))


def findings(rows: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Rules on findings with id, category, severity, evidence, sources, checked."""
    e, s, n, c = F.col("evidence"), F.col("severity"), F.size("sources"), F.size("checked")
    return all_rules(
        duplicates(rows, "id"), rule(rows, "id", "id format", ~F.col("id").rlike("^[a-z0-9-]+$")), rule(rows, "id", "unknown category", ~F.col("category").isin(*categories)),
        rule(rows, "id", "unknown severity", ~s.isin("critical", "major", "minor")), rule(rows, "id", "stated without source", (e == "stated") & (n < 1)),
        rule(rows, "id", "contradicted needs two sources", (e == "contradicted") & (n < 2)), rule(rows, "id", "absent needs two pages checked", (e == "absent") & (c < 2)),
        rule(rows, "id", "inferred cannot be critical", (e == "inferred") & (s == "critical")),
    )


def provenance(claims: DataFrame, bundle: DataFrame, *, key: str, numbers: str) -> DataFrame:
    """Numbers that no evidence has."""
    return claims.select(key, F.explode(numbers).alias("number")).join(bundle.select(F.explode(numbers).alias("number")).distinct(), "number", "left_anti")


def reconcile(plan: DataFrame, drafted: DataFrame, question: str) -> DataFrame:
    """Plan against draft by question: both, missing, unplanned."""
    k = F.lower(F.trim(question))
    p, d = plan.select(k.alias("q")).distinct().withColumn("in_plan", F.lit(True)), drafted.select(k.alias("q")).distinct().withColumn("in_draft", F.lit(True))
    return p.join(d, "q", "full_outer").select("q", F.when(F.col("in_plan") & F.col("in_draft"), "both").when(F.col("in_plan"), "missing").otherwise("unplanned").alias("status"))


def completeness(keys: DataFrame, placed: DataFrame, key: str) -> DataFrame:
    """Keys that a result has not exactly once."""
    n = placed.groupBy(key).count()
    return keys.select(key).distinct().join(n, key, "full_outer").where(F.coalesce("count", F.lit(0)) != 1).select(key, F.coalesce("count", F.lit(0)).alias("n"))


def robots_groups(files: DataFrame, *, by: Sequence[str], robots: str = "robots") -> DataFrame:
    """The key columns, ``agent, kind, pattern`` of robots files: agents named in a row share the rules that follow.

    Rules before any agent count for nothing; an agent without rules has one row without a pattern.
    """
    keys = list(by)
    lines = files.select(*keys, F.posexplode(robots_rules(F.coalesce(robots, F.lit("")))).alias("i", "x")).select(*keys, "i", "x.field", "x.value")
    w, agent = Window.partitionBy(*keys).orderBy("i"), F.col("field") == "user-agent"
    marked = lines.withColumn("starts", agent & ~F.coalesce(F.lag(agent).over(w), F.lit(False))).withColumn("grp", F.sum(F.col("starts").cast("int")).over(w)).where("grp > 0")
    rules = marked.where(F.col("field").isin("allow", "disallow")).select(*keys, "grp", F.col("field").alias("kind"), F.col("value").alias("pattern"))
    return marked.where(agent).select(*keys, "grp", F.lower("value").alias("agent")).join(rules, [*keys, "grp"], "left").drop("grp")


def robots_allowed(rules: DataFrame, requests: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Longest matching pattern wins; groups that name the agent beat the star group; allowed by default.

    rules: agent, kind (allow or disallow), pattern; requests: agent, path; both with the columns of ``by`` where rules
    are those of a site.
    """
    keys = list(by)
    rx = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("pattern", r"([.+?()\[\]{}|^\\])", r"\\$1"), r"\*", ".*"))
    own = requests.select(*keys, F.col("agent").alias("who"), "path").distinct()
    names = rules.groupBy(*keys).agg(F.collect_set(F.lower("agent")).alias("names"))  # the groups of a robots file
    named = F.filter("names", lambda a: (a != "*") & F.contains(F.lower("who"), a))
    met = own.join(names, keys) if keys else own.crossJoin(F.broadcast(names))
    asked = met.select(*keys, "who", "path", F.explode(F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("*")))).alias("group"))
    hit = asked.join(rules.withColumn("group", F.lower("agent")).withColumn("rx", rx), [*keys, "group"]).where((F.col("pattern") != "") & F.regexp_like("path", F.col("rx")))
    best = hit.groupBy(*keys, "who", "path").agg(F.max_by("kind", F.struct(F.length("pattern"), F.col("kind") == "allow")).alias("kind"))
    return own.join(best, [*keys, "who", "path"], "left").select(*keys, F.col("who").alias("agent"), "path", (F.coalesce("kind", F.lit("allow")) == "allow").alias("allowed"))


def _runs(words: Column, n: int) -> Column:
    """Runs of n words; an array of one element binds the words once."""
    return F.transform(F.array(words), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (n - 1))), lambda i: F.array_join(F.slice(w, i, n), " ")))[0]


def _grams(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def verbatim(docs: DataFrame, passages: DataFrame, *, doc_key: str, key: str, text: str = "text") -> DataFrame:
    """``key, doc_key`` of every passage that a document holds word for word, by equi-joins alone.

    Of a passage of seven words or more the first five inside it (its first and last may be parts of the document's
    words) must be a run of the document.  Of a shorter one its rarest three letters must be among the document's (two
    or one where it has no more); the texts decide.  Null and empty passages are in no document.
    """
    d = docs.where(F.col(text).isNotNull()).select(F.col(doc_key).alias("doc"), F.col(text).alias("said"))
    words = lambda c: F.split(c, r"\s+")
    p = passages.where(F.coalesce(F.col(text), F.lit("")) != "").select(F.col(key).alias("item"), F.col(text).alias("passage"))
    inner = F.slice(words(F.col("passage")), 2, 5)
    long = p.where(F.size(words(F.col("passage"))) >= 7).withColumn("key", F.array_join(inner, " "))
    met = d.select("doc", F.explode(F.array_distinct(_runs(words(F.col("said")), 5))).alias("key")).join(long.select("item", "key"), "key").select("doc", "item").distinct()
    short = p.where(F.size(words(F.col("passage"))) < 7)
    for n in (3, 2, 1):
        own = short.where(F.length("passage") >= 3 if n == 3 else F.length("passage") == n).select("item", F.explode(_grams(F.col("passage"), n)).alias("gram"))
        there = d.select("doc", F.explode(_grams(F.col("said"), n)).alias("gram")).join(own.select("gram").distinct(), "gram", "left_semi")
        often = there.groupBy("gram").agg(F.count("*").alias("df"))
        best = own.join(often, "gram").groupBy("item").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"), F.count("*").alias("known"), F.first("item").alias("same"))
        every = own.groupBy("item").agg(F.count("*").alias("all"))
        best = best.join(every, "item").where("known = all").select("item", "gram")  # a gram in no document: nor the passage
        met = met.unionByName(there.join(best, "gram").select("doc", "item"))
    return met.join(d, "doc").join(p, "item").where(F.contains("said", "passage")).select(F.col("item").alias(key), F.col("doc").alias(doc_key)).distinct()
