"""Queries on answers, citations and review platforms.

Pages stand in for answers with their links as citations, events for calls and searches, nations for platforms, orders and
suppliers for profiles and places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoloom.operators import answers, platforms
from cartoloom.plans.registry import query, t

_ANCHOR = """'<a href="([^"]+)"[^>]*>([^<]*)</a>'"""
_CITED = f"""z AS (SELECT page_id, list_zip(regexp_extract_all(html, {_ANCHOR}, 1), regexp_extract_all(html, {_ANCHOR}, 2)) AS z FROM pages),
i AS (SELECT page_id, unnest(range(len(z))) AS place, z FROM z), x AS (SELECT page_id, place, z[place + 1][1] AS url, z[place + 1][2] AS title FROM i),
c AS (SELECT page_id, url, min(place)::INTEGER AS place, arg_min(title, place) AS title FROM x WHERE url <> '' GROUP BY page_id, url)"""


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern, none = F.lit('<a href="([^"]+)"[^>]*>([^<]*)</a>'), F.lit(None).cast("string")
    found = F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("u"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("t"))
    # addresses come under one of three names, titles under one of two
    items = F.transform(found, lambda x, i: F.struct(*[F.when(i % 3 == k, x["u"]).otherwise(none).alias(c) for k, c in enumerate(("url", "link", "href"))], *[F.when(i % 2 == k, x["t"]).otherwise(none).alias(c) for k, c in enumerate(("title", "name"))]))
    return answers.citations(t(spark, sf_dir, "pages").select("page_id", items.alias("items")), key="page_id", items="items")


@query(f"WITH {_CITED} SELECT page_id, place, url, title FROM c")
def citation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D03, S23's citations"""
    return _citations(spark, sf_dir)


@query(f"""WITH {_CITED}, d AS (SELECT left(url, 4) AS domain, (page_id % 5)::INTEGER AS engine, url FROM c), s AS (SELECT DISTINCT url, CASE length(url) % 4 WHEN 0 THEN 404 WHEN 1 THEN -1 ELSE 200 END AS code FROM c WHERE length(url) % 5 <> 0)
SELECT domain, count(*) AS citations, count(DISTINCT engine) AS engines, count(DISTINCT d.url) AS urls, count(DISTINCT CASE WHEN code IN (404, 410) OR code < 0 THEN d.url END) AS dead FROM d LEFT JOIN s USING (url) GROUP BY domain""")
def cited_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A30"""
    c = _citations(spark, sf_dir)
    size = F.length("url")
    status = c.where(size % 5 != 0).select("url", F.when(size % 4 == 0, 404).when(size % 4 == 1, -1).otherwise(200).alias("code")).distinct()
    return answers.cited_domains(c.select(F.substring("url", 1, 4).alias("domain"), (F.col("page_id") % 5).alias("engine"), "url"), status)


_HOST = "regexp_replace(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\\.', '')"


@query(f"""SELECT page_id, CASE WHEN {_HOST} = 'there.example.com' OR {_HOST} LIKE '%.there.example.com' THEN 'own' WHEN {_HOST} LIKE '%.net' THEN 'platform' WHEN {_HOST} LIKE '%.example.com' OR {_HOST} LIKE '%.org' THEN 'competitor' ELSE 'third-party' END AS class FROM pages""")
def domain_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P18"""
    host = F.regexp_replace(F.regexp_extract(F.lower("url"), "^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]+)", 1), r"^www\.", "")
    return t(spark, sf_dir, "pages").select("page_id", answers.domain_class(host, own=["there.example.com"], platforms=["net"], competitors=["example.com", "org"]).alias("class"))


@query("""SELECT event_type, count(*) AS calls, round(sum(value), 4) AS cost FROM events WHERE user_id % 7 <> 0 GROUP BY event_type""")
def spend_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A31, I05's sum"""
    return answers.spend(t(spark, sf_dir, "events"), provider="event_type", cost="value", dry=F.col("user_id") % 7 == 0).withColumn("cost", F.round("cost", 4))


@query(r"""WITH m AS (SELECT conv_id, turn, text, regexp_extract(text, '(?i)(?:^|\W)((?:of[\s\-]+the|river)(?:$|\W))', 1) AS raw FROM conversations),
k AS (SELECT conv_id, turn, text, regexp_extract(raw, '(?i)of[\s\-]+the|river') AS hit, raw FROM m)
SELECT conv_id, turn, hit <> '' AS mentioned FROM k""")
def brand_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as whole words, spaces or hyphens between"""
    found = answers.mention(F.col("text"), answers.brand_pattern("The river", ["of the"]))
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", (found != "").alias("mentioned"))


@query("""WITH p AS (SELECT doc_id, text, instr(text, 'ation') AS i FROM documents) SELECT doc_id, CASE WHEN i > 0 THEN trim(regexp_replace(substr(text, greatest(1, i - 40), i + 5 + 40 - greatest(1, i - 40)), '\\s+', ' ', 'g')) ELSE '' END AS snippet FROM p WHERE text IS NOT NULL""")
def mention_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text around a first match"""
    return t(spark, sf_dir, "documents").where("text is not null").select("doc_id", answers.mention(F.col("text"), "ation", 40).alias("snippet"))


@query("""WITH s AS (SELECT event_type AS engine, user_id AS prompt, props AS query FROM events), f AS (SELECT engine, query, min(prompt) AS prompt FROM s GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY prompt, query)::INTEGER AS place FROM f) WHERE place <= 20""")
def first_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W18"""
    e = t(spark, sf_dir, "events").select(F.col("event_type").alias("engine"), F.col("user_id").alias("prompt"), F.col("props").alias("query"))
    return answers.first_searches(e, engine="engine", prompt="prompt", query="query")


@query("""WITH r AS (SELECT doc_id, 'NATION_' || (doc_id % 32) AS platform FROM documents)
SELECT doc_id, platform, coalesce(n_nationkey % 3 <> 0, true) AS has_stars, coalesce(CASE WHEN n_nationkey % 4 <> 1 THEN n_nationkey % 2 = 0 END, true) AS has_replies FROM r LEFT JOIN nation ON n_name = platform""")
def platform_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J02"""
    k = F.col("n_nationkey")
    known = t(spark, sf_dir, "nation").select(F.col("n_name").alias("platform"), (k % 3 != 0).alias("stars"), F.when(k % 4 != 1, k % 2 == 0).alias("replies"))
    rows = t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("NATION_"), (F.col("doc_id") % 32).cast("string")).alias("platform"))
    return platforms.with_capabilities(rows, known)


_PLATFORMS = """p AS (SELECT n_name AS platform, n_nationkey % 7 = 0 AS opt_in, CASE n_nationkey % 3 WHEN 0 THEN ['*'] WHEN 1 THEN ['AU', 'NZ'] ELSE ['US'] END AS countries, CASE n_nationkey % 4 WHEN 0 THEN ['*'] WHEN 1 THEN ['retail', 'food'] WHEN 2 THEN ['software'] END AS industries FROM nation)"""


@query(f"""WITH {_PLATFORMS} SELECT platform FROM p WHERE NOT opt_in AND (list_contains(countries, '*') OR list_contains(countries, 'AU')) AND (industries IS NULL OR list_contains(industries, '*') OR list_has_any(industries, ['online', 'retail', 'store']))""")
def eligible_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17"""
    k = F.col("n_nationkey")
    lists = lambda *x: F.array(*[F.lit(v) for v in x])
    p = t(spark, sf_dir, "nation").select(F.col("n_name").alias("platform"), (k % 7 == 0).alias("opt_in"), F.when(k % 3 == 0, lists("*")).when(k % 3 == 1, lists("AU", "NZ")).otherwise(lists("US")).alias("countries"), F.when(k % 4 == 0, lists("*")).when(k % 4 == 1, lists("retail", "food")).when(k % 4 == 2, lists("software")).alias("industries"))
    return platforms.eligible(p, country="au", industry="Online retail-store").select("platform")


@query(r"""SELECT doc_id FROM documents WHERE (source <> (SELECT min(source) FROM documents) OR regexp_matches(coalesce(lang, '') || ' ' || coalesce(text, ''), '(?i)\bof\W*the\b'))""")
def kept_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15"""
    d = t(spark, sf_dir, "documents")
    forum = d.agg(F.min("source").alias("forum"))
    rows = d.crossJoin(F.broadcast(forum)).withColumn("platform", F.when(F.col("source") == F.col("forum"), "reddit").otherwise("other"))
    return rows.where(platforms.keep_review(F.col("platform"), F.col("lang"), F.col("text"), "of the")).select("doc_id")


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey AS run, o_orderpriority AS place, o_orderstatus = 'P' AND o_orderkey % 9 < 3 AS m FROM orders), f AS (SELECT run, place, max(m::INTEGER) AS fits FROM r GROUP BY ALL),
p AS (SELECT run, sum(fits)::BIGINT AS n, max(CASE WHEN fits = 1 THEN place END) AS only_place FROM f GROUP BY run)
SELECT id, n = 1 AND place = only_place AS kept, CASE n WHEN 0 THEN 'no place matches' WHEN 1 THEN 'kept 1 place' ELSE n || ' places match' END AS why FROM r JOIN p USING (run)""")
def only_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P16"""
    rows = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("run"), F.col("o_orderpriority").alias("place"), ((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 9 < 3)).alias("m"))
    return platforms.one_place(rows, run="run", place="place", match=F.col("m")).select("id", F.coalesce("kept", F.lit(False)).alias("kept"), "why")


@query("""WITH u AS (SELECT 0 AS s, o_orderkey AS pos, o_orderpriority AS platform, o_custkey AS url FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT 1, c_custkey, c_mktsegment, c_custkey FROM customer),
f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY s, pos) AS rn FROM u) SELECT url, platform, platform || '-' || row_number() OVER (PARTITION BY platform ORDER BY s, pos) AS id FROM f WHERE rn = 1""")
def numbered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D04, D05, W16"""
    a = t(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("place"), F.col("o_orderpriority").alias("platform"), F.col("o_custkey").alias("url"))
    b = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place"), F.col("c_mktsegment").alias("platform"), F.col("c_custkey").alias("url"))
    return platforms.numbered(platforms.all_candidates(a, b)).select("url", "platform", "id")


@query("""SELECT n_name AS platform, count(d.doc_id) AS n FROM nation LEFT JOIN documents d ON n_name = 'NATION_' || (d.doc_id % 20) GROUP BY n_name""")
def imported_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A26"""
    rows = t(spark, sf_dir, "documents").select(F.concat(F.lit("NATION_"), (F.col("doc_id") % 20).cast("string")).alias("platform"))
    return platforms.zero_filled(t(spark, sf_dir, "nation").select(F.col("n_name").alias("platform")), rows, "platform")


@query("""WITH p AS (SELECT l_orderkey AS id, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS place, CASE WHEN l_quantity > 20 THEN l_quantity END AS reviews, CASE WHEN l_tax > 0.03 THEN l_returnflag WHEN l_tax > 0.01 THEN '' END AS name, CASE WHEN l_discount > 0.05 THEN [strftime(l_shipdate, '%Y-%m-%d')] ELSE [] END AS dates FROM lineitem)
SELECT id, arg_min(reviews, place) FILTER (reviews IS NOT NULL) AS reviews, arg_min(name, place) FILTER (name <> '') AS name, coalesce(array_to_string(arg_min(dates, place) FILTER (len(dates) > 0), ','), '') AS dates FROM p GROUP BY id""")
def merged_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A34"""
    place = F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")
    p = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), place.alias("place"), F.when(F.col("l_quantity") > 20, F.col("l_quantity")).alias("reviews"), F.when(F.col("l_tax") > 0.03, F.col("l_returnflag")).when(F.col("l_tax") > 0.01, "").alias("name"), F.when(F.col("l_discount") > 0.05, F.array(F.date_format("l_shipdate", "yyyy-MM-dd"))).otherwise(F.array().cast("array<string>")).alias("dates"))
    return platforms.merged_stats(p, key="id", order="place", fields=["reviews", "name"]).withColumn("dates", F.array_join("dates", ","))


@query("""WITH p AS (SELECT o_custkey AS id, list(o_orderdate::DATE ORDER BY o_orderdate DESC) AS all_dates, CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 4 * 5 END AS total FROM orders GROUP BY o_custkey), s AS (SELECT id, total, CASE WHEN total IS NULL THEN all_dates ELSE all_dates[:total] END AS d FROM p),
w AS (SELECT *, len(list_filter(d, lambda x: (DATE '2001-06-01' - x) / 30.44 <= 12)) AS w FROM s)
SELECT id, strftime(d[1], '%Y-%m-%d') AS latest, CASE WHEN w < len(d) OR (total IS NOT NULL AND len(d) >= total) THEN w::VARCHAR ELSE '>=' || w END AS last_12m FROM w""")
def recent_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A35"""
    k = F.col("id")
    p = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(F.to_date("o_orderdate")).alias("dates")).withColumn("total", F.when(k % 4 > 0, k % 4 * 5))
    return p.withColumn("x", platforms.recency(F.col("dates"), F.to_date(F.lit("2001-06-01")), F.col("total"))).select("id", F.date_format("x.latest", "yyyy-MM-dd").alias("latest"), "x.last_12m")


@query(f"""SELECT {_HOST} AS host, count(*) AS n FROM pages WHERE {_HOST} LIKE '%.example.com' OR {_HOST} = 'example.com' GROUP BY 1""")
def retailer_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A36"""
    host = F.regexp_replace(F.regexp_extract(F.lower("url"), "^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]+)", 1), r"^www\.", "")
    return platforms.retailer_hits(t(spark, sf_dir, "pages").select(host.alias("host")), ["example.com"])


_PROFILES = """s AS (SELECT s_suppkey AS id, 'NATION_' || (s_nationkey + s_suppkey % 9) AS platform, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey * 3 END AS reviews, s_acctbal AS rating, CASE s_suppkey % 4 WHEN 0 THEN 'match' WHEN 1 THEN 'partial' WHEN 2 THEN 'mismatch' END AS match, CASE WHEN s_suppkey % 11 = 0 THEN 'no profile found' ELSE 'page' END AS read FROM supplier),
p AS (SELECT n_name AS platform, upper(n_name) AS label, n_nationkey % 3 <> 0 AS stars FROM nation), c AS (SELECT n_name AS platform, 0.01 * n_nationkey AS price, CASE WHEN n_nationkey % 2 = 0 THEN 0.5 END AS fee, n_nationkey % 40 AS least, n_nationkey % 5 <> 0 AS tested FROM nation WHERE n_nationkey < 20),
n AS (SELECT *, CASE WHEN price IS NOT NULL THEN greatest(coalesce(least(reviews, 100), 100), coalesce(least, 0)) END AS n FROM s LEFT JOIN p USING (platform) LEFT JOIN c USING (platform) WHERE NOT starts_with(read, 'no profile'))"""


@query(f"""WITH {_PROFILES} SELECT id, coalesce(label, platform) AS platform, reviews, CASE WHEN coalesce(stars, true) THEN rating END AS rating, n AS est_reviews, round(coalesce(fee, 0) + n * price, 4)::DOUBLE AS est_cost, coalesce(price IS NOT NULL AND tested, false) AS scrapable,
CASE match WHEN 'match' THEN '' WHEN 'partial' THEN '⚠ partial match' WHEN 'mismatch' THEN '⚠ name/domain mismatch' ELSE '? not checked' END AS flag FROM n""")
def profile_picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A37, M09"""
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    s = t(spark, sf_dir, "supplier").select(k.alias("id"), F.concat(F.lit("NATION_"), (F.col("s_nationkey") + k % 9).cast("string")).alias("platform"), F.when(k % 5 > 0, k * 3).alias("reviews"), F.col("s_acctbal").alias("rating"), F.when(k % 4 == 0, "match").when(k % 4 == 1, "partial").when(k % 4 == 2, "mismatch").alias("match"), F.when(k % 11 == 0, "no profile found").otherwise("page").alias("read"))
    nation = t(spark, sf_dir, "nation")
    p = nation.select(F.col("n_name").alias("platform"), F.upper("n_name").alias("label"), (n % 3 != 0).alias("stars"))
    c = nation.where("n_nationkey < 20").select(F.col("n_name").alias("platform"), (n * 0.01).alias("price"), F.when(n % 2 == 0, 0.5).alias("fee"), (n % 40).alias("least"), (n % 5 != 0).alias("tested"))
    return platforms.picker(s, p, c, cap=100)


@query("""SELECT c_custkey, CASE WHEN a AND b THEN 'match' WHEN a OR b THEN 'partial' ELSE 'mismatch' END AS match FROM (SELECT c_custkey, contains(lower(c_name), 'customer') AND contains(lower(c_name), '11') AS a, CASE WHEN c_custkey % 3 = 0 THEN contains(lower(c_mktsegment), 'house.com') OR contains(lower(c_mktsegment), 'house') ELSE contains(lower('see ' || c_mktsegment || '.com'), 'house.com') END AS b FROM customer)""")
def entity_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G18"""
    site = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment"))
    return t(spark, sf_dir, "customer").select("c_custkey", platforms.entity_match(F.col("c_name"), site, F.concat(F.lit("see "), "c_mktsegment", F.lit(".com")), brand="Customer 11", domain="house.com").alias("match"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '^\s*\S+', ''), '[^\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{2,}')) AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, unnest(range(len(w))) AS i, w FROM w), f AS (SELECT doc_id, lower(w[i + 1]) AS name, min(i) AS i FROM i GROUP BY ALL)
SELECT d.doc_id, coalesce(string_agg(name, ',' ORDER BY i), '') AS names FROM documents d LEFT JOIN (FROM f WHERE name <> 'the') f USING (doc_id) WHERE text IS NOT NULL GROUP BY d.doc_id""")
def named_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G16, F34's tokens"""
    return t(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(answers.named_words(F.col("text"), ["the"]), ",").alias("names"))
