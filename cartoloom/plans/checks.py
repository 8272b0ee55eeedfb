"""Queries on sites and on the lint of what is written about them.

Pages are pages; customers, parts and orders stand in for findings, questions, links, labels and notes, with keys chosen so
that every rule is broken by some rows and kept by others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoloom.functions import pages as html
from cartoloom.functions import text
from cartoloom.operators import claims, sites
from cartoloom.plans.registry import query, t

_HOST = "lower(regexp_extract(url, '^https?://([^/?#]+)', 1))"
_PATH = "regexp_replace(lower(regexp_extract(url, '^(?:[a-z][a-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)), '/+$', '')"
_SEGMENTS = f"list_filter(string_split({_PATH}, '/'), lambda s: s <> '')"


@query(f"""SELECT page_id, {_HOST} <> '' AND regexp_replace({_HOST}, '^www\\.', '') = 'ththre.example.com' AND NOT regexp_matches(url, '(?i)\\.(jpg|jpeg|png|gif|webp|svg|pdf|zip|mp4|css|js)(\\?|$)|/wp-(admin|json|content)/|/feed/?$|/tag/|/author/|/page/\\d|[?&](s|p|replytocom)=|/cart|/checkout|/my-account|/privacy|/terms') AS crawl,
CASE WHEN len({_SEGMENTS}) = 0 THEN 100 WHEN len(list_filter({_SEGMENTS}, lambda s: regexp_matches(s, '^(?:en|fr)|(?:en|fr)$'))) > 0 THEN 70 - len({_SEGMENTS}) * 3 WHEN len(list_filter({_SEGMENTS}, lambda s: regexp_matches(s, '^(?:[0-9]+)|(?:[0-9]+)$'))) > 0 THEN 20 - len({_SEGMENTS}) * 3 ELSE 0 END::INTEGER AS score FROM pages""")
def crawl_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14, P20"""
    u = F.col("url")
    return t(spark, sf_dir, "pages").select("page_id", sites.crawlable(u, F.lit("www.ththre.example.com")).alias("crawl"), sites.path_score(u, [("en|fr", 7), ("[0-9]+", 2)]).alias("score"))


@query("""WITH k AS (SELECT *, CASE page_id % 5 WHEN 0 THEN 'noindex, follow' WHEN 1 THEN 'index' WHEN 2 THEN 'follow, none' END AS robots, CASE WHEN page_id % 7 = 0 THEN 'NOINDEX' END AS header, CASE WHEN page_id % 9 = 0 THEN 301 ELSE 200 END AS status, CASE WHEN page_id % 4 = 0 THEN '' WHEN page_id % 4 = 1 THEN url || '#' ELSE url END AS canonical FROM pages),
n AS (SELECT *, contains(lower(coalesce(robots, '') || ' ' || coalesce(header, '')), 'noindex') OR list_contains(list_transform(string_split(lower(coalesce(robots, '') || ' ' || coalesce(header, '')), ','), lambda x: trim(x)), 'none') AS blocked FROM k)
SELECT page_id, blocked, status = 200 AND NOT blocked AND (canonical = '' OR canonical = url) AS indexable FROM n""")
def indexable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P27"""
    k, u = F.col("page_id"), F.col("url")
    blocked = sites.noindex(F.when(k % 5 == 0, "noindex, follow").when(k % 5 == 1, "index").when(k % 5 == 2, "follow, none"), F.when(k % 7 == 0, "NOINDEX"))
    canonical = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(u, F.lit("#"))).otherwise(u)
    return t(spark, sf_dir, "pages").select("page_id", blocked.alias("blocked"), sites.indexable(F.when(k % 9 == 0, 301).otherwise(200), u, u, canonical, blocked).alias("indexable"))


@query("""SELECT s_suppkey, CASE WHEN code = 0 OR code >= 400 THEN 'UNREACHABLE' WHEN p = '' THEN 'REACHABLE' WHEN contains(s_name, '7') THEN 'REACHABLE' ELSE 'PARAM-STRIPPED' END AS verdict FROM (SELECT *, CASE s_suppkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 404 ELSE 200 END AS code, CASE WHEN s_suppkey % 4 = 2 THEN '' ELSE 'q' END AS p FROM supplier)""")
def endpoint_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P28"""
    k = F.col("s_suppkey")
    return t(spark, sf_dir, "supplier").select("s_suppkey", sites.reachability(F.when(k % 6 == 1, 404).when(k % 6 != 0, 200), F.col("s_name"), F.when(k % 4 != 2, "q"), "7").alias("verdict"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'text' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'sitemap' WHEN c_mktsegment = 'MACHINERY' THEN 'text' END AS kind FROM customer""")
def claim_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P29"""
    s = F.col("c_mktsegment")
    value = F.when(s == "HOUSEHOLD", "Not in the Sitemap").when(s == "MACHINERY", "it doesn't mention prices").when(s == "BUILDING", "sitemap lists it").otherwise("nothing here is a knot in the mission")
    return t(spark, sf_dir, "customer").select("c_custkey", sites.claim_kind(value, F.when(F.col("c_custkey") % 7 == 0, "price")).alias("kind"))


@query("""WITH f AS (SELECT page_id, list_filter([CASE WHEN regexp_matches(html, 'ld\\+json') THEN 'schema' END, CASE WHEN regexp_matches(html, 'track\\(|analytics') THEN 'tracking' END, CASE WHEN regexp_matches(html, 'class="ad"') THEN 'ads' END], lambda x: x IS NOT NULL) AS f FROM pages)
SELECT page_id, array_to_string(f, ',') AS families, CASE WHEN len(f) >= 2 THEN 'high' WHEN len(f) = 1 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN len(f) >= 3 THEN 'tokens' WHEN page_id % 5 >= 3 THEN 'hex' ELSE 'insufficient' END AS method FROM f""")
def stack_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P24, M10, M11"""
    f = sites.signals(F.col("html"), {"schema": [r"ld\+json"], "tracking": [r"track\(", "analytics"], "ads": ['class="ad"']})
    return t(spark, sf_dir, "pages").select("page_id", F.array_join(f, ",").alias("families"), sites.confidence(f).alias("confidence"), sites.palette_method(F.size(f), F.col("page_id") % 5).alias("method"))


@query("""SELECT value, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(html), '<[a-z][a-z0-9]*')) AS value FROM pages) GROUP BY value ORDER BY n DESC, value LIMIT 20""")
def frequent_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent matches of a pattern"""
    return sites.frequent(t(spark, sf_dir, "pages"), "html", "<[a-z][a-z0-9]*")


@query(f"""WITH w AS (SELECT page_id % 40 AS nr, CASE WHEN page_id % 3 = 0 THEN url || '/' ELSE url || 'x' END AS url FROM pages)
SELECT 'page' AS kind, url FROM pages WHERE regexp_replace(url, '/+$', '') IN (SELECT regexp_replace(url, '/+$', '') FROM w) UNION ALL SELECT 'missing', url FROM w WHERE regexp_replace(url, '/+$', '') NOT IN (SELECT regexp_replace(url, '/+$', '') FROM pages)""")
def wanted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J23"""
    p = t(spark, sf_dir, "pages").select("page_id", "url")
    w = p.select(F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("/"))).otherwise(F.concat("url", F.lit("x"))).alias("url"))
    bare = F.regexp_replace("url", "/+$", "")
    there, gone = sites.wanted_pages(p, w, key=bare, wanted_key=bare)
    return there.select(F.lit("page").alias("kind"), "url").unionByName(gone.select(F.lit("missing").alias("kind"), "url"))


@query(f"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href="([^"]+)"', 1), 1) AS i FROM pages),
k AS (SELECT *, regexp_replace(regexp_replace(href, '#.*$', ''), '/+$', '') AS k FROM h), f AS (SELECT *, row_number() OVER (PARTITION BY page_id, k ORDER BY i) AS rn FROM k), s AS (SELECT *, length(href) % 5 - 1 AS score FROM f WHERE rn = 1)
SELECT page_id, href, score::INTEGER AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, i)::INTEGER AS rank FROM s WHERE score >= 0) WHERE rank <= 3""")
def picked_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D02, O07"""
    h = t(spark, sf_dir, "pages").select("page_id", F.posexplode(html.hrefs(F.col("html"))).alias("i", "href"))
    return sites.picked(h, by="page_id", order="i", url="href", score=F.length("href") % 5 - 1).select("page_id", "href", "score", "rank")


@query("""SELECT n_name, CASE n_name WHEN 'NATION_3' THEN 0 WHEN 'NATION_1' THEN 1 ELSE 2 END AS rank FROM nation""")
def fixed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O10"""
    return sites.in_fixed_order(t(spark, sf_dir, "nation"), "n_name", ["NATION_3", "NATION_1"]).select("n_name", "rank")


@query("""WITH p AS (SELECT DISTINCT user_id AS url, TIMESTAMP '2024-01-10 00:00:00' + INTERVAL 1 HOUR * (user_id % 300) AS wanted FROM events), s AS (SELECT DISTINCT user_id AS url, ts AS taken FROM events WHERE user_id % 7 <> 0)
SELECT p.url, strftime(p.wanted, '%Y-%m-%d %H') AS wanted, strftime(arg_min(s.taken, (abs(epoch_us(s.taken) - epoch_us(p.wanted)), epoch_us(s.taken))), '%Y-%m-%d %H:%M:%S') AS taken FROM p LEFT JOIN s USING (url) GROUP BY p.url, p.wanted""")
def closest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join to the nearest time"""
    e = t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    wanted = F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit("2024-01-10 00:00:00"))) + 3600 * (F.col("user_id") % 300))
    p = e.select(F.col("user_id").alias("url"), wanted.alias("wanted")).distinct()
    s = e.where("user_id % 7 <> 0").select(F.col("user_id").alias("url"), F.col("ts").alias("taken"), F.lit("x").alias("v")).distinct()
    got = sites.closest_snapshot(p, s, key="url", wanted="wanted", taken="taken", value="v")
    return got.select("url", F.date_format("wanted", "yyyy-MM-dd HH").alias("wanted"), F.date_format("taken", "yyyy-MM-dd HH:mm:ss").alias("taken"))


@query("""WITH RECURSIVE l AS (SELECT DISTINCT l_partkey % 150 AS source, l_suppkey % 150 AS destination FROM lineitem), w(url, level) AS (SELECT 1::BIGINT, 0 UNION SELECT l.destination, w.level + 1 FROM w JOIN l ON l.source = w.url WHERE w.level < 3)
SELECT url, min(level)::INTEGER AS level FROM w GROUP BY url""")
def crawl_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first levels over a saved link table"""
    l = t(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 150).alias("source"), (F.col("l_suppkey") % 150).alias("destination"))  # noqa: E741
    return sites.crawl_levels(l, spark.range(1).select(F.lit(1).cast("long").alias("url")), depth=3)


@query("""WITH g AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) AS rn FROM part) SELECT p_partkey, p_type, p_size FROM g WHERE rn <= 8 ORDER BY p_size DESC, p_partkey LIMIT 40""")
def crawl_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frontier's order under a quota for each group"""
    return sites.with_quota(t(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size"), group="p_type", score="p_size", url="p_partkey", budget=40)


_FILES = """f AS (SELECT CASE WHEN page_id % 6 = 0 THEN 'rendered_' ELSE 'original_' END || 'https_a.org_' || (page_id // 2) || '_x' || CASE WHEN page_id % 10 = 3 THEN '.txt' ELSE '.html' END AS name, CASE page_id % 4 WHEN 0 THEN 'https://a.org/same' || (page_id // 40) WHEN 1 THEN 'https://a.org/own' || page_id END AS canonical, CASE WHEN page_id % 3 = 0 THEN 'https://a.org/og' || page_id END AS og_url FROM pages),
n AS (SELECT DISTINCT *, CASE WHEN name LIKE '%.html' THEN 'https://a.org/' || replace(regexp_extract(name, 'a\\.org_(.*)\\.html', 1), '_', '/') END AS by_name, count(*) OVER (PARTITION BY canonical) > 1 AS shared FROM f),
u AS (SELECT *, CASE WHEN canonical IS NOT NULL AND NOT shared THEN canonical ELSE coalesce(CASE WHEN shared THEN by_name END, canonical, og_url, by_name) END AS url FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY CASE WHEN starts_with(name, 'rendered_') THEN 0 ELSE 1 END, name) AS rn FROM u)"""


@query(f"WITH {_FILES} SELECT name, url FROM r WHERE url IS NULL OR rn = 1")
def saved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S07, S08"""
    k = F.col("page_id")
    c = lambda x: x.cast("string")
    name = F.concat(F.when(k % 6 == 0, "rendered_").otherwise("original_"), F.lit("https_a.org_"), c(F.floor(k / 2)), F.lit("_x"), F.when(k % 10 == 3, ".txt").otherwise(".html"))
    canonical = F.when(k % 4 == 0, F.concat(F.lit("https://a.org/same"), c(F.floor(k / 40)))).when(k % 4 == 1, F.concat(F.lit("https://a.org/own"), c(k)))
    files = t(spark, sf_dir, "pages").select(name.alias("name"), canonical.alias("canonical"), F.when(k % 3 == 0, F.concat(F.lit("https://a.org/og"), c(k))).alias("og_url"))
    return sites.file_pages(files).select("name", "url")


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))), ' ') AS emails, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\+[0-9]{1,3}[ -]?\(?[0-9]{1,4}\)?(?:[ -]?[0-9]){6,10}'))), ' ') AS phones FROM documents WHERE text IS NOT NULL""")
def page_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F31"""
    found = sites.entities(F.col("text"))
    return t(spark, sf_dir, "documents").where("text is not null").select("doc_id", *[F.array_join(found[c], " ").alias(c) for c in ("emails", "phones")])


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (props->>'k') WHEN event_id % 3 = 1 THEN CASE WHEN event_id % 2 = 0 THEN event_type END END AS value FROM events""")
def first_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F22"""
    k = F.col("event_id")
    doc = F.when(k % 3 == 0, F.concat(F.lit('{"a":{"b":""},"c":[],"x":'), "props", F.lit("}"))).when(k % 3 == 1, F.concat(F.lit('{"a":{"b":"'), F.when(k % 2 == 0, F.col("event_type")).otherwise(""), F.lit('"}}'))).otherwise("not json")
    return t(spark, sf_dir, "events").select("event_id", sites.first_path(doc, ["a.b", "c", "x.k"]).alias("value"))


@query("""WITH s AS (SELECT conv_id, turn, list_filter(string_split(text, '. '), lambda x: x <> '') AS s, 'S' || lpad(row_number() OVER (PARTITION BY conv_id ORDER BY turn)::VARCHAR, 2, '0') AS section_id FROM conversations WHERE text IS NOT NULL),
e AS (SELECT conv_id, turn, section_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS i FROM s)
SELECT conv_id, section_id, section_id || '.' || lpad(i::VARCHAR, 2, '0') AS sentence_id, length(sentence) AS size, round((row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1) / count(*) OVER (PARTITION BY conv_id), 6) AS position FROM e""")
def section_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W13, W15"""
    s = t(spark, sf_dir, "conversations").where("text is not null").withColumn("s", F.filter(F.split("text", r"\. "), lambda x: x != ""))
    return sites.section_ids(s, page="conv_id", order="turn", sentences="s").select("conv_id", "section_id", "sentence_id", F.length("sentence").alias("size"), F.round("position", 6).alias("position"))


_E = "SELECT 'error' AS severity, '{0}' AS rule, {1}::VARCHAR AS key FROM {2}"


def _sql(*rules: tuple[str, str, str], ctes: str = "", warn: tuple[str, ...] = ()) -> str:
    return (f"WITH {ctes} " if ctes else "") + " UNION ALL ".join(_E.format(*r).replace("'error'", "'warn'") if r[0] in warn else _E.format(*r) for r in rules)


_FINDINGS = """f AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['p1', 'ghost'] ELSE ['p' || (c_custkey % 3)] END AS personas, CASE c_custkey % 3 WHEN 0 THEN 'minor' WHEN 1 THEN 'major' ELSE 'critical' END AS severity, c_mktsegment AS category FROM customer),
p AS (SELECT unnest(['p0', 'p1', 'p2', 'p9']) AS id), u AS (SELECT DISTINCT unnest(personas) AS x FROM f), r AS (SELECT c_custkey * 40 AS id FROM customer)"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    personas = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 == 1, F.array(F.lit("p1"), F.lit("ghost"))).otherwise(F.array(F.concat(F.lit("p"), (k % 3).cast("string"))))
    return t(spark, sf_dir, "customer").select(k.alias("id"), personas.alias("personas"), F.when(k % 3 == 0, "minor").when(k % 3 == 1, "major").otherwise("critical").alias("severity"), F.col("c_mktsegment").alias("category"))


@query(_sql(("needs a persona", "id", "f WHERE len(personas) = 0"), ("persona not defined", "x", "u WHERE x NOT IN (SELECT id FROM p)"), ("persona not used", "id", "p WHERE id NOT IN (SELECT x FROM u)"),
            ("three to seven priorities", "'priorities'", "(SELECT count(*) AS n FROM r) WHERE n NOT BETWEEN 3 AND 7"), ("priority does not exist", "id", "r WHERE id NOT IN (SELECT id FROM f)"), ("priority is minor", "r.id", "r JOIN f ON r.id = f.id WHERE severity = 'minor'"), ctes=_FINDINGS))
def persona_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14"""
    f = _findings(spark, sf_dir)
    people = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("p0", "p1", "p2", "p9")])).alias("id"))
    r = t(spark, sf_dir, "customer").select((F.col("c_custkey") * 40).alias("id"))
    return claims.persona_rules(f, people).unionByName(claims.priority_rules(r, f))


@query(f"""WITH {_FINDINGS}, c AS (SELECT category, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'major') AS major, count(*) FILTER (severity = 'minor') AS minor FROM f GROUP BY category)
SELECT *, row_number() OVER (ORDER BY category = 'BUILDING', critical DESC, major DESC, category)::INTEGER AS place FROM c""")
def severity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A32"""
    return claims.severity_counts(_findings(spark, sf_dir), last="BUILDING")


_CLAIMS = """c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'sitemap' WHEN o_orderkey % 3 = 1 THEN 'text' END AS kind, 'u' || (o_custkey % 50) AS u, o_orderstatus AS term FROM orders),
k AS (SELECT 'u' || s_suppkey AS u, 'P' AS term, CASE WHEN s_suppkey % 4 = 0 THEN 500 ELSE 200 END AS status, s_suppkey % 3 = 0 AS absent FROM supplier WHERE s_suppkey < 40), b AS (SELECT 'u' || s_suppkey AS u, s_suppkey % 2 = 0 AS inside FROM supplier WHERE s_suppkey < 30)"""


@query(_sql(("text not checked", "id", "c LEFT JOIN k USING (u, term) WHERE kind = 'text' AND status IS NULL"), ("page not fetched", "id", "c JOIN k USING (u, term) WHERE kind = 'text' AND status <> 200"), ("term is there", "id", "c JOIN k USING (u, term) WHERE kind = 'text' AND status = 200 AND NOT absent"),
            ("sitemap not probed", "id", "c LEFT JOIN b USING (u) WHERE kind = 'sitemap' AND inside IS NULL"), ("page is in the sitemap", "id", "c JOIN b USING (u) WHERE kind = 'sitemap' AND inside"), ctes=_CLAIMS))
def absence_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15, V03"""
    k, s = F.col("o_orderkey"), F.col("s_suppkey")
    u = lambda x: F.concat(F.lit("u"), x.cast("string"))
    c = t(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 3 == 0, "sitemap").when(k % 3 == 1, "text").alias("kind"), F.concat(u(F.col("o_custkey") % 50), F.lit("/")).alias("url"), F.col("o_orderstatus").alias("term"))
    sup = t(spark, sf_dir, "supplier")
    checks = sup.where("s_suppkey < 40").select(u(s).alias("url"), F.lit("P").alias("term"), F.when(s % 4 == 0, 500).otherwise(200).alias("status"), (s % 3 == 0).alias("absent"))
    return claims.absence_rules(c, checks, sup.where("s_suppkey < 30").select(u(s).alias("url"), (s % 2 == 0).alias("in_sitemap")))


_QUESTIONS = """q AS (SELECT p_partkey % 300 AS n, p_name || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '?' END AS question, CASE WHEN p_partkey % 8 = 0 THEN 'see {{x}}' ELSE p_type || repeat(' word', p_size * 8) END AS answer, p_brand AS bucket, p_type AS placement, CASE p_partkey % 4 WHEN 0 THEN 'first-party' WHEN 1 THEN 'mixed' WHEN 2 THEN 'rumour' END AS evidence, CASE WHEN p_partkey % 5 = 0 THEN ['note'] ELSE ['http://x'] END AS sources FROM part)"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return t(spark, sf_dir, "part").select(
        (k % 300).alias("n"), F.concat("p_name", F.when(k % 3 == 0, "").otherwise("?")).alias("question"), F.when(k % 8 == 0, "see {{x}}").otherwise(F.concat("p_type", F.expr("repeat(' word', p_size * 8)"))).alias("answer"),
        F.col("p_brand").alias("bucket"), F.col("p_type").alias("placement"), F.when(k % 4 == 0, "first-party").when(k % 4 == 1, "mixed").when(k % 4 == 2, "rumour").alias("evidence"), F.when(k % 5 == 0, F.array(F.lit("note"))).otherwise(F.array(F.lit("http://x"))).alias("sources"),
    )


@query(_sql(("duplicate id", "n", "(SELECT n FROM q GROUP BY n HAVING count(*) > 1)"), ("no question mark", "n", "q WHERE question NOT LIKE '%?'"), ("unknown bucket", "n", "q WHERE bucket NOT IN ('Brand#1', 'Brand#2', 'Brand#3')"), ("unknown placement", "n", "q WHERE placement NOT IN ('ECONOMY', 'PROMO')"),
            ("unknown evidence", "n", "q WHERE coalesce(evidence, '') NOT IN ('first-party', 'third-party', 'mixed')"), ("no source", "n", "q WHERE sources[1] = 'note'"), ("placeholder left", "n", "q WHERE contains(answer, '{{')"), ("answer too long", "n", "q WHERE len(list_filter(string_split(answer, ' '), lambda w: w <> '')) > 180"), ctes=_QUESTIONS, warn=("answer too long",)))
def question_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V04"""
    return claims.question_rules(_questions(spark, sf_dir), buckets=["Brand#1", "Brand#2", "Brand#3"], placements=["ECONOMY", "PROMO"])


@query(f"WITH {_QUESTIONS} SELECT bucket, count(*) AS n FROM q GROUP BY bucket")
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A33"""
    return claims.bucket_counts(_questions(spark, sf_dir))


_LINKS = f"""{_QUESTIONS}, i AS (SELECT l_partkey AS n, l_returnflag || ' a' AS anchor, 'u' || (l_suppkey % 9) AS url FROM lineitem), e AS (SELECT l_partkey AS n, 'small ring?' AS question, l_linestatus || ' a' AS anchor, 'u' || (l_suppkey % 9) AS url FROM lineitem),
a AS (SELECT n, url, anchor, 'inline' AS via FROM i UNION ALL SELECT e.n, url, anchor, 'picked' FROM e JOIN q ON e.n = q.n UNION ALL SELECT q.n, url, anchor, 'picked' FROM e JOIN q ON e.question = q.question), l AS (SELECT n, url, anchor, min(via) AS via FROM a GROUP BY n, url, anchor)"""


def _question_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = t(spark, sf_dir, "lineitem")  # noqa: E741
    url = F.concat(F.lit("u"), (F.col("l_suppkey") % 9).cast("string")).alias("url")
    inline = l.select(F.col("l_partkey").alias("n"), F.concat("l_returnflag", F.lit(" a")).alias("anchor"), url)
    picked = l.select(F.col("l_partkey").alias("n"), F.lit(" small ring?").alias("question"), F.concat("l_linestatus", F.lit(" a")).alias("anchor"), url)
    return claims.question_links(_questions(spark, sf_dir), inline, picked)


@query(f"WITH {_LINKS} SELECT * FROM l")
def question_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J17"""
    return _question_links(spark, sf_dir)


@query(_sql(("more than one link", "n", "(SELECT n FROM l GROUP BY n HAVING count(DISTINCT url) > 1 OR count(*) FILTER (via = 'inline') > 1)"), ("target not in inventory", "n", "x WHERE status IS NULL"), ("target redirects or errors", "n", "x WHERE status <> 200 OR final <> url"), ("target not indexable", "n", "x WHERE status = 200 AND final = url AND NOT indexable"),
            ("target not self-canonical", "n", "x WHERE canonical <> '' AND canonical <> url"), ("links to the home page", "n", "x WHERE home"), ("anchor not verbatim", "n", "l WHERE NOT contains('R a F a', anchor)"), ("generic anchor", "n", "l WHERE anchor = 'F a'"), ("anchor is the brand", "n", "l WHERE anchor = 'O a'"),
            ("target used too often", "url", "(SELECT url FROM l GROUP BY url HAVING count(*) > 2)"),
            ctes=_LINKS + ", v AS (SELECT 'u' || s_suppkey AS url, CASE WHEN s_suppkey = 3 THEN 404 ELSE 200 END AS status, CASE WHEN s_suppkey = 4 THEN 'u5' ELSE 'u' || s_suppkey END AS final, CASE WHEN s_suppkey = 5 THEN 'u6' ELSE '' END AS canonical, s_suppkey <> 6 AS indexable, s_suppkey = 1 AS home FROM supplier), x AS (SELECT l.*, v.* EXCLUDE (url) FROM l LEFT JOIN v USING (url))"))
def link_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V05"""
    s = F.col("s_suppkey")
    u = lambda x: F.concat(F.lit("u"), x.cast("string"))
    inventory = t(spark, sf_dir, "supplier").select(u(s).alias("url"), F.when(s == 3, 404).otherwise(200).alias("status"), F.when(s == 4, "u5").otherwise(u(s)).alias("final"), F.when(s == 5, "u6").otherwise("").alias("canonical"), (s != 6).alias("indexable"), (s == 1).alias("home"))
    return claims.link_rules(_question_links(spark, sf_dir).withColumn("answer", F.lit("R a F a")), inventory, generic=["f a"], brand="O a")


@query("""WITH w AS (SELECT conv_id * 100 + turn AS n, lower(text) AS q, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 1)) AS tokens FROM conversations)
SELECT a.n AS a, b.n AS b FROM w a JOIN w b ON a.n < b.n WHERE a.q = b.q OR (len(a.tokens) > 0 AND len(b.tokens) > 0 AND round(len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(a.tokens || b.tokens)), 9) >= 0.2)""")
def near_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D14"""
    words = F.array_distinct(F.filter(text.ascii_words(F.col("text")), lambda w: F.length(w) > 1))
    c = t(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("n"), F.col("text").alias("question"), words.alias("tokens"))
    return claims.near_questions(c, least=0.2)


@query("""WITH x AS (SELECT string_agg(n_name || ':' || sha256(n_regionkey::VARCHAR), chr(10) ORDER BY n_name || ':' || sha256(n_regionkey::VARCHAR)) AS s FROM nation) SELECT sha256(s) AS fingerprint, false AS same FROM x""")
def input_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V06"""
    n = t(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("content"))
    return claims.unchanged(n, F.lit("0"))


@query("""SELECT conv_id * 100 + turn AS name, term FROM conversations, (SELECT unnest(['tHe', 'ouon', 'zzz']) AS term) WHERE contains(lower(text), lower(term))""")
def leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V07"""
    c = t(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("name"), F.col("text").alias("content"))
    return claims.leaks(c, ["tHe", "ouon", "zzz"])


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'no list' WHEN 1 THEN 'empty list' WHEN 2 THEN 'a query is empty' WHEN 3 THEN 'unknown coverage' END AS problem FROM part""")
def prediction_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V08"""
    k = F.col("p_partkey")
    one = lambda q, c: F.array(F.struct(F.lit("ok").alias("query"), F.lit("x").alias("type"), F.lit("yes").alias("coverage")), F.struct(F.lit(q).alias("query"), F.lit("x").alias("type"), F.lit(c).alias("coverage")))
    answer = F.when(k % 5 == 1, F.slice(one("a", "no"), 1, 0)).when(k % 5 == 2, one("  ", "no")).when(k % 5 == 3, one("a", "maybe")).when(k % 5 == 4, one("a", "partial"))
    return t(spark, sf_dir, "part").select("p_partkey", claims.prediction_problem(answer).alias("problem"))


_ASPECTS = """a AS (SELECT CASE WHEN n_nationkey = 4 THEN 'Bad Id' ELSE lower(n_name) END AS id, CASE WHEN n_nationkey = 5 THEN '' ELSE n_name END AS label, CASE WHEN n_nationkey <> 6 THEN 'd' END AS description, CASE WHEN n_regionkey = 1 THEN 'nobody' ELSE 'product' END AS owner FROM nation),
l AS (SELECT doc_id AS id, 'nation_' || (doc_id % 30) AS aspect, (doc_id % 6 - 2)::INTEGER AS polarity, CASE doc_id % 4 WHEN 0 THEN 'minor' WHEN 1 THEN 'fatal' END AS severity FROM documents)"""


@query(_sql(("eight to fifteen aspects", "'aspects'", "(SELECT count(*) AS n FROM a) WHERE n NOT BETWEEN 8 AND 15"), ("id format", "id", "a WHERE NOT regexp_full_match(id, '[a-z][a-z0-9_]{1,40}')"), ("duplicate id", "id", "(SELECT id FROM a GROUP BY id HAVING count(*) > 1)"), ("missing label", "id", "a WHERE label = ''"), ("missing description", "id", "a WHERE description IS NULL"), ("unknown owner", "id", "a WHERE owner <> 'product'"),
            ("unknown review", "id", "l WHERE id NOT IN (SELECT doc_id FROM labels)"), ("unknown aspect", "id", "l WHERE aspect NOT IN (SELECT id FROM a)"), ("polarity out of range", "id", "l WHERE abs(polarity) > 2"), ("unknown severity", "id", "l WHERE severity = 'fatal'"), ctes=_ASPECTS))
def label_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V09"""
    n, d = F.col("n_nationkey"), F.col("doc_id")
    a = t(spark, sf_dir, "nation").select(F.when(n == 4, "Bad Id").otherwise(F.lower("n_name")).alias("id"), F.when(n == 5, "").otherwise(F.col("n_name")).alias("label"), F.when(n != 6, "d").alias("description"), F.when(F.col("n_regionkey") == 1, "nobody").otherwise("product").alias("owner"))
    labels = t(spark, sf_dir, "documents").select(d.alias("id"), F.create_map(F.concat(F.lit("nation_"), (d % 30).cast("string")), (d % 6 - 2).cast("int")).alias("aspects"), F.when(d % 4 == 0, "minor").when(d % 4 == 1, "fatal").alias("severity"))
    return claims.taxonomy_rules(a, owners=["product"]).unionByName(claims.label_rules(labels, a, t(spark, sf_dir, "labels").select(d.alias("id"))))


@query(_sql(("calls few reviews a pattern", "s_suppkey", "supplier WHERE s_suppkey % 5 < 3 AND s_suppkey % 3 = 0"), ("note is not complete", "s_suppkey", "supplier WHERE s_suppkey % 4 = 0"), warn=("calls few reviews a pattern", "note is not complete")))
def note_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V10"""
    k = F.col("s_suppkey")
    n = t(spark, sf_dir, "supplier").select(k.alias("id"), (k % 5).alias("negative"), F.when(k % 3 == 0, "a Recurring fault").otherwise("one reviewer").alias("problem"), *[F.lit("x").alias(c) for c in ("root_cause", "fix", "geo_action")], F.when(k % 4 == 0, " ").otherwise("m").alias("metric"))
    return claims.note_rules(n)


@query("""SELECT count(*) FILTER (quality = 1) AS agreed, count(*) AS total, round(count(*) FILTER (quality = 1) / count(*), 3) AS rate, count(*) FILTER (quality = 1) / count(*) >= 0.85 AS accepted FROM labels""")
def spot_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V11"""
    return claims.agreement(t(spark, sf_dir, "labels").withColumn("ok", F.col("quality") == 1), right="ok")


@query("""SELECT * FROM (VALUES ('error', 'section missing', 'NATION_99'), ('error', 'section out of order', 'NATION_2')) v(severity, rule, key)""")
def section_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V12"""
    return claims.section_rules(t(spark, sf_dir, "nation").select(F.col("n_name").alias("title"), F.col("n_nationkey").alias("place")), ["NATION_1", "NATION_5", "NATION_2", "NATION_99", "NATION_7"])


@query(_sql(("empty group", "'ZEBRA'", "(SELECT 1)"), ("no text", "c_custkey", "customer WHERE c_custkey % 9 = 0"), ("text too long", "c_custkey", "customer WHERE c_custkey % 9 <> 0 AND length(c_name) * (c_custkey % 10) > 90")))
def prompt_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V15"""
    k = F.col("c_custkey")
    p = t(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_mktsegment").alias("group"), F.when(k % 9 == 0, "").otherwise(F.expr("repeat(c_name, cast(c_custkey % 10 as int))")).alias("text"))
    return claims.prompt_rules(p.where("id % 10 <> 0 or id % 9 = 0"), groups=["BUILDING", "ZEBRA"], longest=90)


@query(_sql(("label missing", "'NATION_77'", "(SELECT 1)"), ("fact without source", "n_name", "nation WHERE n_nationkey % 5 = 0"), ("promise or superlative", "doc_id", "documents WHERE regexp_matches(text, '(?i)\\b(?:ouon|les)\\b')"), ("too long", "'document'", "(SELECT 1)"), warn=("too long",)))
def fact_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V02"""
    n = F.col("n_nationkey")
    facts = t(spark, sf_dir, "nation").select(F.col("n_name").alias("label"), F.when(n % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("s"))).alias("sources"))
    parts = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    return claims.fact_rules(facts, parts, labels=["NATION_1", "NATION_77"], promises=r"(?i)(?:^|[^A-Za-z0-9_])(?:ouon|les)(?:$|[^A-Za-z0-9_])")


@query("""SELECT p_partkey, 7 AS i1, greatest(1, least(10, round(9 - (p_partkey % 101) / 100.0 * 8)))::INTEGER AS c1, 5 AS e1, greatest(1, least(10, round(3 + 6 * (p_size / 50.0))))::INTEGER AS c2, CASE WHEN p_partkey % 2 = 0 THEN 9 ELSE 6 END AS i3, CASE p_partkey % 4 WHEN 0 THEN 8 WHEN 1 THEN 8 WHEN 2 THEN 6 ELSE 4 END AS c3, CASE p_type WHEN 'PROMO' THEN 2 WHEN 'ECONOMY' THEN 3 WHEN 'STANDARD' THEN 8 ELSE 4 END AS e3, greatest(5, 10 - p_size)::INTEGER AS i4, CASE WHEN p_partkey % 10 >= 8 THEN 7 ELSE 5 END AS c4 FROM part""")
def ice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M08"""
    k = F.col("p_partkey")
    a, b = claims.optimise_ice(k % 101 / 100), claims.gap_ice(F.col("p_size"), F.lit(50))
    c = claims.dealbreaker_ice(F.when(k % 2 == 0, "critical").otherwise("major"), F.when(k % 4 == 0, "stated").when(k % 4 == 1, "contradicted").when(k % 4 == 2, "absent").otherwise("inferred"), F.when(F.col("p_type") == "PROMO", "faq").when(F.col("p_type") == "ECONOMY", "pricing-page").when(F.col("p_type") == "STANDARD", "product").otherwise("other"))
    d = claims.complaint_ice(F.col("p_size"), F.when(k % 10 >= 8, 0.9).otherwise(0.5))
    return t(spark, sf_dir, "part").select("p_partkey", a["impact"].alias("i1"), a["confidence"].alias("c1"), a["ease"].alias("e1"), b["confidence"].alias("c2"), c["impact"].alias("i3"), c["confidence"].alias("c3"), c["ease"].alias("e3"), d["impact"].alias("i4"), d["confidence"].alias("c4"))


_SITE = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"
_PATH = "regexp_replace(regexp_extract(url, '^[a-z]+://[^/:?#]+([^?#]*)', 1), '/+$', '')"


@query(rf"""WITH p AS (SELECT page_id, {_SITE} AS site, {_PATH} AS path, html, page_id AS k FROM pages),
w AS (SELECT page_id, len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<(?:script|style|title)[^>]*>.*?</(?:script|style|title)>', '', 'g'), '</?(?:p|div|br|li|ul|article|nav|footer|h1)[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'), '\s+'), lambda x: x <> '')) AS words FROM p),
s AS (SELECT DISTINCT site, path FROM p WHERE k % 3 = 0), h AS (SELECT DISTINCT site, path FROM p WHERE k % 4 = 1)
SELECT page_id, c.name, c.name = 'in llms.txt' AS optional, CASE c.name WHEN 'answers' THEN k % 7 > 0 WHEN 'indexable' THEN k % 8 > 1 WHEN 'canonical' THEN k % 5 > 0 WHEN 'served as text' THEN words + CASE WHEN k % 2 = 0 THEN 4 ELSE 0 END > 300
  WHEN 'names the brand' THEN contains(lower(html), 'ouan') WHEN 'updated within six months' THEN k % 2 = 0 AND k % 6 > 0 WHEN 'describes an organization' THEN k % 9 = 0 WHEN 'lets crawlers in' THEN p.site LIKE '%.org' OR p.path NOT LIKE '/en/%' OR p.path LIKE '/en/1%'
  WHEN 'in a sitemap' THEN s.path IS NOT NULL WHEN 'linked from the home page' THEN h.path IS NOT NULL ELSE p.site LIKE '%.net' AND contains('see /fr/1 and /en/2', p.path) END AS ok
FROM p JOIN w USING (page_id) LEFT JOIN s ON s.site = p.site AND s.path = p.path LEFT JOIN h ON h.site = p.site AND h.path = p.path,
(SELECT unnest(['answers', 'indexable', 'canonical', 'served as text', 'names the brand', 'updated within six months', 'describes an organization', 'lets crawlers in', 'in a sitemap', 'linked from the home page', 'in llms.txt']) AS name) c""")
def live_page_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven checks of the pages; heads, robots files, sitemaps and home pages are made for them"""
    k, site, path = F.col("page_id"), F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1), F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/:?#]+([^?#]*)", 1), "/+$", "")
    head = F.concat(F.when(k % 8 == 0, '<meta name="robots" content="NOINDEX">').otherwise(""), F.when(k % 5 == 0, '<link rel="canonical" href="https://else.org/">').otherwise(""), F.when(k % 9 == 0, '<script type="application/ld+json">{"@graph": [{"@type": "LocalBusiness"}]}</script>').otherwise(""))
    dated = F.when(k % 2 == 0, F.concat(F.lit("<p>Last updated: "), F.when(k % 6 == 0, "May 2025").otherwise("March 2026"), F.lit("</p>"))).otherwise("")
    html_ = F.replace(F.replace("html", F.lit("</head>"), F.concat(head, F.lit("</head>"))), F.lit("<article>"), F.concat(F.lit("<article>"), dated))
    own = F.concat(F.lit("https://"), site, path)
    p = t(spark, sf_dir, "pages").select("page_id", site.alias("site"), own.alias("url"), own.alias("final"), F.when(k % 7 == 0, 404).otherwise(200).alias("status"), html_.alias("html"), F.when(k % 8 == 1, "noindex").alias("robots_header"))
    robots = "User-agent: gptbot\nUser-agent: BingBot\nDisallow: /en/\nAllow: /en/1\n\nUser-agent: *\nDisallow:\n"
    sites_ = p.select("site").distinct().select("site", F.when(~F.endswith("site", F.lit(".org")), robots).alias("robots"), F.when(F.endswith("site", F.lit(".net")), "see /fr/1 and /en/2").alias("llms"))
    listed = p.where("page_id % 3 = 0").select("site", F.concat("url", F.lit("/")).alias("url"))
    linked = p.where("page_id % 4 = 1").select("site", F.concat("url", F.lit("#top")).alias("href"))
    return claims.live_checks(p, sites_, listed, linked, key="page_id", as_of=F.to_date(F.lit("2026-08-01")), brand="OUAN")
