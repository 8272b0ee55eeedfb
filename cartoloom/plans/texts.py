"""Queries on the functions for markup, JSON and report text, and on samples and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoloom.functions import documents, text
from cartoloom.functions import pages as html
from cartoloom.operators import evidence, reviews, topics, voice
from cartoloom.plans.registry import query, t


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN '-' ELSE (n_nationkey * 4)::VARCHAR || '%' END AS share, format('{:,}', n_nationkey * 123457) AS big FROM nation""")
def formatted_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F18"""
    k = F.col("n_nationkey")
    return t(spark, sf_dir, "nation").select("n_nationkey", documents.percent(F.when(k % 4 != 0, k / 25)).alias("share"), documents.grouped(k * 123457).alias("big"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 50) / 10.0 END::DOUBLE AS rating, CASE WHEN c_custkey % 4 > 0 THEN c_custkey * 1000 END AS reviews FROM customer""")
def page_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F30"""
    k = F.col("c_custkey")
    said = F.concat(F.lit("Rated "), F.when(k % 3 > 0, F.format_number(k % 50 / 10, 1)).otherwise("well"), F.lit(" out of 5 by "), F.when(k % 4 > 0, F.format_number(k * 1000, 0)).otherwise("many"), F.lit(" reviews"))
    return t(spark, sf_dir, "customer").select("c_custkey", documents.page_stats(said).alias("x")).select("c_custkey", "x.*")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'heading' WHEN 1 THEN 'comment' ELSE 'paragraph' END AS kind, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 0 END AS level, CASE WHEN c_custkey % 3 = 1 THEN lower(c_mktsegment) END AS bucket FROM customer""")
def markdown_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F33"""
    k, s = F.col("c_custkey"), F.lower("c_mktsegment")
    md = F.concat(F.lit("Intro text\n\n"), F.when(k % 3 == 0, F.concat(F.lit("## "), s)).when(k % 3 == 1, F.concat(F.lit("<!-- Bucket: "), s, F.lit("; sources: a -->"))).otherwise(F.concat(s, F.lit("\nmore"))))
    second = documents.markdown_blocks(md)[1]
    return t(spark, sf_dir, "customer").select("c_custkey", second.alias("x")).select("c_custkey", "x.kind", "x.level", F.when(F.col("x.kind") == "comment", F.try_element_at(documents.metadata(F.col("x.text")), F.lit("bucket"))).alias("bucket"))


@query("""SELECT c_custkey, c_custkey % 4 IN (0, 1, 3) AS clean FROM customer""")
def clean_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a name between word ends or glued words"""
    k = F.col("c_custkey") % 4
    said = F.when(k == 0, "see Acme Co.").when(k == 1, "aboutAcme CoToday").when(k == 2, "xacme cox").otherwise("ACME CO")
    return t(spark, sf_dir, "customer").select("c_custkey", documents.cleanly_in(said, F.lit("Acme Co")).alias("clean"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN (p_partkey % 100) / 100.0 END::DOUBLE AS p, greatest(-2, least(2, p_size - 2))::INTEGER AS polarity, '{"keyword":"' || p_name || '","size":' || p_size || ',"system":"judge"}' AS request, 'Is ' || p_name || ' of size ' || p_size || '?' AS filled FROM part""")
def judge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F38, F39, F40"""
    k = F.col("p_partkey")
    answer = F.when(k % 3 == 0, F.concat(F.lit('{"p_same":'), (k % 100 / 100).cast("string"), F.lit("}"))).when(k % 3 == 1, '{"p_same":"often"}').otherwise('{"other":1}')
    return t(spark, sf_dir, "part").select("p_partkey", documents.judged(answer, "p_same").alias("p"), documents.polarity(F.col("p_size").cast("double")).alias("polarity"), documents.request("judge", size=F.col("p_size"), keyword=F.col("p_name")).alias("request"), documents.filled(F.lit("Is {name} of size {size}?"), {"name": F.col("p_name"), "size": F.col("p_size")}).alias("filled"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN '@graph(Org+Page)' WHEN 1 THEN 'FAQPage' WHEN 2 THEN 'EMPTY' WHEN 3 THEN 'UNPARSED' ELSE 'A+B, C' END AS block, CASE page_id % 5 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 4 THEN 2 ELSE 0 END AS objects FROM pages""")
def jsonld_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F24, F25, F26"""
    k = F.col("page_id") % 5
    block = F.when(k == 0, '<!-- {"@graph":[{"@type":"Org","x":{"y":1}},{"@type":"Page"}]} -->').when(k == 1, '{"@type":"FAQPage","mainEntity":[{"name":"q"}]}').when(k == 2, "  ").when(k == 3, "{oops").otherwise('[{"@type":["A","B"]},{"@type":"C"}]')
    plain = F.regexp_replace(block, "<!-- | -->", "")
    return t(spark, sf_dir, "pages").select("page_id", documents.described(block).alias("block"), F.size(documents.objects(plain)).alias("objects"))


@query("""SELECT page_id, 'G-ABC12' || (page_id % 10) || ' GTM-X' || (1000 + page_id) AS ids, page_id % 3 = 0 AS rendered FROM pages""")
def tag_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F32, P25"""
    k = F.col("page_id")
    source = F.concat(F.lit("gtag('GTM-X"), (k + 1000).cast("string"), F.lit("'); a('G-ABC12"), (k % 10).cast("string"), F.lit("'); a('G-ABC12"), (k % 10).cast("string"), F.lit("');"), F.when(k % 3 == 0, '<div id="root">').otherwise("<p>"))
    return t(spark, sf_dir, "pages").select("page_id", F.array_join(html.tag_ids(source), " ").alias("ids"), html.client_rendered(F.lit(20), source).alias("rendered"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '''self'' a.com' WHEN 1 THEN '''none''' END AS sources FROM supplier""")
def script_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P23"""
    k = F.col("s_suppkey") % 3
    policy = F.when(k == 0, "default-src 'none'; script-src 'self' A.com").when(k == 1, "img-src *; default-src 'none'").otherwise("img-src *")
    return t(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(html.csp_sources(policy, "script-src"), " ").alias("sources"))


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[“”‘’"''`]', '', 'g'), '[-‐-―/]', ' ', 'g') AS x FROM documents),
k AS (SELECT doc_id, trim(regexp_replace(regexp_replace(x, '[^\p{L}\p{M}\p{Nd}\p{Pc}\s%$€£.]', '', 'g'), '\s+', ' ', 'g')) AS key FROM d) SELECT doc_id, length(key)::INTEGER AS letters, md5(key) AS digest FROM k""")
def evidence_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whole texts as keys of comparison"""
    key = text.evidence_key(F.col("text"))
    return t(spark, sf_dir, "documents").select("doc_id", key.alias("key")).select("doc_id", F.length("key").alias("letters"), F.md5(F.col("key").cast("binary")).alias("digest"))


_FOUND = """f AS (SELECT CASE WHEN c_custkey % 50 = 0 THEN 'Bad Id' ELSE 'f-' || c_custkey % 1400 END AS id, c_mktsegment AS category, CASE c_custkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'minor' ELSE 'huge' END AS severity, CASE c_custkey % 4 WHEN 0 THEN 'stated' WHEN 1 THEN 'contradicted' WHEN 2 THEN 'absent' ELSE 'inferred' END AS e, c_custkey % 3 AS n, c_custkey % 2 AS c FROM customer)"""


@query(f"""WITH {_FOUND} SELECT 'error' AS severity, rule, key FROM (SELECT 'duplicate id' AS rule, id AS key FROM f GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'id format', id FROM f WHERE id = 'Bad Id' UNION ALL SELECT 'unknown category', id FROM f WHERE category NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT 'unknown severity', id FROM f WHERE severity = 'huge'
UNION ALL SELECT 'stated without source', id FROM f WHERE e = 'stated' AND n < 1 UNION ALL SELECT 'contradicted needs two sources', id FROM f WHERE e = 'contradicted' AND n < 2 UNION ALL SELECT 'absent needs two pages checked', id FROM f WHERE e = 'absent' AND c < 2 UNION ALL SELECT 'inferred cannot be critical', id FROM f WHERE e = 'inferred' AND severity = 'critical')""")
def finding_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V01"""
    k = F.col("c_custkey")
    some = lambda n: F.slice(F.array(F.lit("u"), F.lit("v"), F.lit("w")), F.lit(1), n.cast("int"))
    f = t(spark, sf_dir, "customer").select(F.when(k % 50 == 0, "Bad Id").otherwise(F.concat(F.lit("f-"), (k % 1400).cast("string"))).alias("id"), F.col("c_mktsegment").alias("category"), F.when(k % 3 == 0, "critical").when(k % 3 == 1, "minor").otherwise("huge").alias("severity"), F.when(k % 4 == 0, "stated").when(k % 4 == 1, "contradicted").when(k % 4 == 2, "absent").otherwise("inferred").alias("evidence"), some(k % 3).alias("sources"), some(k % 2).alias("checked"))
    return evidence.findings(f, ["BUILDING", "MACHINERY"])


@query("""WITH c AS (SELECT c_custkey, c_custkey || ' and ' || c_custkey * 3 AS said FROM customer), n AS (SELECT c_custkey, unnest([c_custkey, c_custkey * 3])::DOUBLE AS number FROM c) SELECT c_custkey, number FROM n WHERE number NOT IN (SELECT o_orderkey * 2 FROM orders)""")
def unproved_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a text that no evidence has"""
    k = F.col("c_custkey")
    c = t(spark, sf_dir, "customer").select("c_custkey", text.numbers_in(F.concat(k.cast("string"), F.lit(" and "), (k * 3).cast("string"))).alias("numbers"))
    found = t(spark, sf_dir, "orders").select(F.array((F.col("o_orderkey") * 2).cast("double")).alias("numbers"))
    return evidence.provenance(c, found, key="c_custkey", numbers="numbers").select("c_custkey", "number")


@query("""WITH k AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) SELECT event_type, least(n, 40 // (SELECT count(*) FROM k))::BIGINT AS taken FROM k""")
def sample_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each stratum a sample in turns takes"""
    e = t(spark, sf_dir, "events")
    return reviews.stratified(e, strata=["event_type"], key="event_id", n=40).groupBy("event_type").agg(F.count("*").alias("taken"))


@query("""WITH RECURSIVE p AS (SELECT n_regionkey AS site, n_nationkey AS place, 'k' || n_nationkey % 7 AS a, 'k' || n_nationkey % 5 AS b, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS nr FROM nation),
w AS (SELECT site, 0::BIGINT AS nr, []::VARCHAR[] AS seen, []::INTEGER[] AS taken FROM (SELECT DISTINCT site FROM p)
UNION ALL SELECT w.site, p.nr, CASE WHEN len(list_distinct(seen || [a, b])) <= 5 THEN list_distinct(seen || [a, b]) ELSE seen END, CASE WHEN len(list_distinct(seen || [a, b])) <= 5 THEN taken || [place] ELSE taken END FROM w JOIN p ON p.site = w.site AND p.nr = w.nr + 1)
SELECT site, unnest(arg_max(taken, nr)) AS place FROM w GROUP BY site""")
def budgeted_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O04"""
    k = F.col("n_nationkey")
    p = t(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("site"), k.alias("place"), F.concat(F.lit("k"), (k % 7).cast("string")).alias("a"), F.concat(F.lit("k"), (k % 5).cast("string")).alias("b"))
    return topics.within_budget(p, limit=5).select("site", "place")


@query("""WITH RECURSIVE c AS (SELECT n_regionkey AS run, n_nationkey // 5 AS rank, n_nationkey AS place, 'q' || (n_nationkey % 4) AS review FROM nation), g AS (SELECT run, rank, list(review ORDER BY place) AS all_of, dense_rank() OVER (PARTITION BY run ORDER BY rank) AS nr FROM c GROUP BY run, rank),
w AS (SELECT run, 0::BIGINT AS nr, -1::BIGINT AS rank, []::VARCHAR[] AS used, []::VARCHAR[] AS picks FROM (SELECT DISTINCT run FROM c)
UNION ALL SELECT w.run, g.nr, g.rank, used || CASE WHEN len(list_filter(all_of, lambda r: NOT list_contains(used, r))) > 0 THEN list_filter(all_of, lambda r: NOT list_contains(used, r))[:3] ELSE all_of[:1] END, CASE WHEN len(list_filter(all_of, lambda r: NOT list_contains(used, r))) > 0 THEN list_filter(all_of, lambda r: NOT list_contains(used, r))[:3] ELSE all_of[:1] END FROM w JOIN g ON g.run = w.run AND g.nr = w.nr + 1)
SELECT run, rank, unnest(picks) AS review FROM w WHERE nr > 0""")
def quote_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W17"""
    k = F.col("n_nationkey")
    c = t(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("run"), F.floor(k / 5).cast("int").alias("rank"), k.alias("place"), F.concat(F.lit("q"), (k % 4).cast("string")).alias("review"))
    return voice.assigned_quotes(c).select("run", "rank", "review")
