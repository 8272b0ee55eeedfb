"""Queries that write files with the sinks, read them again with the sources, and return what came back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartoloom.operators import clusters, keywords, reviews, topics
from cartoloom.plans import planning
from cartoloom.plans.registry import query, t
from cartoloom.sources import calls, files, paged, reports
from cartoloom.sources.scratch import scratch


@query("""SELECT s_suppkey::VARCHAR AS k, s_name || CASE WHEN s_suppkey % 3 = 0 THEN ', "x"' ELSE '' END AS name, 'a; ' || s_nationkey AS tags FROM supplier""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S02, S05, K01, K18"""
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.concat("s_name", F.when(F.col("s_suppkey") % 3 == 0, ', "x"').otherwise("")).alias("name"), F.array(F.lit("a"), F.col("s_nationkey").cast("string")).alias("tags"))
    path = scratch(spark, "csv")
    s.select("k", "name", F.array_join("tags", "; ").alias("tags")).write.options(header=True, quote='"', escape='"').csv(path)
    return files.read_table(spark, path)


@query("""SELECT DISTINCT lower(p_name) || ' ' || lower(p_type) AS norm, upper(left(p_brand, 2)) AS country, p_size * 1000.0::DOUBLE AS volume, CASE WHEN p_partkey % 4 > 0 THEN (p_partkey % 30)::DOUBLE END AS position, 'k' || left(sha256(lower(p_name) || ' ' || lower(p_type)), 10) AS id, p_partkey % 2 = 0 AS branded FROM part WHERE p_partkey % 7 > 0""")
def keyword_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A UTF-16 export with tabs, its kind found by its header"""
    k = F.col("p_partkey")
    blank = F.lit("").alias
    raw = t(spark, sf_dir, "part").select(
        F.concat(F.when(k % 7 == 0, "site:").otherwise(""), "p_name", F.lit(" "), "p_type").alias("Keyword"), F.upper(F.left("p_brand", F.lit(2))).alias("Country"), F.concat(F.col("p_size").cast("string"), F.lit(",000")).alias("Volume"), blank("KD"), blank("CPC"),
        F.when(k % 4 > 0, (k % 30).cast("string")).otherwise("n/a").alias("Current position"), blank("Current organic traffic"), blank("Current URL"), blank("Previous URL"),
        F.when(k % 2 == 0, "TRUE").otherwise("false").alias("Branded"), *[blank(c) for c in ("Local", "Navigational", "Informational", "Commercial", "Transactional")],
    )
    path = scratch(spark, "export")
    raw.coalesce(1).write.options(header=True, sep="\t", encoding="UTF-16LE").csv(path)
    table = files.read_table(spark, path)
    if files.detect_export(table) != "a":
        raise ValueError("not an export with volumes")
    rows = keywords.read_export_a(table)
    return rows.select("norm", "country", "volume", "position", "id", F.col("flags")["branded"].alias("branded")).distinct()


@query("""SELECT 'https://a.org/' || page_id AS address, CASE WHEN page_id % 3 > 0 THEN 1 ELSE 0 END + CASE WHEN page_id % 2 > 0 THEN 1 ELSE 0 END AS blocks, CASE WHEN page_id % 5 = 0 THEN 'status' WHEN page_id % 7 = 0 THEN 'content type' WHEN page_id % 11 = 0 THEN 'not indexable' END AS skip_reason FROM pages""")
def crawl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S04, S06"""
    k = F.col("page_id")
    raw = t(spark, sf_dir, "pages").select(F.concat(F.lit("https://a.org/"), k.cast("string")).alias("Address"), F.when(k % 5 == 0, "404").otherwise("200").alias("Status Code"), F.when(k % 7 == 0, "image/png").otherwise("text/HTML; charset=utf-8").alias("Content Type"), F.when(k % 11 == 0, "Non-Indexable").otherwise("Indexable").alias("Indexability"), F.when(k % 3 > 0, '{"a": 1}').alias("JSON-LD 1"), F.when(k % 2 > 0, "{}").alias("JSON-LD 2"))
    path = scratch(spark, "crawl")
    raw.write.options(header=True, quote='"', escape='"').csv(path)
    return files.read_crawl(spark, path).select(F.col("Address").alias("address"), F.size("blocks").alias("blocks"), "skip_reason")


@query("""SELECT event_id, event_type, CASE WHEN event_id % 5 > 0 THEN value END AS value FROM events""")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S09, K03"""
    e = t(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_id") % 5 > 0, F.col("value")).alias("value"))
    path = scratch(spark, "lines")
    reports.write_jsonl(e, path)
    return files.read_jsonl(spark, path, "event_id long, event_type string, value double")


@query("""SELECT 'kind' || (page_id % 4) AS kind, 'p' || page_id AS name, CASE WHEN page_id % 3 = 0 THEN '[]' ELSE '["b' || page_id || '"]' END AS value FROM pages""")
def blocks_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K06"""
    k = F.col("page_id")
    c = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    p = t(spark, sf_dir, "pages").select(c("kind", k % 4).alias("kind"), c("p", k).alias("name"), F.when(k % 3 > 0, F.array(c("b", k))).alias("blocks"))
    path = scratch(spark, "blocks")
    reports.write_by_file(p, path, group="kind", name="name", blocks="blocks")
    return reports.read_by_file(spark, path, group="kind", name="name")


@query("""SELECT n_name AS value FROM nation WHERE n_nationkey % 3 > 0""")
def list_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list without its blank lines and comments"""
    n = F.col("n_nationkey") % 6
    path = scratch(spark, "list")
    t(spark, sf_dir, "nation").select(F.when(n == 0, "  ").when(n == 3, F.concat(F.lit("# "), "n_name")).otherwise(F.concat(F.lit("  "), "n_name")).alias("value")).write.text(path)
    return files.read_list(spark, path)


@query("""WITH p AS (SELECT 'https://a.org/x' || (page_id % 60) || CASE WHEN page_id % 3 = 0 THEN '?q=' || page_id ELSE '' END AS url, 'x' || (page_id % 60) AS file FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY contains(url, '?'), length(url), url) AS rn FROM (SELECT DISTINCT * FROM p)) SELECT url, file, rn > 1 AS dropped FROM r""")
def file_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K07, K08"""
    k = F.col("page_id")
    p = t(spark, sf_dir, "pages").select(F.concat(F.lit("https://a.org/x"), (k % 60).cast("string"), F.when(k % 3 == 0, F.concat(F.lit("?q="), k.cast("string"))).otherwise("")).alias("url"), F.concat(F.lit("x"), (k % 60).cast("string")).alias("file")).distinct()
    return files.file_targets(p, url="url", file="file").select("url", "file", F.coalesce(F.col("dropped").cast("boolean"), F.lit(False)).alias("dropped"))


@query("""SELECT c_custkey AS q, c_name AS a, CASE WHEN c_custkey % 4 = 0 AND c_custkey < 900 THEN 'ok ' || c_custkey END AS verdict FROM customer""")
def kept_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K15"""
    k = F.col("c_custkey")
    fresh = t(spark, sf_dir, "customer").select(k.alias("q"), F.col("c_name").alias("a"), F.lit(None).cast("string").alias("verdict"))
    old = t(spark, sf_dir, "customer").where("c_custkey < 900").select(k.alias("q"), F.lit("old").alias("a"), F.when(k % 4 == 0, F.concat(F.lit("ok "), k.cast("string"))).otherwise(" ").alias("verdict"))
    return reports.keep_client_columns(fresh, old, keys=["q"], columns=["verdict"])


@query("""SELECT n_name AS skill, CASE WHEN n_name = 'NATION_3' THEN 'done' ELSE 'open' END AS status, n_name = 'NATION_3' AS done, CASE WHEN n_name = 'NATION_3' THEN '2026-01-02' END AS date FROM nation""")
def ticked_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K16"""
    c = t(spark, sf_dir, "nation").select(F.col("n_name").alias("skill"), F.lit("open").alias("status"), F.lit(False).alias("done"), F.lit(None).cast("string").alias("date"))
    return reports.ticked(c, "NATION_3", date="2026-01-02")


@query("""WITH r AS (SELECT DISTINCT 'judge ' || user_id AS payload FROM events) SELECT payload, sha256(payload) AS key FROM r WHERE substr(payload, 7)::BIGINT % 3 > 0""")
def uncached_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that no cached answer has"""
    asked = t(spark, sf_dir, "events").select("user_id", F.concat(F.lit("judge "), F.col("user_id").cast("string")).alias("payload"))
    cache = asked.where("user_id % 3 = 0").select(F.sha2("payload", 256).alias("key"))
    return calls.missing_answers(asked, cache).select("payload", "key")


@query("""SELECT user_id, 'A' || user_id AS answer, user_id / 4.0 AS cost, CASE WHEN user_id % 5 = 0 THEN 'slow' END AS error FROM (SELECT DISTINCT user_id FROM events)""")
def answer_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three shapes of an answer as one"""
    k = F.col("user_id")
    said, cost = F.concat(F.lit("A"), k.cast("string")), k / 4
    error = F.when(k % 5 == 0, F.lit("slow"))
    a = F.to_json(F.struct(said.alias("answer"), cost.alias("cost"), error.alias("error")))
    b = F.to_json(F.struct(said.alias("output_text"), F.struct(cost.alias("cost")).alias("usage"), F.when(error.isNotNull(), F.struct(error.alias("message"))).alias("error")))
    c = F.to_json(F.struct(F.array(F.struct(F.struct(said.alias("content")).alias("message"))).alias("choices"), cost.alias("price"), error.alias("error")))
    raw = t(spark, sf_dir, "events").select("user_id").distinct().select("user_id", F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise(c).alias("body"))
    return calls.normalised_answers(raw).select("user_id", "answer", "cost", "error")


@query("""WITH e AS (SELECT user_id AS key, event_id % 40 AS rank, 'u' || (event_id % 90) AS url FROM events) SELECT key, url, min(rank)::INTEGER AS rank FROM e GROUP BY ALL HAVING min(rank) <= 10""")
def organic_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S26"""
    item = F.struct((F.col("event_id") % 40).cast("int").alias("rank"), F.concat(F.lit("u"), (F.col("event_id") % 90).cast("string")).alias("url"))
    r = t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.to_json(F.struct(F.collect_list(item).alias("organic"))).alias("body"))
    return calls.organic(r, key="key").select("key", "url", "rank")


@query("""SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY source, lang, left(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), 200) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def merged_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S12, S13, D01"""
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("platform"), F.col("lang").alias("author_hash"), "text")
    kept, _ = reviews.append_merge(d.where("id < 500"), d.where("id >= 300"), order="id")
    return kept.select(F.col("id").alias("doc_id"), F.col("author_hash").alias("lang"), F.col("platform").alias("source"))


@query()
def formed_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G09"""
    members = planning._clustered(spark, sf_dir)
    c = topics.heads(members).withColumn("name", F.col("cluster"))
    return clusters.form_topics(c, topics.cluster_links(members, planning._edges(spark, sf_dir)), threshold=0.75, coverage=0.01)


@query("""SELECT user_id::VARCHAR AS dataset, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, event_id, event_type, value FROM events""")
def paged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as saved pages of seven items that overlap by two, read back as rows"""
    item = F.struct("event_id", "event_type", "value")
    rows = t(spark, sf_dir, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("rn"), item.alias("item")).withColumn("n", F.col("rn") - 1)
    total = Window.partitionBy("user_id")
    # an item is on the page where it starts a stride of five, and on the one before if it is among its first two
    on = F.explode(F.filter(F.array(F.floor(F.col("n") / 5), F.when((F.col("n") % 5 < 2) & (F.col("n") >= 5), F.floor(F.col("n") / 5) - 1)), lambda x: x.isNotNull()))
    placed = rows.withColumn("total", F.count("*").over(total)).withColumn("page", on)
    saved = placed.groupBy("user_id", "page").agg(F.first("total").alias("total"), F.array_sort(F.collect_list(F.struct("n", "item"))).alias("x"))
    body = F.to_json(F.struct(F.col("user_id").cast("string").alias("dataset"), (F.col("page") * 5).alias("offset"), "total", F.col("x.item").alias("items")))
    folder = scratch(spark, "pages")
    saved.select(body.alias("body")).write.text(folder)
    pages = spark.read.text(folder).withColumnRenamed("value", "body")
    return paged.page_rows(pages, "event_id long, event_type string, value double").select("dataset", "n", "event_id", "event_type", "value")
