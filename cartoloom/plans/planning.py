"""Queries of the content plan: walls, edges, clusters, topics, pages.

Parts stand in for keywords (name and type as the words, size as demand), their names for clusters and pages, and pairs
of near parts of one type for judged edges; every rule meets rows on both of its sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoloom.operators import clusters, keywords, topics
from cartoloom.plans.registry import query, t

_KW = """
kw AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_type) AS keyword, list_sort(list_distinct(string_split(lower(p_name || ' ' || p_type), ' '))) AS tokens, p_size AS demand, (p_partkey % 7)::INTEGER AS clicks,
  CASE WHEN p_partkey % 5 <> 0 THEN '/' || p_name END AS url, CASE p_brand WHEN 'Brand#1' THEN 'own-brand' WHEN 'Brand#2' THEN 'branded' ELSE 'generic' END AS partition,
  CASE WHEN p_partkey % 9 = 0 THEN 'perth' ELSE '' END AS local, CASE p_partkey % 4 WHEN 1 THEN 'commercial' WHEN 2 THEN 'mixed' ELSE 'informational' END AS intent,
  CASE WHEN p_brand <> 'Brand#1' AND p_partkey % 10 <> 0 THEN p_name END AS cluster, split_part(p_name, ' ', 2) AS topic FROM part),
edges AS (SELECT a.p_partkey AS a, b.p_partkey AS b, ((a.p_partkey * 7 + b.p_partkey * 13) % 101) / 100.0::DOUBLE AS p_same, ((a.p_partkey + b.p_partkey) % 50) / 100.0::DOUBLE AS p_related,
  ((a.p_partkey * 3 + b.p_partkey) % 90) / 100.0::DOUBLE AS p_different, CASE (a.p_partkey + b.p_partkey) % 3 WHEN 0 THEN 'verify' ELSE 'judged' END AS method
  FROM part a JOIN part b ON a.p_type = b.p_type AND b.p_partkey BETWEEN a.p_partkey + 1 AND a.p_partkey + 40),
both_ways AS (SELECT * FROM edges UNION ALL SELECT b AS a, a AS b, p_same, p_related, p_different, method FROM edges),
heads AS (SELECT cluster, arg_min(id, (-demand, -clicks, keyword, id)) AS head, sum(demand)::BIGINT AS demand, count(*) AS n FROM kw WHERE cluster IS NOT NULL GROUP BY cluster)"""
_WALL = "a.partition = b.partition AND a.local = b.local AND a.partition <> 'own-brand' AND (a.intent = b.intent OR 'mixed' IN (a.intent, b.intent))"


def _keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("p_partkey"), F.lower(F.concat_ws(" ", "p_name", "p_type"))
    return t(spark, sf_dir, "part").select(
        k.alias("id"), text.alias("keyword"), F.array_sort(F.array_distinct(F.split(text, " "))).alias("tokens"), F.col("p_size").alias("demand"), (k % 7).cast("int").alias("clicks"),
        F.when(k % 5 != 0, F.concat(F.lit("/"), "p_name")).alias("url"), F.when(F.col("p_brand") == "Brand#1", "own-brand").when(F.col("p_brand") == "Brand#2", "branded").otherwise("generic").alias("partition"),
        F.when(k % 9 == 0, "perth").otherwise("").alias("local"), F.when(k % 4 == 1, "commercial").when(k % 4 == 2, "mixed").otherwise("informational").alias("intent"),
        F.when((F.col("p_brand") != "Brand#1") & (k % 10 != 0), F.col("p_name")).alias("cluster"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("topic"),
    )


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keywords(spark, sf_dir).where("cluster is not null")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part")
    a, b = F.col("a"), F.col("b")
    # near numbers meet by ranges of forty: a range meets itself and the next one; the rows are few bytes and make many
    # pairs, so the number of tasks is fixed: by what they read tasks would be put together
    tasks = 8 * spark.sparkContext.defaultParallelism
    own = p.select(F.col("p_partkey").alias("a"), "p_type", F.floor(F.col("p_partkey") / 40).alias("range"))
    other = p.select(F.col("p_partkey").alias("b"), "p_type", F.explode(F.array(F.floor(F.col("p_partkey") / 40), F.floor(F.col("p_partkey") / 40) - 1)).alias("range"))
    near = own.repartition(tasks, "p_type", "range").join(other.repartition(tasks, "p_type", "range").hint("shuffle_hash"), ["p_type", "range"]).where(b.between(a + 1, a + 40))
    return near.select("a", "b", ((a * 7 + b * 13) % 101 / 100).alias("p_same"), ((a + b) % 50 / 100).alias("p_related"), ((a * 3 + b) % 90 / 100).alias("p_different"), F.when((a + b) % 3 == 0, "verify").otherwise("judged").alias("method"))


@query("""
WITH k AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_type) AS n, p_brand = 'Brand#2' AS branded, p_partkey FROM part),
h AS (SELECT lower(p_name || '.com') AS host FROM part), s AS (SELECT arg_min(replace(split_part(host, '.', 1), ' ', ''), (-c, host)) AS site FROM (SELECT host, count(*) AS c FROM h GROUP BY host))
SELECT id, CASE WHEN n LIKE '%promo' OR contains(' ' || n || ' ', ' red ') OR (length(site) >= 4 AND contains(replace(n, ' ', ''), site)) THEN 'own-brand' WHEN branded THEN 'branded' ELSE 'generic' END AS partition,
CASE WHEN contains(' ' || n || ' ', ' small ring ') THEN 'small ring' || CASE WHEN contains(' ' || n || ' ', ' economy ') THEN '' ELSE '' END
  WHEN contains(' ' || n || ' ', ' ring ') THEN 'ring' WHEN contains(' ' || n || ' ', ' economy ') THEN 'near me' WHEN p_partkey % 6 = 0 THEN 'local (no place)' ELSE '' END AS local,
CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 THEN 'navigational' WHEN p_partkey % 3 = 0 AND p_partkey % 5 <> 0 THEN 'informational' WHEN p_partkey % 5 = 0 AND p_partkey % 3 <> 0 THEN 'commercial' WHEN n LIKE '%standard' THEN 'informational' ELSE 'mixed' END AS intent
FROM k, s""")
def keyword_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition, place and intent"""
    k, n = F.col("p_partkey"), F.col("n")
    rows = t(spark, sf_dir, "part").withColumn("n", F.lower(F.concat_ws(" ", "p_name", "p_type"))).withColumn("host", F.lower(F.concat("p_name", F.lit(".com"))))
    rows = rows.crossJoin(F.broadcast(topics.site_host(rows, "host")))
    intent = topics.flagged_intent(k % 2 == 0, k % 3 == 0, k % 5 == 0, F.when(topics.has_phrase(n, F.lit("standard")), "informational"))
    return rows.select(k.alias("id"), topics.partition(n, F.col("p_brand") == "Brand#2", ["red", "promo"], F.col("site")).alias("partition"), topics.local_wall(n, k % 6 == 0, ["ring", "small ring"], ["economy"]).alias("local"), intent.alias("intent"))


@query(f"WITH {_KW} SELECT a.id AS a, b.id AS b, 1.0::DOUBLE AS p_same, 'lexical' AS method FROM kw a JOIN kw b ON a.tokens = b.tokens AND a.id < b.id WHERE {_WALL}")
def identical_token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J04, J07, P08"""
    return topics.identical_tokens(_keywords(spark, sf_dir))


@query(f"""WITH {_KW} SELECT a.id AS a, b.id AS b, 1.0::DOUBLE AS p_same, 'url' AS method FROM kw a JOIN kw b ON a.url = b.url AND a.id < b.id
WHERE {_WALL} AND len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(a.tokens || b.tokens)) >= 0.75""")
def same_url_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J06"""
    return topics.same_url(_keywords(spark, sf_dir), least=0.75)


@query(f"""WITH {_KW}, picks AS (SELECT a AS anchor, b AS other, method AS source, p_same AS score FROM both_ways UNION ALL SELECT a, b, 'url', p_related FROM both_ways WHERE p_related >= 0.3),
best AS (SELECT *, row_number() OVER (PARTITION BY anchor, source ORDER BY score DESC, other) AS rn FROM picks),
named AS (SELECT anchor, other, list_sort(list(DISTINCT source)) AS s, max(score) AS score FROM best WHERE rn <= CASE source WHEN 'judged' THEN 5 WHEN 'verify' THEN 3 ELSE 2 END GROUP BY anchor, other)
SELECT anchor, other, array_to_string(s, '+') AS sources FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY len(s) DESC, score DESC, other) AS rn FROM named) WHERE rn <= 6""")
def capped_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W04"""
    e = topics.both_ways(_edges(spark, sf_dir))
    picks = e.select(F.col("a").alias("anchor"), F.col("b").alias("other"), F.col("method").alias("source"), F.col("p_same").alias("score"))
    picks = picks.unionByName(e.where("p_related >= 0.3").select(F.col("a").alias("anchor"), F.col("b").alias("other"), F.lit("url").alias("source"), F.col("p_related").alias("score")))
    return topics.capped_union(picks, per_source={"judged": 5, "verify": 3, "url": 2}, most=6).withColumn("sources", F.array_join("sources", "+"))


@query(f"""WITH {_KW}, lex AS (SELECT DISTINCT a, b FROM edges WHERE (a + b) % 11 = 0), serp AS (SELECT a, b, CASE (a + b) % 4 WHEN 0 THEN 'merge' WHEN 1 THEN 'split' ELSE 'keep' END AS decision FROM edges WHERE (a * b) % 5 = 0 UNION ALL SELECT -1, a, 'merge' FROM edges WHERE a % 50 = 0),
f AS (SELECT e.a, e.b, CASE WHEN l.a IS NULL THEN e.p_same ELSE 1.0 END AS p_same, CASE WHEN l.a IS NULL THEN e.p_related ELSE 0.0 END AS p_related, CASE WHEN l.a IS NULL THEN e.p_different ELSE 0.0 END AS p_different, CASE WHEN l.a IS NULL THEN e.method ELSE 'lexical' END AS method FROM edges e LEFT JOIN lex l USING (a, b))
SELECT f.a, f.b, CASE decision WHEN 'merge' THEN 1.0 WHEN 'split' THEN 0.0 ELSE p_same END::DOUBLE AS p_same, CASE decision WHEN 'merge' THEN 0.0 WHEN 'split' THEN 1.0 ELSE p_related END::DOUBLE AS p_related, CASE WHEN decision IS NULL THEN p_different ELSE 0.0 END::DOUBLE AS p_different, CASE WHEN decision IS NULL THEN method ELSE 'serp' END AS method
FROM f LEFT JOIN (SELECT * FROM serp WHERE decision <> 'keep') s ON f.a = s.a AND f.b = s.b""")
def edge_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D06, G11"""
    e = _edges(spark, sf_dir)
    s, p = F.col("a") + F.col("b"), F.col("a") * F.col("b")
    serp = e.where(p % 5 == 0).select("a", "b", F.when(s % 4 == 0, "merge").when(s % 4 == 1, "split").otherwise("keep").alias("decision"))
    serp = serp.unionByName(e.where(F.col("a") % 50 == 0).select(F.lit(-1).cast("long").alias("a"), F.col("a").alias("b"), F.lit("merge").alias("decision")))
    return topics.effective_edges(e.where(s % 11 == 0).select("a", "b"), e, serp)


@query(f"WITH {_KW} SELECT * FROM heads")
def cluster_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W05"""
    return topics.heads(_clustered(spark, sf_dir))


@query(f"""WITH {_KW}, near AS (SELECT a AS head, b AS id, p_same, p_different, p_same >= 0.5 AND p_different < 0.5 AS fine FROM both_ways),
out AS (SELECT k.id, k.cluster, k.partition, k.local, k.intent, n.p_same FROM kw k JOIN heads h USING (cluster) JOIN near n ON n.head = h.head AND n.id = k.id WHERE k.id <> h.head AND NOT fine),
kinds AS (SELECT cluster, min(partition) AS partition, min(local) AS local, list(DISTINCT intent) AS intents FROM kw WHERE cluster IS NOT NULL GROUP BY cluster),
best AS (SELECT o.id, arg_min(h.cluster, (-n.p_same, h.cluster)) AS new_cluster FROM out o JOIN near n ON n.id = o.id AND n.fine JOIN heads h ON h.head = n.head AND h.cluster <> o.cluster JOIN kinds k ON k.cluster = h.cluster
  WHERE k.partition = o.partition AND k.local = o.local AND o.partition <> 'own-brand' AND len(list_filter(list_distinct(list_append(k.intents, o.intent)), lambda i: i <> 'mixed')) <= 1 GROUP BY o.id)
SELECT id, cluster, p_same::DOUBLE AS p_same_with_head, new_cluster FROM out LEFT JOIN best USING (id)""")
def evicted_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G07, J20, P08's group form"""
    return topics.evict(_clustered(spark, sf_dir), _edges(spark, sf_dir))


def _head_merges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") * F.col("b") % 17 == 0).select("a", "b")


@query()
def formed_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linkage within walls, head merges, eviction, the floor of single keywords and the names, over all parts"""
    e = _edges(spark, sf_dir)
    return clusters.form_clusters(_keywords(spark, sf_dir), e, _head_merges(e), least_single=10)


@query(f"""WITH {_KW} SELECT least(x.cluster, y.cluster) AS a, greatest(x.cluster, y.cluster) AS b, round(sum(p_related + p_same), 6) AS total, count(*) AS n
FROM edges JOIN kw x ON x.id = a JOIN kw y ON y.id = b WHERE x.cluster <> y.cluster GROUP BY ALL""")
def cluster_link_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links that topics are formed from"""
    return topics.cluster_links(_clustered(spark, sf_dir), _edges(spark, sf_dir)).withColumn("total", F.round("total", 6))


@query(f"""WITH {_KW}, c AS (SELECT h.*, split_part(cluster, ' ', 2) AS topic, CASE WHEN n % 3 = 0 THEN 'Lost' WHEN n % 3 = 1 THEN 'Owned' ELSE 'Gap-in-list' END AS status FROM heads h)
SELECT topic, count(*) AS n_clusters, sum(n)::BIGINT AS n_keywords, sum(demand)::BIGINT AS demand, round(sum(CASE WHEN status = 'Owned' THEN 1 ELSE 0 END) / count(*), 3) AS coverage FROM c GROUP BY topic""")
def topic_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A05, J03"""
    return topics.topic_rollup(_heads(spark, sf_dir).withColumn("status", F.when(F.col("n") % 3 == 0, "Lost").when(F.col("n") % 3 == 1, "Owned").otherwise("Gap-in-list")))


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.heads(_clustered(spark, sf_dir)).withColumn("topic", F.split_part("cluster", F.lit(" "), F.lit(2)))


@query(f"""WITH {_KW} SELECT url, count(DISTINCT cluster) AS n_clusters, count(*) AS n_keywords, sum(demand)::BIGINT AS demand, sum(clicks)::BIGINT AS clicks, coalesce(string_agg(DISTINCT cluster, ' | ' ORDER BY cluster), '') AS clusters, url = '/promo' AS is_home, url = '/promo' AND count(DISTINCT cluster) >= 3 AS overloaded
FROM (SELECT CASE WHEN url IS NOT NULL THEN '/' || split_part(keyword, ' ', 3) END AS url, cluster, demand, clicks FROM kw WHERE partition <> 'own-brand') WHERE url IS NOT NULL GROUP BY url""")
def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A06"""
    rows = _keywords(spark, sf_dir).withColumn("url", F.when(F.col("url").isNotNull(), F.concat(F.lit("/"), F.split_part("keyword", F.lit(" "), F.lit(3)))))
    return topics.page_rollup(rows, home=F.col("url") == "/promo")


@query(f"""WITH {_KW}, inside AS (SELECT e.a AS id, round(avg(p_same), 3) AS confidence, arg_max(method, (p_same, method)) AS method FROM both_ways e JOIN kw x ON x.id = e.a JOIN kw y ON y.id = e.b AND x.cluster = y.cluster GROUP BY e.a),
s AS (SELECT cluster, count(*) AS size FROM kw GROUP BY cluster), m AS (SELECT kw.id, kw.cluster, CASE WHEN partition = 'own-brand' THEN 'own-brand' WHEN kw.cluster IS NULL THEN 'unclustered' WHEN size = 1 THEN 'singleton' ELSE coalesce(i.method, 'linkage') END AS method, confidence FROM kw LEFT JOIN s USING (cluster) LEFT JOIN inside i ON i.id = kw.id)
SELECT id, cluster, method, CASE WHEN method NOT IN ('own-brand', 'unclustered', 'singleton') THEN confidence END AS confidence FROM m""")
def keyword_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A08, J03, J20"""
    return topics.member_confidence(_keywords(spark, sf_dir), _edges(spark, sf_dir))


@query(f"""WITH {_KW} SELECT kw.id, arg_max(b, (p_same, -b)) AS best, max(p_same)::DOUBLE AS p_same FROM kw LEFT JOIN both_ways e ON e.a = kw.id WHERE cluster IS NULL GROUP BY kw.id""")
def loose_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A09"""
    return topics.best_candidates(_keywords(spark, sf_dir).where("cluster is null"), _edges(spark, sf_dir))


@query(f"""WITH {_KW}, c AS (SELECT *, n % 2 = 0 AS on_home, CASE WHEN n % 3 = 0 THEN 'Cannibalised' WHEN n % 3 = 1 THEN 'Owned' ELSE 'Striking' END AS status, head % 2 = 0 AS nav FROM heads),
r AS (SELECT cluster, CASE WHEN row_number() OVER (ORDER BY demand DESC, cluster) = 1 THEN 'core' ELSE 'extra' END AS role FROM c WHERE on_home)
SELECT c.cluster, role, CASE WHEN role = 'core' AND status <> 'Cannibalised' THEN 'Keep on the home page: it is the site''s core cluster. Move the other clusters the home page carries to their own pages.'
  WHEN role = 'extra' AND NOT nav THEN 'Create a dedicated page: the home page is carrying this cluster.' WHEN status = 'Owned' THEN 'Hold' WHEN status = 'Striking' THEN 'Improve' ELSE 'Consolidate' END AS action FROM c LEFT JOIN r USING (cluster)""")
def cluster_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W07, M02"""
    c = _heads(spark, sf_dir).withColumn("on_home", F.col("n") % 2 == 0).withColumn("status", F.when(F.col("n") % 3 == 0, "Cannibalised").when(F.col("n") % 3 == 1, "Owned").otherwise("Striking"))
    rows = c.join(topics.home_roles(c), "cluster", "left")
    return rows.select("cluster", "role", topics.action(F.col("status"), F.coalesce("role", F.lit("")), F.col("head") % 2 == 0, {"Owned": "Hold", "Striking": "Improve", "Cannibalised": "Consolidate"}).alias("action"))


@query(f"""WITH {_KW}, r AS (SELECT l_orderkey AS id, 'u' || (l_partkey % 200) AS url, 's' || (l_partkey % 17) || '.com' AS host FROM lineitem), u AS (SELECT DISTINCT id, url FROM r WHERE host <> 's3.com'),
k AS (SELECT DISTINCT id, ['w' || (id % 1201), 'v' || (id % 3001)] AS tokens FROM r), peers AS (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.id < b.id AND list_has_any(a.tokens, b.tokens)),
p AS (SELECT a, b, count(y.url) AS shared FROM peers LEFT JOIN u x ON x.id = a LEFT JOIN u y ON y.id = b AND y.url = x.url GROUP BY a, b),
s AS (SELECT id FROM (SELECT a AS id, shared FROM p UNION ALL SELECT b, shared FROM p) GROUP BY id HAVING max(shared) = 0)
SELECT a, b, shared, a IN (FROM s) OR b IN (FROM s) AS suspect, CASE WHEN a IN (FROM s) OR b IN (FROM s) THEN 'keep' WHEN shared >= 2 THEN 'merge' WHEN shared < 1 THEN 'split' ELSE 'keep' END AS decision FROM p""")
def serp_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S26's use, J18, G11"""
    part = F.col("l_partkey")
    r = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("u"), (part % 200).cast("string")).alias("url"), F.concat(F.lit("s"), (part % 17).cast("string"), F.lit(".com")).alias("host"))
    k = r.select("id").distinct().select("id", F.array(F.concat(F.lit("w"), (F.col("id") % 1201).cast("string")), F.concat(F.lit("v"), (F.col("id") % 3001).cast("string"))).alias("tokens"))
    return topics.serp_overlaps(r, k, platforms=["s3.com"], merge=2, split=1)


@query(f"""WITH {_KW} SELECT a, b, x.demand + y.demand AS demand FROM edges JOIN kw x ON x.id = a JOIN kw y ON y.id = b WHERE method = 'judged' AND p_same BETWEEN 0.35 AND 0.65 ORDER BY demand DESC, a, b LIMIT 50""")
def uncertain_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O01, O06"""
    return topics.search_plan(_edges(spark, sf_dir), _keywords(spark, sf_dir)).orderBy(F.desc("demand"), "a", "b").limit(50)


@query(f"""WITH {_KW}, ts AS (SELECT split_part(cluster, ' ', 2) AS topic, sum(demand) AS td FROM heads GROUP BY 1), m AS (SELECT kw.id, kw.keyword, kw.demand, kw.cluster, CASE WHEN partition = 'own-brand' THEN 2 WHEN kw.cluster IS NULL THEN 1 ELSE 0 END AS part, h.head, h.demand AS cd, ts.topic, ts.td FROM kw LEFT JOIN heads h USING (cluster) LEFT JOIN ts ON ts.topic = split_part(h.cluster, ' ', 2))
SELECT coalesce(topic, '') AS topic, CASE part WHEN 2 THEN 'Branded' WHEN 1 THEN 'Unclustered' ELSE cluster END AS cluster, id, keyword, demand, row_number() OVER (ORDER BY part, td DESC, topic, cd DESC, cluster, id <> head, demand DESC, keyword, id) AS place FROM m""")
def keywords_by_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O09"""
    c = _heads(spark, sf_dir)
    return topics.by_cluster(_keywords(spark, sf_dir), c, c.groupBy("topic").agg(F.sum("demand").alias("demand")))


@query(f"""WITH {_KW}, c AS (SELECT *, n AS links, split_part(cluster, ' ', 2) AS topic FROM heads), s AS (SELECT *, round(0.6 * demand / max(demand) OVER (PARTITION BY topic) + 0.4 * links / max(links) OVER (PARTITION BY topic), 6) AS pillar_score FROM c)
SELECT topic, cluster, pillar_score, 'C' || lpad(row_number() OVER (ORDER BY pillar_score DESC, cluster)::VARCHAR, 3, '0') AS id FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY pillar_score DESC, demand DESC, cluster) AS rn FROM s) WHERE rn = 1""")
def topic_pillars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W06, W08"""
    best = keywords.pillars(_heads(spark, sf_dir).withColumn("links", F.col("n")), topic="topic")
    return clusters.named(best, [F.desc("pillar_score"), F.col("cluster")], "C", name="id").select("topic", "cluster", "pillar_score", "id")
