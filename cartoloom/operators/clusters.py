"""From judged pairs to named clusters and topics, as whole commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartoloom.operators import topics
from cartoloom.operators.graph import linkage, ordered_union, settled


def numbered(rows: DataFrame, order: list[Column], *, name: str = "place") -> DataFrame:
    """Rows with their place in an order, from 1.

    Sorted by ranges: every range is numbered by itself and starts after the rows of those before it, so no task sees
    all rows.  Of the ranges only the counts meet.
    """
    at = settled(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = at.groupBy("_range").agg(F.count("*").alias("rows"))
    before = counts.select("_range", F.coalesce(F.sum("rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # one row for each range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return at.join(F.broadcast(before), "_range").withColumn(name, F.col("_start") + own).drop("_range", "_start")


def named(rows: DataFrame, order: list[Column], prefix: str, *, name: str) -> DataFrame:
    """Rows with an id: a letter and the place, padded to the width of the last one, three at least."""
    placed = settled(numbered(rows, order, name="_place"))
    width = max(3, len(str(placed.count())))
    return placed.withColumn(name, F.concat(F.lit(prefix), F.lpad(F.col("_place").cast("string"), width, "0"))).drop("_place")


def _walls(members: DataFrame) -> DataFrame:
    """``node, wall, kinds`` of keywords: partition and place, and the intent where it isn't mixed."""
    kinds = F.when(F.coalesce("intent", F.lit("mixed")) == "mixed", F.array().cast("array<string>")).otherwise(F.array("intent"))
    return members.select(F.col("id").alias("node"), F.concat_ws("|", F.coalesce("partition", F.lit("")), F.coalesce("local", F.lit(""))).alias("wall"), kinds.alias("kinds"))


def form_clusters(keywords: DataFrame, edges: DataFrame, head_merges: DataFrame, *, merge: float = 0.5, different: float = 0.5, coverage: float = 0.5, least_single: float = 0.0) -> DataFrame:
    """``id, cluster, head, demand, name, evicted``: every keyword that is no own brand, its cluster or null.

    keywords: id, keyword, demand, clicks, partition, local, intent; edges: a, b, p_same, p_different (each pair once,
    see :func:`cartoloom.operators.topics.effective_edges`); head_merges: a, b of searches that belong together.

    Linkage within walls; then pairs of head_merges in order, where the walls of their groups still fit; then members
    whose head judged them apart leave, for the best cluster whose head judged them the same, else for none; then single
    keywords below ``least_single`` are no cluster.  Clusters are named C001 on by falling demand, then by their head.
    """
    own = settled(keywords.where(F.coalesce("partition", F.lit("")) != "own-brand").select("id", "keyword", "demand", "clicks", "partition", "local", "intent"))
    links = edges.select("a", "b", F.col("p_same").alias("total"), F.lit(1).alias("n"), (F.coalesce("p_different", F.lit(0.0)) >= different).alias("veto"))
    walls = _walls(own)
    group = linkage(walls, links, threshold=merge, coverage=coverage)
    sized = group.join(walls, "node").groupBy(F.col("cluster").alias("node")).agg(F.count("*").alias("size"), F.min("wall").alias("wall"), F.array_distinct(F.flatten(F.collect_set("kinds"))).alias("kinds"))  # a group has one kind at most
    at = group.select(F.col("node").alias("id"), F.col("cluster").alias("at"))
    wanted = head_merges.select("a", "b").distinct().join(at.select(F.col("id").alias("a"), F.col("at").alias("i")), "a").join(at.select(F.col("id").alias("b"), F.col("at").alias("j")), "b")
    joined = ordered_union(sized, wanted)
    group = settled(at.join(joined.select(F.col("node").alias("at"), "cluster"), "at").select("id", "cluster"))
    members = settled(own.join(group, "id"))
    out = settled(topics.evict(members, edges, merge=merge, different=different).select("id", F.col("p_same_with_head").alias("evicted"), F.col("new_cluster").alias("moved")))
    after = members.join(out, "id", "left").withColumn("cluster", F.when(F.col("evicted").isNull(), F.col("cluster")).otherwise(F.col("moved"))).drop("moved")
    after = settled(after)
    heads = topics.heads(after.where("cluster is not null")).where((F.col("n") > 1) | (F.col("demand") >= least_single))
    heads = heads.join(own.select(F.col("id").alias("head"), F.col("keyword").alias("name")), "head")
    ids = named(heads, [F.desc("demand"), F.asc("name"), F.asc("head")], "C", name="new")
    return after.select("id", F.col("cluster").alias("old"), "evicted").join(ids.select(F.col("cluster").alias("old"), F.col("new").alias("cluster"), "head", "demand", "name"), "old", "left").select("id", "cluster", "head", "demand", "name", "evicted")


def form_topics(clusters: DataFrame, links: DataFrame, *, threshold: float = 0.8, coverage: float = 0.5) -> DataFrame:
    """``topic, cluster, pillar, demand``: clusters that belong to one topic, ids by falling demand.

    clusters: cluster, n, demand, name; links: a, b, total, n (see :func:`cartoloom.operators.topics.cluster_links`).
    The pillar has most of 0.6 of relative demand and 0.4 of relative connections.
    """
    group = linkage(clusters.select(F.col("cluster").alias("node"), F.col("n").alias("size")), links.withColumn("veto", F.lit(False)), threshold=threshold, coverage=coverage)
    own = settled(group.select(F.col("node").alias("cluster"), F.col("cluster").alias("group")))
    rows = clusters.join(own, "cluster")
    strong = links.where(F.col("total") / F.col("n") >= threshold)
    inside = strong.join(own.select(F.col("cluster").alias("a"), F.col("group").alias("ga")), "a").join(own.select(F.col("cluster").alias("b"), F.col("group").alias("gb")), "b").where("ga = gb")
    degree = inside.select(F.explode(F.array("a", "b")).alias("cluster")).groupBy("cluster").agg(F.count("*").alias("links"))
    totals = rows.join(degree, "cluster", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    most = totals.groupBy("group").agg(F.max("demand").alias("most_demand"), F.max("links").alias("most_links"), F.sum("demand").alias("total"))
    score = 0.6 * F.coalesce(F.try_divide("demand", "most_demand"), F.lit(0.0)) + 0.4 * F.coalesce(F.try_divide("links", "most_links"), F.lit(0.0))
    scored = settled(totals.join(most, "group").withColumn("score", F.round(score, 9)))
    best = scored.groupBy("group").agg(F.min_by(F.struct("cluster", "name"), F.struct((-F.col("score")).alias("s"), (-F.col("demand")).alias("d"), "cluster")).alias("x"), F.first("total").alias("total"))
    ids = named(best.select("group", F.col("x.cluster").alias("first"), F.col("x.name").alias("name"), "total"), [F.desc("total"), F.asc("name"), F.asc("first")], "T", name="topic")
    return scored.join(ids.select("group", "topic", "first"), "group").select("topic", "cluster", (F.col("cluster") == F.col("first")).alias("pillar"), F.col("total").alias("demand"))
