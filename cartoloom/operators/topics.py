"""From judged keyword pairs to clusters, topics and a content plan."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartoloom.functions.text import jaccard
from cartoloom.operators.graph import settled

# What to do about a cluster by its status, and the two home-page actions that come before it.
HOME_CORE = "Keep on the home page: it is the site's core cluster. Move the other clusters the home page carries to their own pages."
HOME_EXTRA = "Create a dedicated page: the home page is carrying this cluster."


def has_phrase(norm: Column, phrase: Column) -> Column:
    """Whether whole words of a normal form hold a phrase."""
    return F.contains(F.concat(F.lit(" "), norm, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def site_host(rows: DataFrame, host: str) -> DataFrame:
    """The most frequent host in one row; ties by name."""
    named = rows.where(F.coalesce(F.col(host), F.lit("")) != "").groupBy(F.col(host).alias("site")).count()
    return named.groupBy().agg(F.min_by("site", F.struct((-F.col("count")).alias("n"), "site")).alias("site"))


def partition(norm: Column, branded: Column, terms: Sequence[str], site: Column) -> Column:
    """``own-brand``, ``branded`` or ``generic``: a brand term as whole words, or the squashed site name of four letters or more."""
    squashed = F.regexp_replace(F.split_part(F.coalesce(site, F.lit("")), F.lit("."), F.lit(1)), "[^a-z0-9]", "")
    own = (F.length(squashed) >= 4) & F.contains(F.replace(norm, F.lit(" "), F.lit("")), squashed)
    for term in terms:
        own = own | has_phrase(norm, F.lit(term))
    return F.when(own, "own-brand").when(F.coalesce(branded, F.lit(False)), "branded").otherwise("generic")


def flagged_intent(navigational: Column, informational: Column, commercial: Column, lexical: Column) -> Column:
    """Intent by flags where they agree on one, else by words, else ``mixed``."""
    return (
        F.when(navigational & ~informational & ~commercial, "navigational").when(informational & ~commercial, "informational")
        .when(commercial & ~informational, "commercial").otherwise(F.coalesce(lexical, F.lit("mixed")))
    )


def local_wall(norm: Column, flagged: Column, places: Sequence[str], near: Sequence[str] = ("near me",)) -> Column:
    """The places named, those inside a longer one left out; else ``near me``, ``local (no place)`` or nothing."""
    named = F.filter(F.array(*[F.lit(p) for p in sorted(set(places))]).cast("array<string>"), lambda p: has_phrase(norm, p))
    outer = F.filter(named, lambda p: ~F.exists(named, lambda q: (p != q) & has_phrase(q, p)))
    term = F.lit(False)
    for t in near:
        term = term | has_phrase(norm, F.lit(t))
    return F.when(F.size(outer) > 0, F.array_join(outer, " + ")).when(term, "near me").when(F.coalesce(flagged, F.lit(False)), "local (no place)").otherwise("")


def compatible(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """The wall between two keywords: partition and place equal, no own brand, intents equal or one of them mixed."""
    intents = (a["intent"] == b["intent"]) | (a["intent"] == "mixed") | (b["intent"] == "mixed")
    return (a["partition"] == b["partition"]) & (a["local"] == b["local"]) & (a["partition"] != "own-brand") & intents


def group_intents(intents: Column) -> Column:
    """Whether a group's intents, the mixed ones aside, are at most one."""
    return F.size(F.array_remove(F.array_distinct(intents), "mixed")) <= 1


#: The most rows of a key that one block holds.
HELD = 1 << 20


def _numbered(counts: DataFrame) -> DataFrame:
    """Keys of more than one row with a ``token_number`` and the ``blocks`` that their rows are dealt over.  counts: the key and n.

    Blocks are as few as keep a cell of two of them below a task's share of all pairs, since each row is shuffled once for each.
    """
    tasks = 8 * counts.sparkSession.sparkContext.defaultParallelism
    numbers = settled(counts.where("n > 1").coalesce(1 << 8).withColumn("token_number", F.monotonically_increasing_id()))
    total = numbers.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 1.0
    blocks = F.greatest(F.ceil(F.col("n") * (2 * tasks / total) ** 0.5), F.ceil(F.col("n") / HELD))
    return numbers.withColumn("blocks", F.least(blocks, F.lit(1 << 10)).cast("long")).drop("n")


def _meeting(rows: DataFrame) -> DataFrame:
    """Every two rows of equal number once: ``a, b`` by their ids, the lesser first, and the other columns of one as a_, of the other as b_.

    rows: id, token_number, blocks and others.  What a number makes goes by its square, so its rows are dealt over blocks, every
    two of which meet in a cell; the number of tasks is fixed: by what they read tasks would be put together.  A cell's key
    is one whole number, and a task holds one block of each of its cells.
    """
    tasks, last = 8 * rows.sparkSession.sparkContext.defaultParallelism, F.col("blocks") - 1
    others = [c for c in rows.columns if c not in ("id", "token_number", "blocks")]
    dealt = rows.where("id is not null").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    cell = F.col("token_number") * (1 << 20) + F.col("x") * (1 << 10) + F.col("y")
    ones = dealt.withColumn("x", F.col("block")).withColumn("y", F.explode(F.sequence("block", last)))
    twos = dealt.withColumn("y", F.col("block")).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), "block")))
    side = lambda frame, s: [cell.alias("token_cell"), F.col("id").alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in others]]
    ones = ones.select(*side(ones, "a"), (F.col("x") == F.col("y")).alias("one")).repartition(tasks, "token_cell")
    twos = twos.select(*side(twos, "b")).repartition(tasks, "token_cell")
    met = ones.join(twos.hint("shuffle_hash"), "token_cell").where(~F.col("one") | (F.col("a_id") < F.col("b_id")))
    return met.withColumn("a", F.least("a_id", "b_id")).withColumn("b", F.greatest("a_id", "b_id"))


def _paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ordered pairs ``a, b`` of keywords whose key, partition and place are equal and whose intents fit.

    left, right: key, partition, local, intent and a, b; without own brands, which pair with nothing.  What a key makes goes
    by its square, so a key's rows on the left are dealt over blocks, each of which meets all of that key on the right,
    and the number of tasks is fixed: by what they read tasks would be put together.
    """
    tasks, blocks = 8 * left.sparkSession.sparkContext.defaultParallelism, 8
    key = ["key", "partition", "local", "block"]
    a = left.select("a", "key", "partition", "local", F.col("intent").alias("a_intent"), F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int").alias("block"))
    b = right.select("b", "key", "partition", "local", F.col("intent").alias("b_intent"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    met = a.repartition(tasks, *key).join(b.repartition(tasks, *key).hint("shuffle_hash"), key)
    side = lambda s: {"partition": F.col("partition"), "local": F.col("local"), "intent": F.col(f"{s}_intent")}
    return met.where((F.col("a") < F.col("b")) & compatible(side("a"), side("b")))


def identical_tokens(rows: DataFrame) -> DataFrame:
    """``a, b, p_same, method``: keywords with the same token set belong together.

    Sets, partitions and places are numbered once, so a keyword is shuffled as a few whole numbers, in as many blocks as its
    number's rows call for.
    """
    key = ["tokens", "partition", "local"]
    keyed = rows.where((F.size("tokens") > 0) & (F.col("partition") != "own-brand"))
    numbers = _numbered(keyed.groupBy(*key).agg(F.count("*").alias("n")))
    intents = settled(keyed.select("intent").distinct().coalesce(1).withColumn("kind", F.when(F.col("intent") == "mixed", -1).otherwise(F.monotonically_increasing_id())))
    pairs = _meeting(keyed.join(numbers, key).join(F.broadcast(intents), "intent", "left").select("id", "token_number", "blocks", "kind"))
    fit = (F.col("a_kind") == F.col("b_kind")) | (F.col("a_kind") < 0) | (F.col("b_kind") < 0)
    return pairs.where(fit).select("a", "b", F.lit(1.0).alias("p_same"), F.lit("lexical").alias("method"))


def same_url(rows: DataFrame, *, least: float = 0.5) -> DataFrame:
    """``a, b, p_same, method``: keywords that rank with the same page and share half their tokens.

    Token sets of a page are compared once, whatever the number of keywords that have them.
    """
    ranked = rows.where((F.coalesce("url", F.lit("")) != "") & (F.col("partition") != "own-brand"))
    sets = settled(ranked.select("url", "tokens").distinct())
    alike = sets.join(sets.select("url", F.col("tokens").alias("others")), "url").where(jaccard(F.col("tokens"), F.col("others")) >= least)
    # a keyword goes to every set of its page that its own is like, and meets those that have it
    left = ranked.join(alike, ["url", "tokens"]).withColumn("key", F.struct("url", F.col("others").alias("tokens"))).withColumn("a", F.col("id"))
    right = ranked.withColumn("key", F.struct("url", "tokens")).withColumn("b", F.col("id"))
    return _paired(left, right).select("a", "b", F.lit(1.0).alias("p_same"), F.lit("url").alias("method"))


def capped_union(picks: DataFrame, *, per_source: dict[str, int], most: int = 16) -> DataFrame:
    """``anchor, other, sources``: the best of each source, then those that most sources name, up to a cap.

    picks: anchor, other, source, score.  Ties go by score, then by the other's id.
    """
    limit = F.create_map(*[x for s, n in sorted(per_source.items()) for x in (F.lit(s), F.lit(n))])
    rank = F.row_number().over(Window.partitionBy("anchor", "source").orderBy(F.desc("score"), "other"))
    best = picks.withColumn("rn", rank).where(F.col("rn") <= limit[F.col("source")])
    named = best.groupBy("anchor", "other").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc(F.size("sources")), F.desc("score"), "other"))
    return named.withColumn("rn", rank).where(F.col("rn") <= most).select("anchor", "other", "sources")


def effective_edges(lexical: DataFrame, judged: DataFrame, serp: DataFrame) -> DataFrame:
    """Every pair once: lexical edges first, then judgements, and what a search decided over both.

    ``a, b, p_same, p_related, p_different, method``; serp: a, b, decision.  ``keep`` decides nothing, and a decision
    on a pair that nobody judged adds no edge.
    """
    columns = ("a", "b", "p_same", "p_related", "p_different", "method")
    both = lexical.select("a", "b", F.lit(1.0).alias("p_same"), F.lit(0.0).alias("p_related"), F.lit(0.0).alias("p_different"), F.lit("lexical").alias("method"), F.lit(0).alias("turn"))
    both = both.unionByName(judged.select(*columns, F.lit(1).alias("turn")))
    first = both.groupBy("a", "b").agg(F.min_by(F.struct(*columns[2:]), F.struct("turn", "method")).alias("x")).select("a", "b", "x.*")
    decided = serp.where("decision in ('merge', 'split')").groupBy("a", "b").agg(F.min("decision").alias("decision"))
    merge, known = F.col("decision") == "merge", F.col("decision").isNotNull()
    values = {"p_same": F.when(merge, 1.0).otherwise(0.0), "p_related": F.when(merge, 0.0).otherwise(1.0), "p_different": F.lit(0.0), "method": F.lit("serp")}
    return first.join(decided, ["a", "b"], "left").select("a", "b", *[F.when(known, v).otherwise(F.col(c)).alias(c) for c, v in values.items()])


def heads(members: DataFrame, *, group: str = "cluster") -> DataFrame:
    """The head of each cluster: most demand, then clicks, then the keyword itself."""
    order = F.struct((-F.col("demand")).alias("d"), (-F.col("clicks")).alias("c"), "keyword", "id")
    return members.groupBy(group).agg(F.min_by("id", order).alias("head"), F.sum("demand").alias("demand"), F.count("*").alias("n"))


def both_ways(edges: DataFrame) -> DataFrame:
    flipped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *[c for c in edges.columns if c not in ("a", "b")])
    return edges.unionByName(flipped.select(*edges.columns))


def evict(members: DataFrame, edges: DataFrame, *, merge: float = 0.5, different: float = 0.5) -> DataFrame:
    """``id, cluster, p_same_with_head, new_cluster`` of members whose head judged them apart.

    They go to the compatible cluster whose head judged them the same page (best first, then the first cluster), else
    nowhere (null).  Members that their head never judged stay.
    """
    top = heads(members).select("cluster", "head")
    near = both_ways(edges.select("a", "b", "p_same", F.coalesce("p_different", F.lit(0.0)).alias("p_different"))).select(F.col("a").alias("head"), F.col("b").alias("id"), "p_same", "p_different")
    fine = (F.col("p_same") >= merge) & (F.col("p_different") < different)
    own = members.select("id", "cluster", "partition", "local", "intent")
    out = own.join(top, "cluster").where("id <> head").join(near, ["head", "id"]).where(~fine)
    out = out.select("id", "cluster", "partition", "local", "intent", F.col("p_same").alias("p_same_with_head"))
    kinds = members.groupBy("cluster").agg(F.min("partition").alias("to_partition"), F.min("local").alias("to_local"), F.collect_set("intent").alias("intents"))
    offers = out.join(near.where(fine), "id").join(top.withColumnRenamed("cluster", "to"), "head").where(F.col("to") != F.col("cluster"))
    offers = offers.join(kinds.withColumnRenamed("cluster", "to"), "to")
    walls = (F.col("partition") == F.col("to_partition")) & (F.col("local") == F.col("to_local")) & (F.col("partition") != "own-brand")
    walls = walls & group_intents(F.concat("intents", F.array("intent")))
    best = offers.where(walls).groupBy("id").agg(F.min_by("to", F.struct((-F.col("p_same")).alias("p"), "to")).alias("new_cluster"))
    return out.join(best, "id", "left").select("id", "cluster", "p_same_with_head", "new_cluster")


def cluster_links(members: DataFrame, edges: DataFrame, *, same_weight: float = 1.0) -> DataFrame:
    """``a, b, total, n``: related and same judgements between two clusters, added up."""
    where = members.select("id", "cluster")
    at = edges.join(where.select(F.col("id").alias("a"), F.col("cluster").alias("ca")), "a").join(where.select(F.col("id").alias("b"), F.col("cluster").alias("cb")), "b")
    value = F.coalesce("p_related", F.lit(0.0)) + same_weight * F.col("p_same")
    return at.where("ca <> cb").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def topic_rollup(clusters: DataFrame, *, topic: str = "topic") -> DataFrame:
    """Each topic's clusters, keywords, demand, and the share of clusters that rank at all."""
    ranked = F.when(F.col("status").isin("Lost", "Gap-in-list"), 0).otherwise(1)
    return clusters.groupBy(topic).agg(F.count("*").alias("n_clusters"), F.sum("n").alias("n_keywords"), F.sum("demand").alias("demand"), F.round(F.sum(ranked) / F.count("*"), 3).alias("coverage"))


def page_rollup(rankings: DataFrame, *, home: Column, overload: int = 3) -> DataFrame:
    """Each page's keywords and distinct clusters; a home page with many clusters is overloaded.

    rankings: url, id, cluster (or null), demand, clicks, partition; own-brand keywords don't count.
    """
    rows = rankings.where((F.col("partition") != "own-brand") & (F.coalesce("url", F.lit("")) != ""))
    pages = rows.groupBy("url").agg(F.count_distinct("cluster").alias("n_clusters"), F.count("*").alias("n_keywords"), F.sum("demand").alias("demand"), F.sum("clicks").alias("clicks"), F.array_join(F.array_sort(F.collect_set("cluster")), " | ").alias("clusters"))
    return pages.withColumn("is_home", home).withColumn("overloaded", F.col("is_home") & (F.col("n_clusters") >= overload))


def member_confidence(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, cluster, method, confidence``: the mean of a keyword's edges inside its cluster and its best edge's method."""
    where = members.select("id", "cluster")
    inside = both_ways(edges.select("a", "b", "p_same", "method")).join(where.withColumnRenamed("id", "a"), "a").join(where.select(F.col("id").alias("b"), F.col("cluster").alias("other")), "b").where("cluster = other")
    own = inside.groupBy(F.col("a").alias("id")).agg(F.round(F.avg("p_same"), 3).alias("confidence"), F.max_by("method", F.struct("p_same", "method")).alias("method"))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
    rows = members.join(sizes, "cluster", "left").join(own, "id", "left")
    method = F.when(F.col("partition") == "own-brand", "own-brand").when(F.col("cluster").isNull(), "unclustered").when(F.col("size") == 1, "singleton").otherwise(F.coalesce("method", F.lit("linkage")))
    clustered = method.isin("own-brand", "unclustered", "singleton")
    return rows.select("id", "cluster", method.alias("method"), F.when(~clustered, F.col("confidence")).alias("confidence"))


def best_candidates(loose: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, best, p_same`` for keywords in no cluster: the most likely page-mate, of equal ones the first in order."""
    near = both_ways(edges.select("a", "b", "p_same"))
    best = near.groupBy(F.col("a").alias("id")).agg(F.max_by("b", F.struct("p_same", (-F.col("b")).alias("r"))).alias("best"), F.max("p_same").alias("p_same"))
    return loose.select("id").join(best, "id", "left")


def home_roles(clusters: DataFrame, *, on_home: str = "on_home") -> DataFrame:
    """``cluster, role``: of the clusters that the home page ranks for, the largest is the core, others are extra."""
    on = clusters.where(F.col(on_home))
    core = on.groupBy().agg(F.min_by("cluster", F.struct((-F.col("demand")).alias("d"), "cluster")).alias("core"))
    return on.crossJoin(F.broadcast(core)).select("cluster", F.when(F.col("cluster") == F.col("core"), "core").otherwise("extra").alias("role"))


def action(status: Column, role: Column, all_navigational: Column, actions: dict[str, str]) -> Column:
    """What to do about a cluster; the home page's part comes before the status."""
    by_status = F.lit(None).cast("string")
    for name, text in actions.items():
        by_status = F.when(status == name, text).otherwise(by_status)
    return F.when((role == "core") & (status != "Cannibalised"), HOME_CORE).when((role == "extra") & ~all_navigational, HOME_EXTRA).otherwise(by_status)


#: Bits of the addresses of a search: up to so many addresses have one each, and the bits in common are the addresses in common.
BITS = 256


def serp_overlaps(results: DataFrame, keywords: DataFrame, *, platforms: Sequence[str] = (), merge: int = 4, split: int = 3) -> DataFrame:
    """``a, b, shared, decision, suspect`` of searches whose keywords share a word.

    results: id, url (normal form), host; keywords: id, tokens.  A search that shares no address with any such other
    is suspect, and its pairs are kept as they are.  It is one whose every (word, address) is its own alone.  Pairs meet on
    words, each at its first common one, and carry their addresses along as bits, so no pair is shuffled; where there are
    more addresses than bits, pairs with a bit in common compare the addresses themselves.
    """
    apart = F.lit(False)
    for p in platforms:
        apart = apart | (F.col("host") == p) | F.col("host").endswith("." + p)
    urls = settled(results.where(~apart & F.col("url").isNotNull()).select("url").distinct())
    few = urls.count() <= BITS
    at = F.row_number().over(Window.orderBy("url")) - 1 if few else F.monotonically_increasing_id()
    urls = settled(urls.withColumn("at", at.cast("long")))
    bit = F.pmod("at", F.lit(BITS))
    words = [f"bits{k}" for k in range(BITS // 64)]
    here = results.select("id", F.when(~apart, F.col("url")).alias("url")).join(urls, "url", "left")
    masks = [F.coalesce(F.bit_or(F.when(F.floor(bit / 64) == k, F.expr(f"shiftleft(1L, cast(pmod(at, {BITS}) % 64 as int))"))), F.lit(0).cast("long")).alias(w) for k, w in enumerate(words)]
    fetched = here.groupBy("id").agg(F.collect_set("at").alias("urls"), *masks)
    numbers = _numbered(keywords.select(F.explode(F.array_distinct("tokens")).alias("token")).where("token is not null").groupBy("token").agg(F.count("*").alias("n")))
    own = keywords.select("id", F.explode("tokens").alias("token")).join(numbers, "token").groupBy("id").agg(F.array_sort(F.collect_set(F.struct("token_number", "blocks"))).alias("tokens"))
    own = settled(own.join(fetched, "id"))
    met = own.select("id", F.explode("tokens.token_number").alias("token"), "urls").select("id", "token", F.explode("urls").alias("at"))
    single = met.groupBy("token", "at").agg(F.min("id").alias("id"), F.max("id").alias("most")).where("id = most").groupBy("id").agg(F.count("*").alias("single"))
    lone = F.coalesce("single", F.lit(0)) == F.size("tokens").cast("long") * F.size("urls")
    own = own.join(settled(single), "id", "left").withColumn("alone", lone)
    rows = own.select("id", "alone", *words, "tokens", *([] if few else ["urls"]), F.posexplode("tokens").alias("place", "token"))
    rows = rows.withColumn("before", F.slice("tokens.token_number", 1, F.col("place"))).withColumn("sign", F.aggregate("before", F.lit(0).cast("long"), lambda x, w: x.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int")))))
    pairs = _meeting(rows.select("*", "token.*").drop("token", "tokens", "place"))
    pairs = pairs.where((F.col("a_sign").bitwiseAND(F.col("b_sign")) == 0) | ~F.arrays_overlap("a_before", "b_before"))
    shared = sum((F.bit_count(F.col(f"a_{w}").bitwiseAND(F.col(f"b_{w}"))) for w in words), F.lit(0))
    if not few:
        shared = F.when(shared > 0, F.size(F.array_intersect("a_urls", "b_urls"))).otherwise(0)
    pairs = pairs.select("a", "b", shared.cast("long").alias("shared"), (F.col("a_alone") | F.col("b_alone")).alias("suspect"))
    decision = F.when(F.col("suspect"), "keep").when(F.col("shared") >= merge, "merge").when(F.col("shared") < split, "split").otherwise("keep")
    return pairs.select("a", "b", "shared", decision.alias("decision"), "suspect")


def search_plan(edges: DataFrame, demands: DataFrame, *, band: tuple[float, float] = (0.35, 0.65)) -> DataFrame:
    """``a, b, demand`` of uncertain judgements; a plan takes them by falling demand."""
    unsure = edges.where((F.col("method") == "judged") & F.col("p_same").between(*band)).select("a", "b")
    d = demands.select("id", "demand")
    rows = unsure.join(d.select(F.col("id").alias("a"), F.col("demand").alias("da")), "a").join(d.select(F.col("id").alias("b"), F.col("demand").alias("db")), "b")
    return rows.select("a", "b", (F.col("da") + F.col("db")).alias("demand"))


def within_budget(plan: DataFrame, *, limit: int, order: str = "place", group: str = "site") -> DataFrame:
    """Pairs of a plan, in order, as long as their new keywords fit a budget of distinct keywords; others are passed over.

    Each choice depends on all before it, so a group (a site's plan) is one task.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        seen: set = set()
        taken = []
        part = part.sort_values(order)
        for a, b in zip(part["a"], part["b"], strict=True):
            fits = len(seen | {a, b}) <= limit
            seen |= {a, b} if fits else set()
            taken.append(fits)
        return part[taken]

    return plan.groupBy(group).applyInPandas(run, plan.schema)


def by_cluster(members: DataFrame, clusters: DataFrame, topics: DataFrame) -> DataFrame:
    """Every keyword once with its ``place``: topics and clusters by demand, the head first; then loose ones, then own brand.

    members: id, keyword, demand, cluster (or null), partition; clusters: cluster, topic, demand, head; topics: topic,
    demand.  Places count inside a topic and start after those of the topics before, so topics are numbered side by side.
    """
    at = clusters.select("cluster", "topic", F.col("demand").alias("cluster_demand"), "head").join(topics.select("topic", F.col("demand").alias("topic_demand")), "topic")
    part = F.when(F.col("partition") == "own-brand", 2).when(F.col("cluster").isNull(), 1).otherwise(0)
    rows = members.select("id", "keyword", "demand", "cluster", "partition").join(at, "cluster", "left").withColumn("part", part)
    rows = rows.select("id", "keyword", "demand", "cluster", "part", "head", "cluster_demand", *[F.when(F.col("part") == 0, F.col(c)).alias(c) for c in ("topic", "topic_demand")])
    sections = rows.groupBy("part", "topic").agg(F.max("topic_demand").alias("d"), F.count("*").alias("n"))
    before = Window.orderBy("part", F.desc("d"), "topic").rowsBetween(Window.unboundedPreceding, -1)
    starts = sections.select(F.col("part").alias("p"), F.col("topic").alias("t"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("part", "topic").orderBy(F.desc(F.when(F.col("part") == 0, F.col("cluster_demand"))), F.when(F.col("part") == 0, F.col("cluster")), F.when((F.col("part") == 0) & (F.col("id") == F.col("head")), 0).otherwise(1), F.desc("demand"), "keyword", "id")
    placed = rows.withColumn("rn", F.row_number().over(within)).join(starts, (F.col("part") == F.col("p")) & F.col("topic").eqNullSafe(F.col("t")))
    label = F.when(F.col("part") == 2, "Branded").when(F.col("part") == 1, "Unclustered").otherwise(F.col("cluster"))
    return placed.select(F.coalesce("topic", F.lit("")).alias("topic"), label.alias("cluster"), "id", "keyword", "demand", (F.col("start") + F.col("rn")).alias("place"))
