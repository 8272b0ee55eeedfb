"""Keyword pipeline: ingest, walls, candidate pairs, cluster scores, cannibalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartoloom.functions.text import ctr_at, keyword_key, number, short_id, truthy


def without_operators(rows: DataFrame, column: str) -> DataFrame:
    """Search-operator queries (site:, allintitle:) go."""
    return rows.where(~F.col(column).rlike(r"^\s*\w+:"))


def main_country(rows: DataFrame, column: str) -> DataFrame:
    """Rows of the most frequent country, ties by name."""
    top = rows.groupBy(column).count().orderBy(F.desc("count"), column).limit(1).select(column)
    return rows.join(F.broadcast(top), column, "left_semi")  # one row


def best_rows(rows: DataFrame, *, key: str, position: str, volume: str, row_id: str, mode: str = "sum") -> DataFrame:
    """One row for each key: demand by sum or max, clicks, and position and URL of the best-ranked row.

    Rank: position (0 and null last), then volume, then row.  Where the best row has no URL the first ranked one
    with a URL gives both.  Needs columns url, clicks, country.  A struct minimum does this without a sort.
    """
    place = F.when(F.coalesce(F.col(position), F.lit(0)) == 0, 1e9).otherwise(F.col(position)).cast("double")
    rank = F.struct(place.alias("p"), (-F.coalesce(F.col(volume), F.lit(0))).alias("v"), F.col(row_id).alias("r"))
    demand = F.sum(volume) if mode == "sum" else F.max(volume)
    has = F.coalesce(F.col("url"), F.lit("")) != ""
    return rows.withColumn("__rank", rank).groupBy(key).agg(
        demand.alias("demand"), F.sum("clicks").alias("clicks"), F.coalesce(F.min_by("url", F.when(has, F.col("__rank"))), F.lit(None).cast("string")).alias("current_url"),
        F.coalesce(F.min_by(position, F.when(has, F.col("__rank"))), F.min_by(position, "__rank")).alias("position"), F.array_sort(F.collect_set("country")).alias("countries"), F.count("*").alias("rows"),
    )


def read_export_a(raw: DataFrame) -> DataFrame:
    """Typed rows of a keyword export with volumes."""
    keep = [number(F.col(c)).alias(a) for c, a in (("Volume", "volume"), ("KD", "kd"), ("CPC", "cpc"), ("Current position", "position"), ("Current organic traffic", "clicks"))]
    flags = F.create_map(*[x for c in ("Branded", "Local", "Navigational", "Informational", "Commercial", "Transactional") for x in (F.lit(c.lower()), truthy(F.col(c)))])
    norm = keyword_key(F.col("Keyword"))
    rows = without_operators(raw, "Keyword").select(F.col("Keyword").alias("keyword"), norm.alias("norm"), F.col("Country").alias("country"), F.col("`Current URL`").alias("url"), F.col("`Previous URL`").alias("previous_url"), *keep, flags.alias("flags"))
    return rows.where("norm <> ''").withColumn("id", short_id(F.col("norm")))


def page_queries(rows: DataFrame, *, query: str, page: str, raw_url: str, clicks: str, impressions: str, position: str) -> DataFrame:
    """Queries of a page-by-query export.

    Per raw URL impressions add up and the position is their weighted mean; of a page's fragments the one with most
    impressions (then best position) counts; a query's demand is its best page's impressions.
    """
    w = F.greatest(F.col(impressions).cast("double"), F.lit(1e-9))
    has = F.col(position).isNotNull()
    by_url = rows.groupBy(query, page, raw_url).agg(F.sum(clicks).alias("clicks"), F.sum(impressions).alias("impressions"), F.try_divide(F.sum(F.when(has, F.col(position) * w)), F.sum(F.when(has, w))).alias("position"))
    best = F.struct((-F.col("impressions")).alias("a"), F.coalesce("position", F.lit(1e9)).alias("b"), F.col(raw_url).alias("c"))
    by_page = by_url.groupBy(query, page).agg(F.sum("clicks").alias("clicks"), F.min_by("impressions", best).alias("impressions"), F.min_by("position", best).alias("position"))
    first = F.struct((-F.col("clicks")).alias("a"), (-F.col("impressions")).alias("b"), F.col(page).alias("c"))
    return by_page.groupBy(query).agg(F.max("impressions").alias("demand"), F.sum("clicks").alias("clicks"), F.min("position").alias("position"), F.min_by(page, first).alias("current_url"), F.count("*").alias("pages"))


def share(value: str, *by: str) -> Column:
    """Part of the total within a group, 0 where that is 0."""
    return F.coalesce(F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*by))), F.lit(0.0))


def url_stats(members: DataFrame, *, group: str, url: str, demand: str, clicks: str, position: str) -> DataFrame:
    """Demand, clicks, weighted position and demand share of each URL in a group."""
    w = F.greatest(F.col(demand).cast("double"), F.lit(1e-9))
    agg = members.groupBy(group, url).agg(F.sum(demand).alias("demand"), F.sum(clicks).alias("clicks"), (F.sum(F.col(position) * w) / F.sum(w)).alias("position"))
    return agg.withColumn("share", share("demand", group))


def top_two(stats: DataFrame, *, group: str, url: str, least_share: float = 0.15, most_gap: float = 5.0) -> DataFrame:
    """Groups whose second URL takes a fair share at a near position, with their severity."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.round("share", 9)), url))
    two = stats.withColumn("rn", rank).where("rn <= 2")
    at = lambda c, n: F.max(F.when(F.col("rn") == n, F.col(c)))
    pairs = two.groupBy(group).agg(*[at(c, n).alias(f"{c}_{n}") for c in (url, "share", "position") for n in (1, 2)]).where(F.col(f"{url}_2").isNotNull())
    gap = F.abs(F.coalesce("position_1", F.lit(0.0)) - F.coalesce("position_2", F.lit(0.0)))
    level = F.when((F.col("share_2") >= 0.3) & (gap <= 3), "High").when((F.col("share_2") >= least_share) & (gap <= most_gap), "Medium").otherwise("Low")
    return pairs.withColumn("gap", gap).withColumn("severity", level)


def status(position: Column, url: Column, previous: Column, cannibal: Column) -> Column:
    return (
        F.when(url.isNull() | (url == ""), F.when(F.coalesce(previous, F.lit("")) != "", "Lost").otherwise("Gap-in-list"))
        .when(cannibal, "Cannibalised").when(position <= 3.99, "Owned").when(position <= 20, "Striking").otherwise("Underperforming")
    )


def opportunity(demand: Column, position: Column, *, clicks: Column | None = None, target: int = 3) -> Column:
    """Demand times the gain in click rate at the target position, never negative."""
    now = ctr_at(position) if clicks is None else F.coalesce(F.try_divide(clicks, demand), F.lit(0.0))
    return F.greatest(F.lit(0.0), demand * (ctr_at(F.lit(float(target))) - now))


def cluster_scores(members: DataFrame, *, group: str, demand: str = "demand", position: str = "position") -> DataFrame:
    """Totals, weighted position and opportunity of each cluster."""
    w = F.greatest(F.col(demand).cast("double"), F.lit(1e-9))
    rows = members.groupBy(group).agg(F.count("*").alias("members"), F.sum(demand).alias("demand"), F.try_divide(F.sum(F.when(F.col(position).isNotNull(), F.col(position) * w)), F.sum(F.when(F.col(position).isNotNull(), w))).alias("position"))
    return rows.withColumn("opportunity", opportunity(F.col("demand").cast("double"), F.col("position")))


def shared_token_pairs(items: DataFrame, *, key: str, tokens: str, wall: tuple[str, ...] = (), least: float = 0.34) -> DataFrame:
    """``a, b, similarity`` of pairs within a wall whose token sets have at least a Jaccard similarity.

    An inverted-index join with a prefix filter: of n tokens, rarest first, only the first n - ceil(least n) + 1
    can be needed to meet, so a token that many items hold makes no pairs but where nothing rarer could.
    """
    rows = items.where(F.size(tokens) > 0).select(F.col(key).alias("k"), *wall, F.col(tokens).alias("t"))
    long = rows.select("k", *wall, F.size("t").alias("n"), F.explode("t").alias("token"))
    freq = long.groupBy("token").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("k").orderBy("df", "token"))
    prefix = long.join(freq, "token").withColumn("rn", rank).where(F.col("rn") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    left = prefix.select(F.col("k").alias("a"), F.col("n").alias("na"), "token", *wall)
    right = prefix.select(F.col("k").alias("b"), F.col("n").alias("nb"), "token", *wall)
    near = left.join(right, ["token", *wall]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9)).select("a", "b").distinct()
    full = rows.select("k", "t")
    both = near.join(full.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a").join(full.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    return both.select("a", "b", F.round(common / (F.size("ta") + F.size("tb") - common), 6).alias("similarity")).where(F.col("similarity") >= least)


def pillars(clusters: DataFrame, *, topic: str, demand: str = "demand", links: str = "links", name: str = "cluster") -> DataFrame:
    """Each topic's pillar: 0.6 of relative demand and 0.4 of relative connections."""
    w = Window.partitionBy(topic)
    score = 0.6 * F.coalesce(F.try_divide(F.col(demand), F.max(demand).over(w)), F.lit(0.0)) + 0.4 * F.coalesce(F.try_divide(F.col(links), F.max(links).over(w)), F.lit(0.0))
    rows = clusters.withColumn("pillar_score", F.round(score, 6))
    return rows.withColumn("rn", F.row_number().over(w.orderBy(F.desc("pillar_score"), F.desc(demand), name))).where("rn = 1").drop("rn")
