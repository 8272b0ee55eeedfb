"""Review platforms: which apply, which profiles are the brand's, what they show and what reading them costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartoloom.functions.text import months_between


def with_capabilities(rows: DataFrame, platforms: DataFrame, *, key: str = "platform", flags: Sequence[str] = ("stars", "replies")) -> DataFrame:
    """Rows with their platform's flags; an unknown platform, or a flag it doesn't state, counts as true."""
    known = platforms.select(key, *[F.col(f).alias(f"has_{f}") for f in flags])
    return rows.join(known, key, "left").withColumns({f"has_{f}": F.coalesce(f"has_{f}", F.lit(True)) for f in flags})


def eligible(platforms: DataFrame, *, country: str, industry: str, employer: bool = False) -> DataFrame:
    """Platforms for a country and an industry; ``*`` or nothing means any, opt-in ones are for employers."""
    words = [w for w in "".join(c if c.isalpha() else " " for c in industry.lower()).split()]
    anywhere = lambda c: F.coalesce(F.size(c) == 0, F.lit(True)) | F.array_contains(c, "*")
    there = anywhere(F.col("countries")) | F.array_contains("countries", country.upper())
    fits = anywhere(F.col("industries")) | F.arrays_overlap("industries", F.array(*[F.lit(w) for w in words]).cast("array<string>"))
    return platforms.where((F.lit(employer) | ~F.coalesce("opt_in", F.lit(False))) & there & fits)


def brand_words(brand: str) -> list[str]:
    return [t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in brand.lower()).split() if len(t) > 1]


def names_brand(name: Column, brand: str) -> Column:
    """Every word of the brand is a word of the name."""
    words, wanted = F.split(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+"), brand_words(brand)
    return F.forall(F.array(*[F.lit(w) for w in wanted]), lambda w: F.array_contains(words, w)) if wanted else F.lit(False)


def keep_review(platform: Column, title: Column, text: Column, brand: str) -> Column:
    """Reviews of a forum count only where they name the brand, its words next to each other."""
    pattern = r"(?i)\b" + r"\W*".join(brand.split()) + r"\b"
    return (platform != "reddit") | F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))).rlike(pattern)


def one_place(rows: DataFrame, *, run: str, place: str, match: Column) -> DataFrame:
    """Rows with ``kept`` and ``why``: those of a run's only place that matches; with none or several nothing is kept."""
    fits = rows.groupBy(run, place).agg(F.max(match.cast("int")).alias("fits"))
    per = fits.groupBy(run).agg(F.sum("fits").alias("n"), F.max(F.when(F.col("fits") == 1, F.col(place))).alias("only"))
    why = F.when(F.col("n") == 0, "no place matches").when(F.col("n") == 1, "kept 1 place").otherwise(F.concat(F.col("n").cast("string"), F.lit(" places match")))
    return rows.join(per, run).withColumn("why", why).withColumn("kept", (F.col("n") == 1) & (F.col(place) == F.col("only"))).drop("n", "only")


def numbered(candidates: DataFrame, *, platform: str = "platform", key: str = "url", order: str = "place") -> DataFrame:
    """The first row of each profile, with an id of platform and number in order."""
    first = candidates.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("rn = 1")
    place = F.row_number().over(Window.partitionBy(platform).orderBy(order))
    return first.withColumn("id", F.concat(F.col(platform), F.lit("-"), place.cast("string"))).drop("rn")


def all_candidates(*sources: DataFrame) -> DataFrame:
    """Candidates of all sources, in the order of the sources and of their own places."""
    parts = [s.withColumn("place", F.struct(F.lit(k).alias("source"), F.col("place").cast("long").alias("at"))) for k, s in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def zero_filled(known: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """How many rows each known key has, zero for none."""
    return known.select(key).distinct().join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def merged_stats(parts: DataFrame, *, key: str, order: str, fields: Sequence[str], dates: str = "dates") -> DataFrame:
    """Each field's first value in the order of sources, empty texts passed over; all dates from the first source that has any."""
    kinds = dict(parts.dtypes)
    there = {f: F.col(f).isNotNull() & (F.col(f) != "") if kinds[f] == "string" else F.col(f).isNotNull() for f in fields}
    has = F.size(F.coalesce(dates, F.array().cast("array<string>"))) > 0
    first = [F.min_by(f, F.when(there[f], F.col(order))).alias(f) for f in fields]
    return parts.groupBy(key).agg(*first, F.coalesce(F.min_by(dates, F.when(has, F.col(order))), F.array().cast("array<string>")).alias(dates))


def recency(dates: Column, as_of: Column, total: Column) -> Column:
    """The latest date, and the reviews of twelve months: exact where an older one shows or all do, else a lower bound.

    dates: dates that a page shows, nulls aside; never more than the profile's own count of reviews.
    """
    newest = F.reverse(F.array_sort(F.filter(dates, lambda d: d.isNotNull())))
    shown = F.when(total.isNull() | (total < 0), newest).otherwise(F.slice(newest, F.lit(1), F.greatest(F.lit(0), total).cast("int")))
    within = F.size(F.filter(shown, lambda d: months_between(as_of, d) <= 12))
    exact = (within < F.size(shown)) | (total.isNotNull() & (total >= 0) & (F.size(shown) >= total))
    count = F.when(F.size(shown) == 0, F.when(total == 0, "0")).when(exact, within.cast("string")).otherwise(F.concat(F.lit(">="), within.cast("string")))
    return F.struct(F.try_element_at(shown, F.lit(1)).alias("latest"), count.alias("last_12m"))


def retailer_hits(results: DataFrame, retailers: Sequence[str], *, host: str = "host") -> DataFrame:
    """Results of known retailers by host, most first."""
    known = F.lit(False)
    for r in retailers:
        known = known | (F.col(host) == r) | F.col(host).endswith("." + r)
    return results.where(known).groupBy(host).agg(F.count("*").alias("n"))


def reading_cost(reviews: Column, price: Column, fee: Column, least: Column, cap: int | None = None) -> Column:
    """How many reviews would be read and what that costs; null without a price or a number."""
    known = F.when(reviews > 0, reviews.cast("long"))
    n = known if cap is None else F.coalesce(F.least(known, F.lit(cap)), F.lit(cap).cast("long"))
    n = F.greatest(n, F.coalesce(least.cast("long"), F.lit(0).cast("long")))
    asked = F.when(price.isNotNull() & ((known.isNotNull()) | F.lit(cap is not None)), n)
    return F.struct(asked.alias("n"), F.when(asked.isNotNull(), F.round(F.coalesce(fee, F.lit(0.0)) + asked * price, 4)).alias("usd"))


def entity_match(name: Column, site: Column, page: Column, *, brand: str, domain: str) -> Column:
    """``match`` where name and domain agree with the brand, ``partial`` where one does, else ``mismatch``."""
    wanted, low = brand_words(brand), F.lower(F.coalesce(name, F.lit("")))
    named = F.forall(F.array(*[F.lit(w) for w in wanted]), lambda w: F.contains(low, w)) if wanted else F.lit(False)
    own = F.lower(F.coalesce(site, F.lit("")))
    placed = F.when(own != "", F.contains(own, F.lit(domain)) | F.contains(own, F.lit(domain.split(".")[0]))).otherwise(F.contains(F.lower(F.coalesce(page, F.lit(""))), F.lit(domain)))
    return F.when(named & placed, "match").when(named | placed, "partial").otherwise("mismatch")


def match_flag(match: Column) -> Column:
    return F.when(match == "match", "").when(match == "partial", "⚠ partial match").when(match == "mismatch", "⚠ name/domain mismatch").otherwise("? not checked")


def picker(profiles: DataFrame, platforms: DataFrame, prices: DataFrame, *, cap: int | None = None) -> DataFrame:
    """Profiles to choose from: label, rating where the platform has stars, reviews to read, cost, flag; guessed ones go.

    profiles: id, platform, reviews, rating, match, read; platforms: platform, label, stars; prices: platform, price, fee,
    least, tested.
    """
    rows = profiles.where(~F.coalesce(F.col("read").startswith("no profile"), F.lit(False))).join(platforms, "platform", "left").join(prices, "platform", "left")
    cost = reading_cost(F.col("reviews"), F.col("price"), F.col("fee"), F.col("least"), cap)
    return rows.select("id", F.coalesce("label", "platform").alias("platform"), "reviews", F.when(F.coalesce("stars", F.lit(True)), F.col("rating")).alias("rating"), cost["n"].alias("est_reviews"), cost["usd"].alias("est_cost"), F.coalesce(F.col("price").isNotNull() & F.col("tested"), F.lit(False)).alias("scrapable"), match_flag(F.coalesce("match", F.lit("unknown"))).alias("flag"))
