"""URL functions by regular expression (Spark's parser returns null for spaces and brackets)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(url: Column) -> Column:
    """Lower case, without user, port and www."""
    h = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.regexp_replace(h, r"^www\.", "")


def path(url: Column) -> Column:
    p = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def bare(url: Column) -> Column:
    """Without fragment, query, scheme, www and closing slash: for comparing citations."""
    p = F.regexp_replace(path(url), "/+$", "")
    return F.concat(host(url), p)


def page_key(url: Column) -> Column:
    """Scheme and www do not count, the query does, the fragment does not."""
    q = query(url)
    return F.concat(bare(url), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def fragment_less(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def exact_key(url: Column) -> Column:
    """Scheme and host in lower case, www kept, slash kept."""
    return F.concat(scheme(url), F.lit("://"), F.lower(F.regexp_extract(url, r"://([^/?#]+)", 1)), F.regexp_extract(url, r"://[^/?#]+([^#]*)", 1))


def profile_key(url: Column) -> Column:
    """Host and lower-case path: two links to one profile."""
    return F.lower(bare(url))


def file_key(url: Column) -> Column:
    """File name of a page: path segments joined by two dashes."""
    p = F.regexp_replace(path(url), "^/+|/+$", "")
    return F.when(p == "", "home").otherwise(F.regexp_replace(p, "/+", "--"))


def serp_key(url: Column) -> Column:
    return F.regexp_replace(F.concat(host(url), path(url)), "/(index\\.[a-z]+)?$", "")


def is_home(url: Column) -> Column:
    return path(url).isin("/", "")


def silo(url: Column) -> Column:
    """First folder, empty on top level."""
    return F.regexp_extract(path(url), "^/([^/]+)/", 1)


def depth(url: Column) -> Column:
    return F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))


def registrable(url: Column) -> Column:
    """Last two labels, three below a second-level suffix such as co.uk."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    three = host(url).rlike(r"\.(co|com|org|net|gov|edu|ac)\.[a-z]{2}$")
    return F.array_join(F.slice(labels, F.greatest(F.lit(1), n - F.when(three, 2).otherwise(1)), 3), ".")


def market(url: Column) -> Column:
    """Country of a host: subdomain of two letters, else a country suffix, else global."""
    sub, tld = F.regexp_extract(host(url), r"^([a-z]{2})\.[^.]+\.", 1), F.regexp_extract(host(url), r"\.([a-z]{2})$", 1)
    return F.when(sub != "", sub).when(tld.isin("io", "ai", "co", "tv", "me"), "global").when(tld != "", tld).otherwise("global")


def page_type(url: Column) -> Column:
    p = F.lower(path(url))
    return (
        F.when(p.isin("/", ""), "home").when(p.rlike("/(blog|news|articles?|posts?)(/|$)"), "post")
        .when(p.rlike("/(category|tag|collections?|topics?)(/|$)"), "category").when(p.rlike("/(products?|shop|item)(/|$)"), "product")
        .when(p.rlike("/(about|contact|privacy|terms|legal)"), "utility").otherwise("page")
    )


def deep_link(endpoint: Column, parameter: Column, text: Column) -> Column:
    joiner = F.when(F.contains(endpoint, F.lit("?")), "&").otherwise("?")
    return F.concat(endpoint, joiner, parameter, F.lit("="), F.url_encode(text))
