"""Content security policies as columns: what they say about a target, and the worst over all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directives that decide about each kind of load, the first one set counts; verdicts from best to worst.
CHAINS = {"script": ("script-src-elem", "script-src", "default-src"), "frame": ("frame-src", "child-src", "default-src"), "connect": ("connect-src", "default-src")}
VERDICTS = ("allows", "unclear", "blocks")
_SOURCE = r"(?i)^(?:([a-z][a-z0-9+.-]*)://)?(\*|\*\.[^/:]+|[^/:*]+)(?::([0-9]+|\*))?(/.*)?$"


def policies(values: Column) -> Column:
    """Policies of repeated or comma-joined header values, as maps from directive to sources (the first of a name counts)."""
    texts = F.filter(F.flatten(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.split(F.coalesce(v, F.lit("")), ","))), lambda p: F.trim(p) != "")
    return F.transform(texts, _parsed)


def _parsed(policy: Column) -> Column:
    parts = F.filter(F.transform(F.split(policy, ";"), lambda d: F.filter(F.split(d, r"\s+"), lambda w: w != "")), lambda w: F.size(w) > 0)
    entries = F.transform(parts, lambda w: F.struct(F.lower(w[0]).alias("name"), F.slice(w, 2, F.size(w)).alias("sources")))
    names = F.transform(entries, lambda e: e["name"])
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(names, e["name"]) == i + 1))


def source_matches(source: Column, target: Column) -> Column:
    """Whether one source expression takes in an address: any host, a scheme alone, or scheme, host with wildcard and path.

    http takes in https; ports are read but not compared; a path that ends with a slash takes in what is below it.
    """
    of = lambda n: F.regexp_extract(source, _SOURCE, n)
    scheme, host = F.lower(F.regexp_extract(target, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lower(F.coalesce(F.try_parse_url(target, F.lit("HOST")), F.lit("")))
    path = F.coalesce(F.try_parse_url(target, F.lit("PATH")), F.lit(""))
    own, wanted = F.lower(of(1)), F.lower(of(2))
    scheme_fits = (own == "") | (own == scheme) | ((own == "http") & (scheme == "https"))
    host_fits = (wanted == "*") | F.when(F.startswith(wanted, F.lit("*.")), F.endswith(host, F.substr(wanted, F.lit(2)))).otherwise(wanted == host)
    below = F.coalesce(F.try_url_decode(F.replace(of(4), F.lit("+"), F.lit("%2B"))), of(4))
    path_fits = (of(4) == "") | F.when(F.endswith(below, F.lit("/")), F.startswith(path, below)).otherwise(path == below)
    alone = F.rlike(source, F.lit(r"(?i)^[a-z][a-z0-9+.-]*:$"))
    return (
        F.when(source == "*", scheme.isin("http", "https")).when(alone, F.lower(F.regexp_replace(source, ":$", "")) == scheme)
        .otherwise(F.rlike(source, F.lit(_SOURCE)) & scheme_fits & host_fits & path_fits)
    )


def _quoted(source: Column) -> Column:
    return F.startswith(source, F.lit("'"))


def _says(policy: Column, chain: Sequence[str], target: Column) -> Column:
    """``rank, directive`` of one policy for a target; rank 0 with no directive where nothing restricts it."""
    out = F.struct(F.lit(0).alias("rank"), F.lit("").alias("directive"))
    for name in reversed(chain):
        sources = F.filter(F.try_element_at(policy, F.lit(name)), lambda s: s.isNotNull())
        strict = F.exists(sources, lambda s: F.lower(s) == "'strict-dynamic'") if name.startswith("script") else F.lit(False)
        listed = F.exists(sources, lambda s: ~_quoted(s) & source_matches(s, target))
        out = F.when(sources.isNotNull(), F.struct(F.when(strict, 1).when(listed, 0).otherwise(2).alias("rank"), F.lit(name).alias("directive"))).otherwise(out)
    return out


def verdict(policies_: Column, kind: str, target: Column) -> Column:
    """``allows``, ``unclear`` (host lists don't count) or ``blocks``: the worst of all policies; ``no policy`` without any."""
    said = F.transform(policies_, lambda p: _says(p, CHAINS[kind], target)["rank"])
    names = F.array(*map(F.lit, VERDICTS))
    return F.when(F.size(policies_) < 1, "no policy").otherwise(F.element_at(names, F.array_max(said) + 1))


def inline_verdict(policies_: Column) -> Column:
    """``allows`` or ``may block`` for scripts written into the page: all policies must let them, and nothing may undo that."""

    def lets(policy: Column) -> Column:
        out = F.lit(True)
        for name in reversed(CHAINS["script"]):
            own = F.transform(F.try_element_at(policy, F.lit(name)), lambda s: F.lower(s))
            undone = F.exists(own, lambda s: (s == "'strict-dynamic'") | F.rlike(s, F.lit(r"^'(nonce-|sha(256|384|512)-)")))
            out = F.when(own.isNotNull(), F.array_contains(own, "'unsafe-inline'") & ~undone).otherwise(out)
        return out

    return F.when(F.size(policies_) < 1, "no policy").when(F.forall(policies_, lets), "allows").otherwise("may block")
