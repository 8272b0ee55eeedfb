"""Text functions on columns: keys, stems, tokens, numbers, dates, scores."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Click-through rate by position (step function), null markers, date formats.
CTR_LADDER = {1: 0.28, 2: 0.15, 3: 0.10, 4: 0.07, 5: 0.05, 6: 0.04, 7: 0.03, 8: 0.025, 9: 0.02, 10: 0.018, 20: 0.01, 100: 0.002}
NULL_WORDS = ("", "none", "null", "nan", "undefined", "[redacted]")
DATE_FORMATS = ("yyyy-MM-dd", "MMMM d, yyyy", "d MMMM yyyy", "MM/dd/yyyy", "yyyy/MM/dd")


@pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark lacks."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@pandas_udf(StringType())
def unescape_entities(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


def keyword_key(text: Column, *, unicode: bool = True) -> Column:
    """Normal form of a keyword: NFKC, lower case, straight apostrophes, 's as s, words single-spaced.

    ``unicode=False`` skips NFKC and stays in the JVM; equal for text that is composed already.
    """
    x = F.lower(nfkc(text) if unicode else text)
    x = F.regexp_replace(x, "[’‘ʼ]", "'")
    x = F.regexp_replace(x, r"(?U)'s\b", "s")
    x = F.regexp_replace(x, r"(?U)[^\w\s]|_", " ")
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def short_id(text: Column, prefix: str = "k", n: int = 10) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, n))


def salted_id(*parts: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[F.lower(F.trim(p)) for p in parts]), 256), 1, n)


def ascii_words(text: Column) -> Column:
    """Runs of a-z and 0-9 in lower case."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def content_tokens(words: Column, stop: Sequence[str] = ()) -> Column:
    """Sorted distinct words without stop words."""
    kept = F.filter(words, lambda w: ~w.isin(*stop)) if stop else words
    return F.array_sort(F.array_distinct(kept))


def stem_plural(word: Column) -> Column:
    """ies to y; a plural s goes (not ss, us, is)."""
    n = F.length(word)
    return (
        F.when((n > 4) & word.endswith("ies"), F.concat(word.substr(F.lit(1), n - 3), F.lit("y")))
        .when((n > 3) & word.endswith("s") & ~word.rlike("(ss|us|is)$"), word.substr(F.lit(1), n - 1))
        .otherwise(word)
    )


def stem_suffix(word: Column, least: int = 3) -> Column:
    """The first suffix that leaves enough letters goes."""
    out = word
    for suffix in reversed(("'s", "ies", "ing", "ed", "es", "s")):
        out = F.when(word.endswith(suffix) & (F.length(word) - len(suffix) >= least), word.substr(F.lit(1), F.length(word) - len(suffix))).otherwise(out)
    return out


def stem_head(word: Column, n: int = 5) -> Column:
    return F.substring(word, 1, n)


def sentences(text: Column) -> Column:
    """Split at line breaks and after . ! ? before white space."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def ngrams(words: Column, n: int, stop: Sequence[str] = ()) -> Column:
    """Distinct runs of n words without a stop word at either edge and not all digits.

    The words are bound once: an expression inside a lambda is worked out again for every run.
    """

    def runs(ws: Column) -> Column:
        out = F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.slice(ws, i, n))).otherwise(F.array().cast("array<array<string>>"))
        if stop:
            out = F.filter(out, lambda r: ~F.element_at(r, 1).isin(*stop) & ~F.element_at(r, -1).isin(*stop))
        out = F.filter(out, lambda r: F.exists(r, lambda w: ~w.rlike("^[0-9]+$")))
        return F.array_distinct(F.transform(out, lambda r: F.array_join(r, " ")))

    return F.element_at(F.transform(F.array(words), runs), 1)


def jaccard(a: Column, b: Column) -> Column:
    """0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def overlap_coefficient(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))), F.lit(0.0))


def phrase_in(text: Column, phrase: Column) -> Column:
    """Whether a phrase occurs between word boundaries."""
    return F.coalesce(F.regexp_like(text, F.concat(F.lit(r"(?U)(?<!\w)\Q"), phrase, F.lit(r"\E(?!\w)"))), F.lit(False))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def number(text: Column) -> Column:
    """A number without thousands separators and percent signs, else null."""
    return F.regexp_replace(text, "[,%\\s]", "").try_cast("double")


def numbers_in(text: Column) -> Column:
    """All numbers of a text, 113.4k as 113400."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?\s?(?:k|m)?\b"), F.lit(0))

    def value(s: Column) -> Column:
        plain = F.regexp_replace(s, r"[,km\s]", "").try_cast("double")
        return F.round(plain * F.when(s.endswith("k"), 1e3).when(s.endswith("m"), 1e6).otherwise(1.0), 6)

    return F.transform(found, value)


def date_of(text: Column) -> Column:
    """A date from ISO text, five written formats, or epoch seconds or milliseconds; else null."""
    epoch = F.when(text.rlike("^[0-9]{9,13}$"), text.try_cast("double"))
    seconds = F.when(epoch > 1e11, epoch / 1000).otherwise(epoch)
    written = [F.try_to_timestamp(text, F.lit(f)).cast("date") for f in DATE_FORMATS[1:]]
    iso = F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10)), F.lit(DATE_FORMATS[0])).cast("date")
    return F.coalesce(iso, F.timestamp_seconds(seconds).cast("date"), *written)


def months_between(later: Column, earlier: Column) -> Column:
    """Days divided by 30.44, not calendar months."""
    return F.datediff(later, earlier) / F.lit(30.44)


def ctr_at(position: Column, ladder: dict[int, float] | None = None) -> Column:
    """The rate of the first step at or after a position, the last beyond, 0 for null."""
    steps = sorted((ladder or CTR_LADDER).items())
    out = F.lit(0.0)
    chain = F.when(position.isNull(), out)
    for p, rate in steps:
        chain = chain.when(position <= p, F.lit(rate))
    return chain.otherwise(F.lit(steps[-1][1]))


def not_blank(text: Column) -> Column:
    """Null for words that stand for null."""
    return F.when(~F.lower(F.trim(text)).isin(*NULL_WORDS), text)


def rating_band(rating: Column) -> Column:
    return F.when(rating.isNull(), "none").when(rating <= 2, "low").when(rating < 4, "mid").otherwise("high")


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("true", "1", "yes"), F.lit(False))


def lexical_intent(words: Column, navigational: Sequence[str], informational: Sequence[str], commercial: Sequence[str]) -> Column:
    """Navigational words win; else informational xor commercial; else mixed."""
    some = lambda listed: F.arrays_overlap(words, F.array(*map(F.lit, listed)))
    i, c = some(informational), some(commercial)
    return F.when(some(navigational), "navigational").when(i & ~c, "informational").when(c & ~i, "commercial").otherwise("mixed")


def evidence_key(text: Column) -> Column:
    """Text for verbatim comparison: NFKC, straight quotes, dashes as spaces, other punctuation gone."""
    x = F.lower(nfkc(text))
    x = F.regexp_replace(F.regexp_replace(x, "[“”‘’\"'`]", ""), "[-‐-―/]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?U)[^\w\s%$€£.]", ""), r"(?U)\s+", " "))


def snippet(text: Column, at: Column, around: int = 160) -> Column:
    """Characters around a one-based place."""
    return F.when(at > 0, F.substr(text, F.greatest(F.lit(1), at - around), F.lit(2 * around)))
