"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoloom.llm import decontamination, filter_audit, fingerprints, language, near_duplicates, packing, personal_data, phrases, quality, repeats, token_counts, token_files, toxicity
from cartoloom.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text; null counts as empty, repeated rows and ids give one row each."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the digest of what is left of it; null counts as empty, a repeated row repeats as a whole."""
    return repeats.digest(repeats.remove_repeats(table(spark, sf_dir, "documents")))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and likenesses of every document, its edited text and the next document; null counts as empty."""
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hits and items of every document; null and empty texts have no words, an empty benchmark hits nothing."""
    return decontamination.digest(decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document with its class and its number of links."""
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents")).drop("first", "t")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and checksums of every document, read back from the files; null is the end id alone."""
    return token_files.digest(token_files.token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece with its sequence and place; null is the end id alone, an empty table has no pieces."""
    return packing.digest(packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned outside the held-out fold; null, empty and letterless texts are ``und``."""
    docs = table(spark, sf_dir, "documents")
    held_out = language.in_fold(F.col("doc_id"), 5, 0)
    model = language.fit_on_sample(docs.where(~held_out))
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned outside the held-out fold; texts that share no term with any example get a constant."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = language.in_fold(F.col("doc_id"), 4, 2)
    model = toxicity.fit_on_sample(docs.where(~held_out), labels.where(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every whole text; null counts as empty, repeated rows give one row each."""
    docs = table(spark, sf_dir, "documents")
    return personal_data.digest(personal_data.find(docs, personal_data.fit_on_sample(docs)))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best 2,000 phrases; null text has no words, a null language is ``und``, repeated rows count each time."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned outside the held-out fold; null, empty and tokenless texts get the bias alone."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = language.in_fold(F.col("doc_id"), 5, 0)
    model = quality.fit_on_sample(docs.where(~held_out), labels.where(~held_out))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of five filters, step by step, in every source; null text is empty, a null source the empty string."""
    return filter_audit.interactions(filter_audit.failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


_COLLOCATIONS = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
totals as (select lang, cast(sum(len(w)) as bigint) as n from words group by lang),
starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from words),
grams as (select lang, m, array_to_string(w[i : i + m - 1], ' ') as phrase from starts, range(1, 6) r(m) where i + m - 1 <= len(w)),
counts as (select lang, m, phrase, count(*) as f from grams group by all having count(*) >= 100),
inner_of as (
  select lang, unnest([array_to_string(string_split(phrase, ' ')[1 : m - 1], ' '), array_to_string(string_split(phrase, ' ')[2 : m], ' ')]) as phrase, f from counts where m > 2),
kept as (select c.* from counts c where m > 1 and not exists (select 1 from inner_of x where x.lang = c.lang and x.phrase = c.phrase and 100 * x.f >= 100 * c.f)),
cuts as (select lang, phrase, f as a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') as p, array_to_string(string_split(phrase, ' ')[k + 1 : m], ' ') as q from kept, range(1, 5) r(k) where k < m),
scores as (
  select c.lang, c.phrase, c.a, c.k, l.f as l, r.f as r, t.n, cast((1000 * c.a::hugeint * t.n::hugeint) // (l.f::hugeint * r.f::hugeint) as bigint) as score
  from cuts c join counts l on l.lang = c.lang and l.phrase = c.p join counts r on r.lang = c.lang and r.phrase = c.q join totals t on t.lang = c.lang),
best as (select * from scores qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from best
qualify rank <= 2000"""

_FILTER_AUDIT = r"""
with docs as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
split as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by text) < doc_id as later from docs),
told as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
facts as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
     'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(later, false)} as f
  from split left join told using (doc_id)),
marked as (select part, good, toxic, concat(case when f.A then 'A' else '' end, case when f.B then 'B' else '' end, case when f.C then 'C' else '' end, case when f.D then 'D' else '' end, case when f.E then 'E' else '' end) as fails from facts),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (select filter_order, s as step, substr(filter_order, s, 1) as filter, substr(filter_order, 1, s - 1) as before from orders, range(1, 6) r(s)),
grouped as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from marked group by part, fails),
hit as (
  select *, contains(fails, filter) as failing, fails = '' or not regexp_matches(fails, '[' || before || filter || ']') as stays,
    before <> '' and regexp_matches(fails, '[' || before || '_]') as gone
  from grouped, steps),
summed as (
  select part, filter_order, step, filter,
    coalesce(sum(n) filter (stays), 0) as kept, coalesce(sum(n) filter (failing and not gone), 0) as removed,
    coalesce(sum(n) filter (failing and gone), 0) as redundant, coalesce(sum(n) filter (fails = filter), 0) as unique_fails,
    coalesce(sum(good) filter (failing and not gone), 0) as good_lost, coalesce(sum(toxic) filter (failing and not gone), 0) as toxic_lost
  from hit group by all)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, filter) as bigint) as shapley
from summed"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_repeats, op3_fingerprints, op4_decontamination, op5_near_duplicates, op6_token_files, op7_packing, op8_language, op9_toxicity, op10_personal_data, op11_collocations, op12_quality, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op11_collocations": _COLLOCATIONS, "op13_filter_audit": _FILTER_AUDIT}
