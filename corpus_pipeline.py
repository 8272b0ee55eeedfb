"""From raw documents to packed sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.  All but the last return the
columns of ``documents``.  The stages' methods have no SQL; tests compare each with a plain version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoloom.llm import decontamination, language, near_duplicates, packing, personal_data
from cartoloom.llm.common import stored, table
from cartoloom.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in no known language (null, without letters, or ambiguous) go; ``lang`` becomes the predicted one."""
    model = language.fit_on_sample(docs)
    found = language.identify(docs.select(*COLUMNS), model, keep=True)
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & ~F.col("ambiguous"))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of least id."""
    return near_duplicates.deduplicate(docs).select(*COLUMNS)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly such passages go."""
    return _counted(decontamination.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become the name of their kind in brackets."""
    tagger = personal_data.fit_on_sample(docs)
    return _counted(personal_data.find(docs.select(*COLUMNS), tagger, keep=True))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left as pieces in sequences of 2048 tokens."""
    return packing.digest(packing.pack_documents(docs, vocabulary("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_text),
    ("personal data", mask_personal_data),
    ("packing", pack),
]

#: Language codes, Bayesian pruning, a trained tagger and packing can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
