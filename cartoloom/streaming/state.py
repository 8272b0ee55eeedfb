"""Keyed state and increments: the latest answer of every key, and pages that have changed since they were last seen."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartoloom.operators.sections import chunked


def latest_answers(records: DataFrame, *, keys: list[str], at: str, value: str) -> DataFrame:
    """The latest value of each key as updates: keys, at, value, ``seen`` (records so far).

    A record counts by its own time, not by when it arrives: one that is older than what is known changes only ``seen``;
    of equal times the greater value counts.  Null times and values never win.  State is one row for each key; a row comes
    out whenever the latest value changes, so the last row of a key is that of the batch twin
    (:func:`latest_batch`) whatever the order of arrival.
    """
    kinds = {f.name: f.dataType for f in records.schema}
    held = T.StructType([T.StructField("at", kinds[at]), T.StructField("value", kinds[value]), T.StructField("seen", T.LongType())])
    out = T.StructType([*[T.StructField(k, kinds[k]) for k in keys], T.StructField(at, kinds[at]), T.StructField(value, kinds[value]), T.StructField("seen", T.LongType())])

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        when, best, seen = state.get if state.exists else (None, None, 0)
        before = (when, best)
        for part in parts:
            seen += len(part)
            for t, v in part[[at, value]].dropna().itertuples(index=False):
                if when is None or (pd.Timestamp(t), v) > (pd.Timestamp(when), best):
                    when, best = pd.Timestamp(t).to_pydatetime(), v
        state.update((when, best, seen))
        if (when, best) != before:
            yield pd.DataFrame([[*key, when, best, seen]], columns=out.fieldNames())

    return records.select(*keys, at, value).groupBy(*keys).applyInPandasWithState(step, out, held, "update", "NoTimeout")


def latest_batch(records: DataFrame, *, keys: list[str], at: str, value: str) -> DataFrame:
    """Batch twin of :func:`latest_answers`: the last row of each key."""
    whole = F.when(F.col(at).isNotNull() & F.col(value).isNotNull(), F.struct(at, value))
    return records.groupBy(*keys).agg(F.max(whole).alias("x"), F.count("*").alias("seen")).where("x is not null").select(*keys, f"x.{at}", f"x.{value}", "seen")


def known_pages(spark: SparkSession, folder: str, *, before: int | None = None) -> DataFrame:
    """``url, digest, batch`` of the last increment that has each page; increments from ``before`` on are left out."""
    rows = spark.read.option("basePath", folder).schema("url string, digest string, batch long").parquet(folder)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return rows.groupBy("url").agg(F.max_by("digest", "batch").alias("digest"), F.max("batch").alias("batch"))


def changed_pages(pages: DataFrame, folder: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: writes the pages of a batch that are new or read otherwise than before to ``folder/batch=n``.

    pages: a schema with url, seen_at and html; of a page seen twice in a batch the later one counts.  What is compared is
    the digest of what a reader gets, so a page whose frame alone has changed is none.  The increments are the state: a
    batch that runs again after a failure reads only those before it and replaces its own, so nothing is lost or doubled.
    """
    wanted = {"url", "seen_at", "html"}
    if missing := wanted - set(pages.columns):
        raise ValueError(f"columns missing: {sorted(missing)}")

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.where("url is not null").groupBy("url").agg(F.max_by("html", "seen_at").alias("html"))
        read = chunked(last, key="url", source="html")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            read = read.join(known_pages(spark, folder, before=number).select("url", "digest"), ["url", "digest"], "left_anti")
        read.select("url", "digest", "title", "h1", "chunks", "lists", "types", "words").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return run
