"""Paged datasets: saved pages as rows, the ranges no page covers, and a source that fetches ranges of pages in tasks."""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def page_rows(pages: DataFrame, item: str, *, body: str = "body") -> DataFrame:
    """``dataset, offset, total, n`` and the fields of each item of saved pages, each place of a dataset once.

    pages: the JSON of each page: dataset, offset, total, items (objects of the given schema).  Pages that can't be read
    have no rows; of pages that overlap the first read place counts, by page offset, the last fetch by ``fetched`` where
    that field is there.
    """
    page = F.from_json(body, f"dataset string, offset long, total long, fetched long, items array<struct<{item}>>")
    rows = pages.select(page.alias("p")).where("p.items is not null").select("p.dataset", "p.offset", "p.total", F.coalesce("p.fetched", F.lit(0)).alias("fetched"), F.posexplode("p.items").alias("i", "item"))
    place = F.col("offset") + F.col("i")
    best = rows.select("dataset", place.alias("n"), F.struct((-F.col("fetched")).alias("f"), F.col("offset"), "total", "item").alias("x")).groupBy("dataset", "n").agg(F.min_by("x", F.struct("x.f", "x.offset")).alias("x"))
    return best.select("dataset", "n", "x.offset", "x.total", "x.item.*")


def missing_ranges(pages: DataFrame, *, body: str = "body") -> DataFrame:
    """``dataset, start, end``: ranges of a dataset that no saved page covers, the end exclusive; to be fetched again."""
    page = F.from_json(body, "dataset string, offset long, total long, items array<string>")
    spans = pages.select(page.alias("p")).where("p.items is not null").select("p.dataset", F.col("p.offset").alias("start"), (F.col("p.offset") + F.size("p.items")).alias("end"), "p.total")
    w = Window.partitionBy("dataset").orderBy("start", "end")
    reached = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = spans.withColumn("reached", reached).where("start > reached").select("dataset", F.col("reached").alias("start"), F.col("start").alias("end"))
    rest = spans.groupBy("dataset").agg(F.max("end").alias("start"), F.max("total").alias("end")).where("end > start")
    return inner.unionByName(rest)


class PageRange(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class PagedSource(DataSource):
    """``spark.read.format("paged")``: items of a paged service, a partition for each range of pages.

    Options: fetch (``module:function`` of offset, limit and key, that gives a list of dicts, importable in the tasks),
    key, total, page (items a page, 100), range (pages a partition, 10), tries (3), wait (seconds before the second try,
    1, doubled each time).  The schema is given.  A range ends at a short page; a page that fails all its tries fails its task,
    which Spark runs again.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise ValueError("give the schema of the items")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagedReader(schema, dict(self.options))


class _PagedReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.names, self.options = schema.fieldNames(), {k.lower(): v for k, v in options.items()}
        self.size = int(self.options.get("page", 100))

    def partitions(self) -> list[PageRange]:
        step = self.size * int(self.options.get("range", 10))
        total = int(self.options["total"])
        return [PageRange(k, min(total, k + step)) for k in range(0, total, step)] or [PageRange(0, 0)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        module, _, function = self.options["fetch"].partition(":")
        fetch = getattr(importlib.import_module(module), function)
        for offset in range(partition.first, partition.last, self.size):
            limit = min(self.size, partition.last - offset)
            items = self._tried(fetch, offset, limit)
            for x in items:
                yield tuple(x.get(n) for n in self.names)
            if len(items) < limit:
                return

    def _tried(self, fetch, offset: int, limit: int) -> list[dict]:
        wait, tries = float(self.options.get("wait", 1)), int(self.options.get("tries", 3))
        for k in range(tries):
            try:
                return fetch(offset, limit, self.options.get("key", ""))
            except Exception:  # the service's errors are its own
                if k == tries - 1:
                    raise
                time.sleep(wait * 2**k)
        return []


def replay(offset: int, limit: int, key: str) -> list[dict]:
    """A service played back from a file of one JSON item a line, named by the key."""
    with open(key) as lines:
        return [json.loads(line) for n, line in enumerate(lines) if offset <= n < offset + limit]


def register(spark) -> None:
    """Makes the format ``paged`` known to a session."""
    spark.dataSource.register(PagedSource)
