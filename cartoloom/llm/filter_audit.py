"""What each filter removes in every order of the filters, by packed bitmaps."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartoloom.llm.common import arrow_rows, slices, stored, text_list

FILTERS = "ABCDE"
_CAPITALS, _SIGNS = bytes(range(65, 91)), re.compile(r"[#$%&*|]")
#: Rows that one set of bitmaps covers, and keys that may be hot (each holds at least this share of all rows).
ROWS, HOT = 1 << 19, 1000


def text_failures(text: str) -> int:
    """Bits of the filters A to D that a text fails: few words, repeated words, capitals, signs."""
    data = text.encode()
    words = data.split()  # of bytes: blanks and the bytes 9 to 13
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 2 * len(text)) << 2 | bool(_SIGNS.search(text)) << 3


def looked_up(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` with what ``keys`` (one row a key) has for them, null elsewhere, whatever a key's share of the rows.

    Keys with at least a thousandth of the rows are a thousand at most: they are broadcast.  Null keys meet nothing.
    """
    total = rows.count()
    counted = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("of_key"))
    hot = stored(counted.where(F.col("of_key") * HOT >= total).select(key))
    lone = rows.where(F.col(key).isNull())
    for c in keys.columns:
        if c != key:
            lone = lone.withColumn(c, F.lit(None).cast(keys.schema[c].dataType))
    known = rows.where(F.col(key).isNotNull())
    often = known.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(keys.join(F.broadcast(hot), key, "left_semi")), key, "left")
    rare = known.join(F.broadcast(hot), key, "left_anti").join(keys, key, "left")
    return often.unionByName(rare).unionByName(lone)


def failures(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, fails, good, toxic`` of each row: the bits of the filters it fails, and its labels.

    Filter E: the text is also that of a smaller id, anywhere in the table.  Null text is empty, a null part is the empty
    string; a null id is no smaller than any other, has none smaller and no labels.  A row of equal id and text is no
    copy.  A document is good or toxic if any of its label rows says so.
    """
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches):
            texts = text_list(batch)
            yield {"doc_id": batch.column("doc_id"), "part": batch.column("part"), "fails": [text_failures(t) for t in texts], "digest": [hashlib.sha256(t.encode()).digest() for t in texts]}

    facts = stored(arrow_rows(own, read, "doc_id long, part string, fails int, digest binary"))
    firsts = facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    told = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"))
    told = told.agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))]).where("good or toxic")
    whole = looked_up(looked_up(facts, stored(firsts), "digest"), stored(told), "doc_id")
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).cast("int")
    return whole.select("part", F.col("fails").bitwiseOR(F.shiftleft(copy, 4)).alias("fails"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


class Bitmaps:
    """Packed bits of rows sorted by part: each part begins at a new 64-bit word."""

    def __init__(self, part: np.ndarray, fails: np.ndarray, good: np.ndarray, toxic: np.ndarray, filters: int) -> None:
        order = np.argsort(part, kind="stable")
        rows = np.bincount(part)
        words = -(-rows // 64)
        self.starts = np.cumsum(words) - words
        at = np.arange(len(part)) + np.repeat(64 * self.starts - (np.cumsum(rows) - rows), rows)
        self.size = 64 * int(words.sum())
        place = lambda bits: self._packed(at, bits[order])
        self.alive, self.good, self.toxic = place(np.ones(len(part), bool)), place(good), place(toxic)
        self.fails = [place((fails >> f) & 1 > 0) for f in range(filters)]

    def _packed(self, at: np.ndarray, bits: np.ndarray) -> np.ndarray:
        row = np.zeros(self.size, bool)
        row[at] = bits
        return np.packbits(row, bitorder="little").view(np.uint64)

    def count(self, bits: np.ndarray) -> np.ndarray:
        """Set bits of each part."""
        return np.add.reduceat(np.bitwise_count(bits).astype(np.int64), self.starts)

    def prefixes(self) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """For each set of earlier filters and each filter after it: kept, removed, good and toxic ones removed, by part."""
        n = len(self.fails)
        for before in range(1 << n):
            alive = self.alive
            for f in range(n):
                if before >> f & 1:
                    alive = alive & ~self.fails[f]
            for f in range(n):
                if not before >> f & 1:
                    gone = alive & self.fails[f]
                    yield before, f, [self.count(x) for x in (alive & ~self.fails[f], gone, gone & self.good, gone & self.toxic)]


def prefix_counts(rows: DataFrame, filters: int) -> DataFrame:
    """``part, before, filter, kept, removed, good_lost, toxic_lost`` for every set of earlier filters (as bits)."""
    counts = ("kept", "removed", "good_lost", "toxic_lost")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        def flush(held: list[pa.RecordBatch]) -> Iterator[dict]:
            t = pa.Table.from_batches(held)
            part = t.column("part").combine_chunks().dictionary_encode()
            maps = Bitmaps(*[np.asarray(x) for x in (part.indices, t.column("fails"), t.column("good"), t.column("toxic"))], filters)
            for before, f, got in maps.prefixes():
                n = len(part.dictionary)
                yield {"part": part.dictionary, "before": [before] * n, "filter": [f] * n} | dict(zip(counts, got, strict=True))

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= ROWS:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    schema = "part string, before int, filter int, " + ", ".join(f"{c} long" for c in counts)
    return arrow_rows(rows, count, schema).groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in counts])


def interactions(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every order of the filters, step by step, in every part.

    rows: ``part, fails, good, toxic`` as of :func:`failures` or made from other filters.  Returns ``part, filter_order,
    step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``; the last is what the step's filter
    removes, summed over all orders.  No rows give no rows.
    """
    n, spark = len(filters), rows.sparkSession
    by_set = prefix_counts(rows, n)
    own = Window.partitionBy("part", "filter")
    weight = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)]), F.bit_count("before").cast("int") + 1)
    at = lambda bits: F.max(F.when(F.col("before") == bits, F.col("removed"))).over(own)
    rest = F.lit((1 << n) - 1) - F.expr("shiftleft(1, filter)")
    steps = by_set.select("*", (at(F.lit(0)) - F.col("removed")).alias("redundant"), at(rest).alias("unique_fails"), F.sum(F.col("removed") * weight).over(own).cast("long").alias("shapley"))
    orders = [("".join(filters[f] for f in p), k + 1, sum(1 << f for f in p[:k]), f) for p in itertools.permutations(range(n)) for k, f in enumerate(p)]
    table = spark.createDataFrame(orders, "filter_order string, step int, before int, filter int")  # n! n rows
    return steps.join(F.broadcast(table), ["before", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
