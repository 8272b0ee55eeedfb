"""Context-triggered piecewise hashing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoloom.llm.common import arrow_rows, keyed_text, settled, slices, text_list
from cartoloom.llm.hashing import BACK, BASE, power_table

#: Bytes of the rolling window, the smallest block (as a power of two) and the most chunks of a signature.
WINDOW, LEAST_BITS, MOST_CHUNKS = 7, 2, 64
#: Two signatures count as related only if they share a run of this many chunks (where both have as many).
COMMON_RUN = 7
#: Characters of a text that take part in dealing out rows of equal ids.
HEAD = 64
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)
_ROLL = np.array([pow(0x9E3779B1, k + 1, 1 << 32) for k in range(WINDOW)], np.uint32)


def fingerprint(text: str) -> str:
    """``block:signature:signature of the doubled block``.

    A hash rolls over the last seven bytes; a chunk ends where its value ends in as many zero bits as the block
    size has.  The block is the smallest power of two that leaves at most 64 chunks.  Each chunk, the unfinished
    last one too, adds one of 64 letters.  The empty text has empty signatures.
    """
    data = np.frombuffer(text.encode(), np.uint8)
    n = len(data)
    if not n:
        return f"{1 << LEAST_BITS}::"
    wide = data.astype(np.uint32) + np.uint32(1)
    roll = wide * _ROLL[0]
    for k in range(1, min(WINDOW, n)):
        roll[k:] += wide[:-k] * _ROLL[k]
    roll ^= roll >> np.uint32(15)
    roll *= np.uint32(0x85EBCA6B)
    roll ^= roll >> np.uint32(13)
    ends = np.flatnonzero((roll & np.uint32((1 << LEAST_BITS) - 1)) == 0)
    value = roll[ends].astype(np.int64) | (1 << 40)
    zeros = np.log2(value & -value).astype(np.int64)
    bits = LEAST_BITS
    while np.count_nonzero(zeros >= bits) >= MOST_CHUNKS:
        bits += 1
    weighted = (data.astype(np.uint64) + np.uint64(1)) * power_table(BASE, n)
    out = []
    for b in (bits, bits + 1):
        stops = ends[zeros >= b] + 1
        starts = np.concatenate([[0], stops[stops < n]]).astype(np.int64)
        total = np.add.reduceat(weighted, starts) * power_table(BACK, n)[starts]  # wherever the chunk stands
        total ^= total >> np.uint64(29)
        total *= np.uint64(0x9E3779B97F4A7C15)
        out.append(_LETTERS[(total >> np.uint64(58)).astype(np.int64)].tobytes().decode())
    return f"{1 << bits}:{out[0]}:{out[1]}"


def _runs(signature: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(signature) - (COMMON_RUN - 1)), lambda i: F.substr(signature, i, F.lit(COMMON_RUN)))


def _alike(a: Column, b: Column) -> Column:
    longer, shorter = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    near = F.lit(1.0) - F.levenshtein(a, b) / longer
    related = F.when(shorter >= COMMON_RUN, F.arrays_overlap(_runs(a), _runs(b))).otherwise(F.lit(True))
    return F.when(longer == 0, F.lit(1.0)).when(related, near).otherwise(F.lit(0.0))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two fingerprints; 0 where their blocks differ by more than one doubling, null where one is null."""
    x, y = F.split(a, ":"), F.split(b, ":")
    p, q = x[0].cast("long"), y[0].cast("long")
    return (
        F.when(a == b, F.lit(1.0))
        .when(p == q, F.greatest(_alike(x[1], y[1]), _alike(x[2], y[2])))
        .when(p == 2 * q, _alike(x[1], y[2]))
        .when(2 * p == q, _alike(x[2], y[1]))
        .when(p.isNotNull() & q.isNotNull(), F.lit(0.0))
    )


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every whole text; null counts as empty, repeated rows give one row each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches):
            yield {"doc_id": batch.column("doc_id"), "fingerprint": [fingerprint(t) for t in text_list(batch)]}

    return arrow_rows(keyed_text(docs, id_col, text_col), work, "doc_id long, fingerprint string")


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document, itself with its last half replaced by the next one's beginning, and the next document.

    Next is by descending id (nulls last, equal ids by text), after the last the first.  Documents are dealt out by
    ranges of the id and the text's beginning, so a hot id or many null ids are split, and sorted; a task sees its neighbours in one pass and keeps one row.  The last row of each
    task meets the first row of the next in a join of as many rows as there are tasks.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint``.  Null text counts
    as empty; one document is its own next; an empty table gives no rows.
    """
    order = [F.desc_nulls_last("doc_id"), F.desc_nulls_last("text")]
    own = keyed_text(docs, id_col, text_col).withColumn("head", F.substring("text", 1, HEAD))
    ordered = own.repartitionByRange(order[0], F.desc_nulls_last("head")).drop("head").sortWithinPartitions(*order)

    def row(key, text, own, following, their):
        edited = _edited(text, following)
        return (key, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, fingerprint(edited), their)

    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint")

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        task, first, last = TaskContext.get().partitionId(), None, None
        blank = (None,) * 6
        for batch in slices(batches, 256):
            rows = []
            for key, text in zip(batch.column("doc_id").to_pylist(), text_list(batch), strict=True):
                own = fingerprint(text)
                if last is None:
                    first = (text, own)
                else:
                    rows.append((*row(*last, text, own), task, None, None, None))
                last = (key, text, own)
            if rows:
                yield dict(zip((*names, "task", "head", "head_print", "tail"), zip(*rows, strict=True), strict=True))
        if last:
            end = (last[0], None, None, last[2], None, None, task, first[0], first[1], last[1])
            assert len(end) == len(blank) + 4
            yield dict(zip((*names, "task", "head", "head_print", "tail"), ([x] for x in end), strict=True))

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"
    rows = settled(arrow_rows(ordered, neighbours, schema + ", task int, head string, head_print string, tail string"))
    ends = rows.where(F.col("tail").isNotNull())
    tasks = sorted(r.task for r in ends.select("task").collect())
    spark = docs.sparkSession
    after = spark.createDataFrame(list(zip(tasks, tasks[1:] + tasks[:1], strict=True)), "task int, following int")
    heads = ends.select(F.col("task").alias("following"), F.col("head").alias("next_text"), F.col("head_print").alias("next_print"))
    tails = ends.select("task", "doc_id", "tail", "fingerprint").join(after, "task").join(heads, "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            got = [row(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tail", "fingerprint", "next_text", "next_print")), strict=True)]
            if got:
                yield dict(zip(names, zip(*got, strict=True), strict=True))

    return rows.where(F.col("tail").isNull()).select(*names).unionByName(arrow_rows(tails, finish, schema))


def compare_edited(docs: DataFrame, **columns) -> DataFrame:
    """The fingerprints of each document and its edited text, with their likeness."""
    rows = edited_fingerprints(docs, **columns)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )

