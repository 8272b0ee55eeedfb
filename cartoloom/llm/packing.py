"""Packing of token pieces into sequences by the sum-of-squares rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoloom.llm.common import arrow_rows, keyed_text, slices, stored, text_list
from cartoloom.llm.pieces import piece_ids

#: Pieces that are packed together.  What a group leaves open is a few bins, so the loss is a few in ten thousand.
GROUP = 1 << 14
#: Bits of a piece's key that number it within its task.
LOWER = 40


class SumOfSquares:
    """Open bins by residual gap; a piece goes where the sum of their squared counts becomes smallest.

    Moving a bin from gap g to gap g - s changes the sum by 2 (N[g-s] - N[g]) + 2, closing it changes it by 1 - 2 N[g],
    and a new bin adds 2 N[c-s] + 1.  Ties go to the smallest gap, to a new bin last.  Without ``eager`` a new bin is
    opened only where no open one has room.
    """

    def __init__(self, capacity: int, *, eager: bool = True) -> None:
        self.capacity, self.eager = capacity, eager
        self.n = np.zeros(capacity + 1, np.int64)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.bins = 0

    def place(self, size: int) -> tuple[int, int]:
        """Bin number and offset in it."""
        n, most = self.n, self.capacity
        if size < most:
            gaps = n[size:]
            change = 2 * (n[: most + 1 - size] - gaps) + 2
            change[0] = 1 - 2 * gaps[0]
            change[gaps == 0] = np.iinfo(np.int64).max
            best = int(change.argmin())
            if gaps[best] and not (self.eager and change[best] > 2 * n[most - size] + 1):
                gap = best + size
                number, offset = self.open[gap].pop()
                n[gap] -= 1
                self._keep(gap - size, number, offset + size)
                return number, offset
        number, self.bins = self.bins, self.bins + 1
        self._keep(most - size, number, size)
        return number, 0

    def _keep(self, gap: int, number: int, used: int) -> None:
        if gap:
            self.n[gap] += 1
            self.open[gap].append((number, used))

    def left_open(self) -> list[tuple[int, int]]:
        """Bins with room and what they hold, the fullest first."""
        return [b for bins in self.open for b in reversed(bins)]


def pack(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each piece.

    Pieces are placed largest first by the sum-of-squares rule, once with opening a bin as one more choice and once
    opening bins only where needed; the way with fewer bins stays.  Bins that early opening leaves open are put
    together as wholes wherever two or more fit in one.
    """
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    ways = []
    for eager in (True, False):
        first, second = SumOfSquares(capacity, eager=eager), SumOfSquares(capacity, eager=False)
        placed = [first.place(sizes[i]) for i in order]
        moved = {number: second.place(used) for number, used in first.left_open()}
        ways.append((first.bins - len(moved) + second.bins, first.bins, placed, moved))
    _, bins, placed, moved = min(ways, key=lambda w: w[0])
    where: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i, (number, offset) in zip(order, placed, strict=True):
        to = moved.get(number)
        where[i] = (bins + to[0], to[1] + offset) if to else (number, offset)
    return where


def _pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """``key, doc_id, piece, start, length, ids``; the key numbers the pieces of a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << LOWER
        coder, end = piece_ids(vocabulary), np.asarray([end_id], "<u4").tobytes()
        names = ("doc_id", "piece", "start", "length", "ids")
        for batch in slices(batches):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), coder.ids(text_list(batch)), strict=True):
                ids += end
                n = len(ids) // 4
                starts = [0, *range(n % capacity or capacity, n, capacity)]
                rows += [(doc, k, a, b - a, ids[4 * a : 4 * b]) for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True))]
            if rows:
                yield {"key": range(key, key + len(rows))} | dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))
                key += len(rows)

    return arrow_rows(docs, work, "key long, doc_id long, piece int, start long, length long, ids binary")


def _placed(pieces: DataFrame, capacity: int) -> DataFrame:
    """``key, sequence_id, offset``: pieces dealt in turn to groups of like size, each packed as one."""
    task, place = F.shiftright("key", LOWER), F.col("key").bitwiseAND((1 << LOWER) - 1)
    counts = sorted(tuple(r) for r in pieces.groupBy(task.alias("task")).count().collect())  # one row for each task
    groups, before, firsts = max(1, -(-sum(n for _, n in counts) // GROUP)), 0, []
    for number, n in counts:
        firsts.append((number, before % groups))
        before += n
    spark = pieces.sparkSession
    first = F.broadcast(spark.createDataFrame(firsts, "task long, first long"))
    dealt = pieces.select("key", F.col("length").cast("int").alias("length"), task.alias("task"), place.alias("place")).join(first, "task")
    dealt = dealt.select("key", "length", ((F.col("first") + F.col("place")) % groups).cast("int").alias("group"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        keys: list[int] = []
        sizes: list[int] = []
        now = None

        def done() -> dict:
            where = pack(sizes, capacity)
            return {"key": keys, "sequence_id": [now << 32 | b for b, _ in where], "offset": [o for _, o in where]}

        for batch in batches:
            for key, size, group in zip(*(batch.column(c).to_pylist() for c in ("key", "length", "group")), strict=True):
                if group != now:
                    if keys:
                        yield done()
                    keys, sizes, now = [], [], group
                keys.append(key)
                sizes.append(size)
        if keys:
            yield done()

    return arrow_rows(dealt.repartition(groups, "group").sortWithinPartitions("group", "key"), work, "key long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document as pieces in sequences of at most ``capacity`` tokens.

    Returns ``doc_id, piece, start, length, ids, sequence_id, offset``; ``ids`` holds little-endian unsigned
    32-bit ids.  A document is its ids and ``end_id``; a longer one is cut so that its first piece takes the
    remainder and all others are full.

    Pieces are written once to the shared folder.  Their lengths alone are dealt, in turn, to groups of about
    ``GROUP`` pieces, however the input was split, each group is packed in one task, and the places are joined to the
    pieces.  ``sequence_id`` is the group's number in its upper bits and the bin in its lower 32.

    Null text is an empty document (the end id only).  Repeated rows are packed once each.  An empty table gives
    no rows.  Other columns are neither read nor returned.
    """
    pieces = stored(_pieces(keyed_text(docs, id_col, text_col), vocabulary, capacity, end_id), compression="zstd")
    return pieces.join(_placed(pieces, capacity), "key").select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")


def digest(packed: DataFrame) -> DataFrame:
    """The packed pieces with a checksum in place of their ids."""
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
