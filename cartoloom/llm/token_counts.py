"""Token counts without materialising ids."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoloom.llm.common import arrow_rows, keyed_text, slices, stored, text_list
from cartoloom.llm.pieces import piece_counts

#: Distinct pre-tokens that a task holds before it passes them on.
HELD = 400_000
#: Bytes of the frequent pre-tokens that every task gets, at most.
MOST_BYTES = 16 << 20


def piece_table(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``chunk, n, pieces``: every distinct pre-token of the texts, how often it occurs, and its pieces, counted once."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        coder, seen = piece_counts(vocabulary), Counter()
        for batch in slices(batches):
            for text in text_list(batch):
                seen.update(coder.frequencies(text) or ())
            if len(seen) > HELD:
                yield {"chunk": list(seen), "n": list(seen.values())}
                seen = Counter()
        if seen:
            yield {"chunk": list(seen), "n": list(seen.values())}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {c: batch.column(c) for c in ("chunk", "n")} | {"pieces": piece_counts(vocabulary).counts(batch.column("chunk").to_pylist())}

    found = arrow_rows(docs, distinct, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    return stored(arrow_rows(found, count, "chunk string, n long, pieces int"))


def most_frequent(pieces: DataFrame, most: int) -> DataFrame:
    """``chunk, pieces`` of the pre-tokens from a frequency on, at most so many and at most ``MOST_BYTES`` of text.

    Frequencies fall into steps of a sixteenth of a doubling; as many of the upper steps are taken as fit.  Length does
    not matter: a long line without blanks that stands in every document is taken like a short word.  In a step that
    does not fit, the pre-tokens beyond a thousandth of ``MOST_BYTES`` are left to the shuffled join.  Only the steps'
    sums and the rows taken ever reach the driver, however many tasks there are.
    """
    step, long = F.floor(F.log2("n") * 16).cast("int"), F.octet_length("chunk") > MOST_BYTES // 1000
    sums = pieces.groupBy(step.alias("step"), long.alias("long")).agg(F.count("*").alias("rows"), F.sum(F.octet_length("chunk")).alias("bytes")).collect()
    rows, size, kept = 0, 0, []
    for r in sorted(sums, key=lambda r: (-r.step, r.long)):  # two thousand rows at most
        if rows + r.rows <= most and size + r.bytes <= MOST_BYTES:
            rows, size = rows + r.rows, size + r.bytes
            kept.append((r.step, r.long))
        elif not r.long:
            break
    known = F.array(*[F.struct(F.lit(a).alias("step"), F.lit(b).alias("long")) for a, b in kept]) if kept else None
    return pieces.where(F.array_contains(known, F.struct(step.alias("step"), long.alias("long"))) if kept else F.lit(False)).select("chunk", "pieces")


def count_tokens(docs: DataFrame, vocabulary: str, *, max_tokens: int = 2048, frequent: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: ``doc_id, n_bytes, n_tokens, over_limit``.

    First the distinct pre-tokens of all texts are gathered (tasks pass on each one once) and the pieces of each are
    counted once.  Then each document's pre-token frequencies are joined to that table and summed.  Up to ``frequent``
    of the most frequent pre-tokens travel to every task, so that no hot key is shuffled; the rest of a document's
    frequencies, rare by construction, meet the table in a shuffled join.  Both ways give the same sums.

    Null text counts as empty (0 bytes, 0 tokens).  Repeated rows and repeated or null ids give one row each.
    An empty table gives no rows.  Other columns are neither read nor returned.
    ``vocabulary`` is a path that every executor can read.
    """
    own = keyed_text(docs, id_col, text_col)
    pieces = piece_table(own.select("text"), vocabulary)
    known = {r.chunk: r.pieces for r in most_frequent(pieces, frequent).collect()}  # bounded by the parameter

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        coder, row = piece_counts(vocabulary), TaskContext.get().partitionId() << 40
        get = known.get
        for batch in slices(batches):
            texts, sums, rest = text_list(batch), [], []
            for text in texts:
                freq = coder.frequencies(text)
                if freq is None:
                    sums.append(coder.whole(text))
                    rest.append([])
                    continue
                by = list(map(get, freq))
                if None in by:
                    rest.append([{"chunk": c, "n": n} for (c, n), p in zip(freq.items(), by, strict=True) if p is None])
                    by = [p or 0 for p in by]
                else:
                    rest.append([])
                sums.append(sum(map(int.__mul__, by, freq.values())))
            yield {
                "row": range(row, row + len(texts)),
                "doc_id": batch.column("doc_id"),
                "n_bytes": [len(t.encode()) for t in texts],
                "known": sums,
                "rest": rest,
            }
            row += len(texts)

    parts = stored(arrow_rows(own, join, "row long, doc_id long, n_bytes long, known long, rest array<struct<chunk:string,n:long>>"))
    rare = parts.select("row", F.explode("rest").alias("x")).select("row", "x.chunk", "x.n").join(pieces.select("chunk", "pieces"), "chunk")
    sums = rare.groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("rare"))
    total = F.col("known") + F.coalesce("rare", F.lit(0))
    return parts.drop("rest").join(sums, "row", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > max_tokens).alias("over_limit"))
