"""Ranking: BM25, shortlists, cosine neighbours, contrast of phrases."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartoloom.operators.graph import settled


def term_counts(docs: DataFrame, key: str, words: str) -> DataFrame:
    """``key, term, tf``."""
    return docs.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, *, doc_key: str, query_key: str, words: str = "words", k1: float = 1.2, b: float = 0.75, damp_query: bool = True, k: int | None = 12, most_terms: int = 1_000_000) -> DataFrame:
    """``query_key, doc_key, score, rank`` with positive scores, best first, ties by document.

    The corpus is read once: postings of query terms alone, cut by a semi-join before anything is summed, go to a table
    from which document frequencies and scores are taken.  The queries are broadcast where their terms are no more than
    ``most_terms`` (a million), else shuffled, with the same rows; scores are then summed where a document's postings are.  With ``damp_query`` a term counts 1 + ln of its frequency in the query, else once.  Scores are
    rounded to six places before ranking, so that the order of summation cannot change ranks.
    """
    asked = settled(term_counts(queries, query_key, words).withColumnRenamed("tf", "qtf"))
    near = F.broadcast if asked.count() <= most_terms else lambda frame: frame
    # one pass over the documents: the empty term stands for the document itself, its length travels with its words
    every = docs.select(doc_key, F.size(words).cast("double").alias("len"), F.explode(F.concat(words, F.array(F.lit("")))).alias("term"))
    wanted = asked.select("term").where("term <> ''").distinct().unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term")))
    stored = settled(every.join(near(wanted), "term", "left_semi").groupBy(doc_key, "len", "term").agg(F.count("*").alias("tf")))
    total = stored.where("term = ''").agg(F.sum("tf").alias("n"), (F.sum(F.col("len") * F.col("tf")) / F.sum("tf")).alias("mean"))
    postings = stored.where("term <> ''")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    times = 1 + F.log("qtf") if damp_query else F.lit(1.0)
    part = weight * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean"))) * times
    # of one document all postings are in one task, so sums are made there
    scored = postings.repartition(doc_key).join(near(asked.join(near(df), "term")), "term").crossJoin(F.broadcast(total))  # total is one row
    out = scored.groupBy(query_key, doc_key).agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    if k is None:
        return out
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), doc_key))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def hit_rates(shortlists: DataFrame, truth: DataFrame, keys: list[str], cuts: tuple[int, ...] = (5, 10, 25)) -> DataFrame:
    """Share of true pairs that the ranked shortlists hold within each cut."""
    met = truth.join(shortlists.select(*keys, "rank"), keys, "left")
    return met.agg(F.count("*").alias("pairs"), *[F.round(F.avg(F.coalesce((F.col("rank") <= c).cast("double"), F.lit(0.0))), 6).alias(f"hit_{c}") for c in cuts])


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def unit(v):
    size = F.sqrt(dot(v, v))
    return F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(F.transform(v, lambda x: x.cast("double")))


#: Vectors of one cell, and anchors of one cell.
VECTORS, ANCHORS = 8192, 2048


def _nearest(floor: float, k: int) -> Callable[[pa.Table], pa.Table]:
    """The k nearest of a cell's anchors among its other rows, by matrix products of 128 anchors at a time."""

    def matrix(rows: pa.Table) -> np.ndarray:
        v = rows["v"].combine_chunks()
        v = np.concatenate([x.flatten().to_numpy() for x in getattr(v, "chunks", [v])]).reshape(len(rows), -1)
        return v

    def run(cell: pa.Table) -> pa.Table:
        own = cell["own"].to_numpy()
        left, right = cell.filter(pa.array(own)), cell.filter(pa.array(~own))
        out = []
        if left.num_rows and right.num_rows:
            (u, v), (anchor, other) = (matrix(x) for x in (left, right)), (x["id"].to_numpy() for x in (left, right))
            order = np.argsort(other, kind="stable")
            v, other = v[order], other[order]
            for lo in range(0, len(u), 128):
                exact = u[lo : lo + 128] @ v.T
                cosine = np.copysign(np.floor(np.abs(exact) * 1e6 + 0.5), exact) / 1e6  # halves away from zero
                for id_, row in zip(anchor[lo : lo + 128], cosine, strict=True):
                    hit = np.flatnonzero(((row >= floor) | np.isnan(row)) & (other != id_))
                    value = np.where(np.isnan(row[hit]), np.inf, row[hit])
                    if len(hit) > k:  # those below the k-th are out; equal ones stay in the order of their ids
                        least = np.partition(value, len(hit) - k)[len(hit) - k]
                        hit, value = hit[value >= least], value[value >= least]
                        hit = hit[np.argsort(-value, kind="stable")[:k]]
                    out.append((np.full(len(hit), id_), other[hit], row[hit]))
        a, o, c = (np.concatenate([x[n] for x in out]) if out else np.array([], kind) for n, kind in enumerate((np.int64, np.int64, np.float64)))
        return pa.table({"anchor": pa.array(a, pa.int64()), "other": pa.array(o, pa.int64()), "cosine": pa.array(c, pa.float64())})

    return run


def neighbours(vectors: DataFrame, anchors: DataFrame, *, key: str, block: str, vector: str, floor: float = 0.5, k: int = 10) -> DataFrame:
    """The k nearest of every anchor within its block by cosine, from a floor on; ties by key (a whole number).

    A stated set of anchors against all rows of the same block.  A block's anchors and vectors are dealt to parts, of
    which every two meet in a cell that keeps the k best of each anchor; the best of all cells are ranked.  Vectors of
    different lengths or with nulls have no cosine.
    """

    def rows(frame: DataFrame) -> DataFrame:
        v = frame.select(F.col(key).cast("long").alias("id"), F.col(block).alias("block"), F.size(vector).alias("dims"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
        return v.where(F.col("id").isNotNull() & F.col("block").isNotNull() & (F.col("dims") > 0) & ~F.exists("v", lambda x: x.isNull())).select("id", "block", "dims", unit(F.col("v")).alias("v"))

    right, left = settled(rows(vectors)), settled(rows(anchors))
    parts = lambda frame, most: max(1, -(-int(frame.groupBy("block", "dims").count().agg(F.max("count")).first()[0] or 0) // most))
    across, down = parts(right, VECTORS), parts(left, ANCHORS)
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = right.select("*", F.lit(False).alias("own"), part(across).alias("x"), every(down).alias("y")).unionByName(left.select("*", F.lit(True).alias("own"), every(across).alias("x"), part(down).alias("y")))
    tasks = 8 * vectors.sparkSession.sparkContext.defaultParallelism
    dealt = cells.repartition(tasks, "block", "dims", "x", "y")
    best = dealt.groupBy("block", "dims", "x", "y").applyInArrow(_nearest(floor, k), "anchor long, other long, cosine double")
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("cosine"), "other"))
    kind = dict(vectors.dtypes)[key]
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("anchor").cast(kind).alias("anchor"), F.col("other").cast(kind).alias("other"), "cosine", "rank")


def log_odds(counts: DataFrame, *, term: str = "term", positive: str = "y_pos", negative: str = "y_neg", n_pos, n_neg, alpha: float = 0.5, least: int = 2) -> DataFrame:
    """z-score of each term's log-odds between two sides under an informative Dirichlet prior.

    counts: a row for each term with the texts of either side that hold it.  n_pos, n_neg: texts of each side, numbers or
    columns of counts.
    """
    n_pos, n_neg = (F.col(x) if isinstance(x, str) else F.lit(x) for x in (n_pos, n_neg))
    total = counts.agg(F.sum(F.col(positive) + F.col(negative)).alias("total"), F.count("*").alias("terms"))
    y, m = F.col(positive), F.col(negative)
    a0 = F.col("terms") * alpha
    a = a0 * (y + m) / F.col("total")

    def side(hits, n):
        return F.log((hits + a) / (F.greatest(n, hits) + a0 - hits - a))

    z = (side(y, n_pos) - side(m, n_neg)) / F.sqrt(1 / (y + a) + 1 / (m + a))
    return counts.crossJoin(F.broadcast(total)).select(term, positive, negative, F.round(z, 6).alias("z")).where(F.col(positive) + F.col(negative) >= least)
