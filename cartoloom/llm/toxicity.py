"""Toxicity by the nearest labelled examples under exact TF-IDF cosine."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoloom.llm.common import arrow_rows, keyed_text, slices, text_list

_WORD = re.compile(r"[^\W\d_]+")
#: Examples in a block of the index, and those that vote.
BLOCK, NEAREST = 64, 15
#: Half the weight of a term goes once its chi-square against the labels falls to this; no term is left out.
HALF = 20.0


def frequencies(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


_built: dict[str, tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = {}


class BlockMaxIndex:
    """Inverted index of unit vectors in blocks of examples, with the largest weight of each term in each block.

    A block holds the postings of the terms that occur in it, as one row of weights for each term.  The largest weights
    bound what any example of a block can score.  Blocks are visited by falling bound until it is no more than the
    worst score kept, so the result is that of a full scan.
    """

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], terms: int) -> None:
        # what travels to the tasks is the vectors; each worker process puts its index together once
        self.key, self.size, self.terms = uuid.uuid4().hex, len(rows), terms
        self.starts = np.cumsum([0, *(len(t) for t, _ in rows)])
        self.ids = np.concatenate([t for t, _ in rows], dtype=np.int32, casting="unsafe") if rows else np.zeros(0, np.int32)
        self.values = np.concatenate([w for _, w in rows]) if rows else np.zeros(0, np.float32)
        self.visited = 0

    def blocks(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Largest weights (term by block), a term's row in each block (0 for none), and the blocks' postings."""
        if self.key not in _built:
            if len(_built) > 1:
                _built.clear()
            _built[self.key] = self._build()
        return _built[self.key]

    def _build(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        n = -(-max(1, self.size) // BLOCK)
        most, at, postings = np.zeros((self.terms, n), np.float32), np.zeros((self.terms, n), np.int32), []
        for b in range(n):
            first, last = b * BLOCK, min(self.size, (b + 1) * BLOCK)
            own = slice(self.starts[min(first, self.size)], self.starts[last])
            there, row = np.unique(self.ids[own], return_inverse=True)
            weights = np.zeros((len(there) + 1, BLOCK), np.float32)
            weights[row + 1, np.repeat(np.arange(last - first), np.diff(self.starts[first : last + 1]))] = self.values[own]
            at[there, b] = np.arange(1, len(there) + 1)
            most[there, b] = weights[1:].max(1) if len(there) else 0
            postings.append(weights)
        return most, at, postings

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples with any term in common; ties by number."""
        most, at, postings = self.blocks()
        bound, rows = weights @ most[terms], at[terms].T
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.float32)
        for b in np.argsort(-bound, kind="stable").tolist():
            worst = scores[k - 1] if len(scores) >= k else 0.0
            if bound[b] <= 0 or bound[b] < worst - 1e-6:
                break
            self.visited += 1
            there = np.flatnonzero(rows[b])
            s = weights[there] @ postings[b][rows[b, there]]
            got = np.flatnonzero((s > 0) & (s >= worst))
            if not len(got):
                continue
            ids, scores = np.append(ids, got + b * BLOCK), np.append(scores, s[got])
            if len(ids) > k:
                order = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[order], scores[order]
        order = np.lexsort((ids, -scores))
        return ids[order], scores[order]


@dataclass
class ToxicityModel:
    """Terms with their weights, the index of examples, their labels and ids, and the calibration."""

    terms: dict[str, int]
    weight: np.ndarray
    index: BlockMaxIndex
    labels: np.ndarray
    ids: np.ndarray
    curve: np.ndarray
    without: float

    def vector(self, f: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Known terms and their weights, of unit length."""
        get = self.terms.get
        at = np.array([get(w, -1) for w in f], np.int64)
        known = at >= 0
        at, n = at[known], np.fromiter(f.values(), np.float64, len(f))[known]
        raw = (1 + np.log(n)) * self.weight[at]
        return at, (raw / (np.sqrt(raw @ raw) or 1.0)).astype(np.float32)

    def votes(self, ids: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        """Share of the label among the nearest, weighted by closeness, and their mean closeness."""
        w = 1 / (1.05 - np.minimum(cosines, 1.0))
        return np.array([float((w * self.labels[ids]).sum() / w.sum()), float(cosines.mean()), 1.0])

    def score(self, f: Counter) -> tuple[float, np.ndarray, np.ndarray]:
        terms, weights = self.vector(f)
        if not len(terms) or not self.index.size:
            return self.without, np.zeros(0, np.int64), np.zeros(0)
        ids, cosines = self.index.nearest(terms, weights, NEAREST)
        if not len(ids):
            return self.without, ids, cosines
        return float(1 / (1 + np.exp(-np.clip(self.votes(ids, cosines) @ self.curve, -30, 30)))), ids, cosines


def term_weights(counts: list[Counter], labels: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Every term of the examples with its weight: the inverse document frequency, less where the label doesn't show.

    A term whose presence has nothing to do with the label keeps a small part of its idf only, by its chi-square over
    the sample: x / (x + HALF).  Without that, topics rather than tone decide which examples are near.
    """
    n, positive = len(counts), float(labels.sum())
    both, all_ = Counter(), Counter()
    for f, y in zip(counts, labels, strict=True):
        all_.update(f.keys())
        if y:
            both.update(f.keys())
    names = sorted(all_)
    m, a = np.array([all_[w] for w in names], float), np.array([both[w] for w in names], float)
    base = m * (n - m) * positive * (n - positive)
    cross = a * (n - m - positive + a) - (m - a) * (positive - a)
    chi = np.where(base > 0, n * cross**2 / np.maximum(base, 1e-9), 0.0)
    return names, (np.log((1 + n) / (1 + m)) + 1) * (chi + 0.1) / (chi + 0.1 + HALF)


def fit(texts: list[str], labels: list[int], ids: list[int], prior: float) -> ToxicityModel:
    """Index the examples and calibrate votes, each example asked without itself, to the share of label 1."""
    y = np.array(labels, np.float64)
    counts = [frequencies(t) for t in texts]
    names, weight = term_weights(counts, y) if counts else ([], np.zeros(0))
    terms = {w: k for k, w in enumerate(names)}
    model = ToxicityModel(terms, weight, BlockMaxIndex([], max(1, len(terms))), y, np.array(ids, np.int64), np.zeros(3), prior)
    vectors = [model.vector(f) for f in counts]
    # like examples side by side, so that blocks have tight bounds
    top = [int(t[w.argmax()]) if len(t) else -1 for t, w in vectors]
    order = sorted(range(len(vectors)), key=lambda i: (y[i], top[i], ids[i], i))
    vectors, model.labels, model.ids = [vectors[i] for i in order], y[order], model.ids[order]
    model.index = BlockMaxIndex(vectors, max(1, len(terms)))
    share = float(y.mean()) if len(y) else 0.0
    weigh = np.where(model.labels > 0, prior / share if share else 0.0, (1 - prior) / (1 - share) if share < 1 else 0.0)
    x, at = [], []
    for i, (t, v) in enumerate(vectors):
        near, cosines = model.index.nearest(t, v, NEAREST + 1) if len(t) else (np.zeros(0, np.int64), np.zeros(0))
        other = near != i
        if other.any():
            x.append(model.votes(near[other][:NEAREST], cosines[other][:NEAREST]))
            at.append(i)
    alone = np.setdiff1d(np.arange(len(vectors)), at)
    if len(alone):
        model.without = float((weigh * model.labels)[alone].sum() / max(weigh[alone].sum(), 1e-9))
    if x:
        a, t, w = np.array(x), model.labels[at], weigh[at]
        for _ in range(25):  # Newton's method with a small ridge
            p = 1 / (1 + np.exp(-np.clip(a @ model.curve, -30, 30)))
            slope = a.T @ (w * (p - t)) + 0.5 * model.curve
            bend = (a * (w * p * (1 - p))[:, None]).T @ a + 0.5 * np.eye(3)
            model.curve = model.curve - np.linalg.solve(bend, slope)
    return model


def fit_on_sample(docs: DataFrame, labels: DataFrame, *, most_per_label: int = 1000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on whole texts of at most ``most_per_label`` labelled documents of each label, those of least id hash.

    The share of label 1 is counted over all labelled rows.  Null labels and ids are left out; of rows with equal ids the
    least text counts.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("y"))
    counted = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counted.values())
    if not total:
        return fit([], [], [], 0.0)
    own = keyed_text(docs, id_col, text_col)
    there = known.join(own.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id"))
    picked = [there.where(F.col("y") == y).orderBy("h", "doc_id").limit(most_per_label).select("doc_id", "y") for y in (0, 1)]
    rows = own.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).collect()  # bounded by the parameter
    rows = sorted(rows, key=lambda r: r.doc_id)
    return fit([r.text or "" for r in rows], [r.y for r in rows], [r.doc_id for r in rows], counted.get(1, 0) / total)


def score(docs: DataFrame, model: ToxicityModel, *, evidence: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, evidence`` of every whole text; evidence: the nearest examples' doc_id, cosine and label.

    A text without any known term, null and empty ones too, gets the share of label 1 among such examples.  Repeated rows
    give one row each.  Without labelled rows all score 0.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches):
            got = [model.score(frequencies(t)) for t in text_list(batch)]
            yield {
                "doc_id": batch.column("doc_id"),
                "score": [min(1.0, max(0.0, s)) for s, _, _ in got],
                "evidence": [[{"doc_id": int(model.ids[i]), "cosine": float(c), "label": int(model.labels[i])} for i, c in zip(ids[:evidence], near[:evidence], strict=True)] for _, ids, near in got],
            }

    return arrow_rows(keyed_text(docs, id_col, text_col), work, "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double,label:int>>")
