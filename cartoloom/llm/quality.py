"""Text quality by hashed word n-grams and logistic regression, trained by following the regularised leader."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartoloom.llm.common import arrow_rows, keyed_text, slices, text_list

#: Features, as a power of two.
BITS = 18
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_SHAPES = ((re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "9"))


class _Tokens(dict):
    def __missing__(self, token: str) -> int:
        self[token] = n = len(self)
        return n


def shape(token: str) -> str:
    """A word by the case of its letters, digits as one, other signs as they are but runs as two."""
    if token.isalpha():
        return "A" if len(token) > 1 and token.isupper() else "Aa" if token[0].isupper() else "a"
    for pattern, sign in _SHAPES:
        token = pattern.sub(sign, token)
    return token[:1] + token[-1:] if len(token) > 1 else token


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``text, feature, value`` of the hashed n-grams of whole texts, by text and feature; each text's values have unit length.

    Single words and pairs, in small letters, and one to three of their shapes in a row; the value of an n-gram is
    1 + log(count) before scaling.
    """
    words, numbers = [_TOKEN.findall(t) for t in texts], _Tokens()
    lengths = np.array([len(w) for w in words], np.int64)
    ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, int(lengths.sum()))
    of = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    keys = []
    for seed, longest, name in ((1, 2, str.lower), (2, 3, shape)):
        one = np.fromiter((xxhash.xxh3_64_intdigest(name(t), seed) for t in numbers), np.uint64, len(numbers))[ids]
        gram = one
        for n in range(1, min(longest, len(one)) + 1):
            if n > 1:
                gram = gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[n - 1 :]
                gram = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            inside = of[: len(gram)] == of[n - 1 :]
            keys.append(of[: len(gram)][inside] << BITS | (gram[inside] >> np.uint64(64 - BITS)).astype(np.int64))
    key, count = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
    text, value = key >> BITS, 1 + np.log(count)
    length = np.sqrt(np.bincount(text, value * value, len(texts)))
    return text, key & ((1 << BITS) - 1), value / length[text]


@dataclass
class QualityModel:
    """A weight for each feature, and the bias."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1: a sparse dot product for each text."""
        text, feature, value = features(texts)
        sums = self.bias + np.bincount(text, self.weights[feature] * value, len(texts))
        return 1 / (1 + np.exp(-np.clip(sums, -30, 30)))


class Leader:
    """Proximal updates that follow the regularised leader, a rate for each coordinate; the last coordinate is the bias."""

    def __init__(self, *, rate: float = 0.5, damping: float = 1.0, lasso: float = 0.02, ridge: float = 0.5) -> None:
        self.rate, self.damping, self.lasso, self.ridge = rate, damping, lasso, ridge
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The leader's weights at some coordinates; what the data say too little about is zero.  The bias isn't shrunk."""
        z, free = self.z[i], i == 1 << BITS
        over = np.where(free, z, np.sign(z) * np.maximum(np.abs(z) - self.lasso, 0))
        return -over / ((self.damping + np.sqrt(self.n[i])) / self.rate + np.where(free, 1e-3, self.ridge))

    def learn(self, i: np.ndarray, x: np.ndarray, label: float, weight: float = 1.0) -> None:
        w = self.at(i)
        slope = weight * (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        more = self.n[i] + slope * slope
        self.z[i] += slope - (np.sqrt(more) - np.sqrt(self.n[i])) / self.rate * w
        self.n[i] = more

    def model(self) -> QualityModel:
        w = self.at(np.arange((1 << BITS) + 1))
        return QualityModel(w[:-1].astype(np.float32), float(w[-1]))


def fit(texts: list[str], labels: list[int], prior: float, *, rounds: int = 6, **options) -> QualityModel:
    """Learn from the texts in a fixed random order, some rounds; labels weigh as their shares in ``prior`` say."""
    y = np.array(labels, float)
    share = y.mean() if len(y) else 0.0
    weight = [(1 - prior) / (1 - share) if share < 1 else 1.0, prior / share if share else 1.0]
    rows = []
    for k in range(0, len(texts), 256):
        text, feature, value = features(texts[k : k + 256])
        ends = np.searchsorted(text, np.arange(len(texts[k : k + 256]) + 1))
        rows += [(np.append(feature[a:b], 1 << BITS), np.append(value[a:b], 1.0)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    leader, rng = Leader(**options), np.random.default_rng(5)
    for _ in range(rounds):
        for r in rng.permutation(len(rows)).tolist():
            leader.learn(*rows[r], y[r], weight[int(y[r])])
    return leader.model()


def fit_on_sample(docs: DataFrame, labels: DataFrame, *, most_per_label: int = 2000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on whole texts of at most ``most_per_label`` labelled documents of each label, those of least id hash.

    One task learns from that sample, and the weights alone come to the driver.  The share of label 1 is counted over
    all labelled rows.  Null labels and ids are left out; of rows with equal ids the least text counts (null as empty),
    and an id is of label 1 if any of its labels is.  Without labels every score is 0.5.
    """
    own = keyed_text(docs, id_col, text_col)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("y"))
    share = known.agg(F.avg("y")).first()[0] or 0.0
    there = known.join(own.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id"))
    for part in (F.pmod(F.xxhash64("h"), F.lit(64)), F.lit(0)):
        there = there.withColumn("rank", F.row_number().over(Window.partitionBy("y", part).orderBy("h", "doc_id"))).where(F.col("rank") <= most_per_label)
    texts = own.join(F.broadcast(there.select("doc_id", "y", "h")), "doc_id").groupBy("doc_id", "y", "h").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows = [r for batch in batches for r in zip(text_list(batch), batch.column("y").to_pylist(), strict=True)]
        model = fit([t for t, _ in rows], [y for _, y in rows], share)
        yield {"weights": [model.weights.tobytes()], "bias": [model.bias]}

    sample = texts.repartition(1).sortWithinPartitions("h", "doc_id").select("text", "y")  # bounded by the parameter
    got = arrow_rows(sample, learn, "weights binary, bias double").collect()
    return QualityModel(np.frombuffer(got[0].weights, np.float32), got[0].bias) if got else fit([], [], 0.0)


def score(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every whole text; null and empty texts, and those without a token, get the bias alone.

    Repeated rows give one row each; an empty table gives none; other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches):
            yield {"doc_id": batch.column("doc_id"), "score": model.scores(text_list(batch))}

    return arrow_rows(keyed_text(docs, id_col, text_col), work, "doc_id long, score double")
