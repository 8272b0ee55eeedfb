"""Language identification by error-correcting output codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cartoloom.llm.common import arrow_rows, columns_of, keyed_text, slices, text_list, without_names

#: Hashed byte n-grams (two and three bytes) fall into so many features.
FEATURES = 1 << 12
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Whether any character is a letter (Unicode category L; neither digits nor signs such as a half or a square)."""
    return any(map(str.isalpha, text))


_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 13]] = 32


def in_fold(key: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo a number; false for a null id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def features(data: np.ndarray) -> np.ndarray:
    """Square roots of the n-gram shares of a text's bytes, so that length does not count."""
    x = _FOLD[data]
    out = np.zeros(FEATURES)
    if len(x) > 1:
        two = x[:-1] * np.uint32(0x01000193) + x[1:] * np.uint32(0x9E3779B1)
        out += np.bincount(two >> np.uint32(20), minlength=FEATURES)
        if len(x) > 2:
            three = two[:-1] * np.uint32(0x85EBCA6B) + x[2:] * np.uint32(0xC2B2AE35)
            out += np.bincount(three >> np.uint32(20), minlength=FEATURES)
    return np.sqrt(out / max(1.0, out.sum())).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """A row of plus and minus ones for each of n classes.

    Up to six classes get the exhaustive code (every split in two); more get random columns, the best of some tries
    by the least distance between rows.  Fixed seed.
    """
    if n <= 6:
        columns = [[1 if c == 0 or not (k >> (c - 1)) & 1 else -1 for c in range(n)] for k in range(1, 1 << max(0, n - 1))]
        return np.array(columns or [[1] * n], np.float32).T
    rng, width = np.random.default_rng(7), 6 * (n - 1).bit_length()
    tries = [rng.choice(np.array([-1, 1], np.float32), (n, width)) for _ in range(200)]
    return max(tries, key=lambda m: min((m[i] != m[j]).sum() for i in range(n) for j in range(i)))


@dataclass
class LanguageModel:
    """Binary classifiers (columns of ``weights``, the last row their bias) for the bits of ``code``."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + self.weights[-1]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class of least total logistic loss, its share of exp(-loss), and the runner-up's."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]).sum(2)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        order = np.argsort(-share, 1, kind="stable")
        top = np.take_along_axis(share, order[:, :2], 1)
        return order[:, 0], top[:, 0], top[:, 1] if share.shape[1] > 1 else np.zeros(len(share))


def fit(texts: list[str], languages: list[str], **options) -> LanguageModel:
    """Train on texts; see :func:`fit_features`."""
    return fit_features([features(np.frombuffer(t.encode(), np.uint8)) for t in texts], languages, **options)


def fit_features(rows: list[np.ndarray], languages: list[str], *, steps: int = 80, rate: float = 6.0, ridge: float = 1e-5) -> LanguageModel:
    """Train all bit classifiers together by Nesterov steps on the logistic loss; classes weigh the same."""
    known = sorted(set(languages))
    code = codewords(len(known))
    if not known:
        return LanguageModel([], code, np.zeros((FEATURES + 1, 1), np.float32))
    y = np.array([known.index(c) for c in languages])
    x = np.concatenate([np.stack(rows).astype(np.float32), np.ones((len(rows), 1), np.float32)], 1)
    share = (1.0 / (len(known) * np.bincount(y, minlength=len(known)))[y]).astype(np.float32)[:, None]
    target = code[y]
    w = np.zeros((FEATURES + 1, code.shape[1]), np.float32)
    ahead, was = w.copy(), w
    for k in range(steps):
        m = np.clip(x @ ahead, -30, 30) * target
        slope = x.T @ (share * -target / (1 + np.exp(m))) + ridge * ahead
        was, w = w, ahead - rate * slope
        ahead = w + k / (k + 3) * (w - was)
    return LanguageModel(known, code, w)


def fit_on_sample(docs: DataFrame, *, most_per_language: int = 400, most_docs: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on whole texts of at most ``most_per_language`` documents of each language, and ``most_docs`` in all.

    Documents are picked by a hash of the id, in two steps, so that no task sees more than a bounded number of a
    language's rows.  Tasks send features of a fixed size to the driver, never texts.  Null texts, ids and languages are
    left out; of rows with equal id and language the least text counts.
    """
    given = [F.col(f"`{c}`") for c in (id_col, text_col, lang_col)]
    rows = docs.select(*[c.alias(n) for c, n in zip(given, ("doc_id", "text", "lang"), strict=True)]).dropna()
    hashed = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    for part in (F.pmod(F.xxhash64("h"), F.lit(64)), F.lit(0)):
        rank = F.row_number().over(Window.partitionBy("lang", part).orderBy("h", "doc_id"))
        hashed = hashed.withColumn("rank", rank).where(F.col("rank") <= most_per_language)
    picked = hashed.orderBy("rank", "lang", "h").limit(most_docs).select("doc_id", "lang").distinct()
    texts = rows.join(F.broadcast(picked), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches):
            yield {"lang": batch.column("lang"), "x": [features(np.frombuffer(t.encode(), np.uint8)).astype("<f2").tobytes() for t in text_list(batch)]}

    got = sorted(tuple(r) for r in arrow_rows(texts, work, "lang string, x binary").collect())  # bounded by the parameters
    return fit_features([np.frombuffer(x, "<f2") for _, x in got], [c for c, _ in got])


def identify(docs: DataFrame, model: LanguageModel, *, margin: float = 0.1, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Every whole text's language: ``doc_id, lang_pred, score, ambiguous``; with ``keep`` the table's columns too.

    ``score`` is the chosen codeword's share, ``ambiguous`` says that the runner-up's lies within ``margin``.  Null
    texts and texts without a letter are ``und`` with score 0.  Repeated rows give one row each.  Without any learned
    language all are ``und``.  A column of the table that has the name of a result gives way to it.
    """
    results = "lang_pred string, score double, ambiguous boolean"
    own = without_names(docs, results) if keep else keyed_text(docs, id_col, text_col)
    read = text_col if keep else "text"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches):
            texts = text_list(batch, read)
            data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
            some = [bool(model.languages) and has_letter(t) for t in texts]
            best, top, second = model.decode(np.stack([model.margins(features(d)) for d in data])) if model.languages else (np.zeros(len(texts), int), *2 * [np.zeros(len(texts))])
            yield {c: batch.column(c) for c in batch.schema.names if keep or c != "text"} | {
                "lang_pred": [model.languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)],
                "score": np.where(some, np.clip(top, 0, 1), 0.0).tolist(),
                "ambiguous": (np.array(some) & (top - second < margin)).tolist(),
            }

    return arrow_rows(own, work, ", ".join([*(x for x in columns_of(own) if keep or not x.startswith("`text` ")), results]))
