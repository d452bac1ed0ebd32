"""Quality classifier: a regularised quadratic discriminant over statistics of whole texts.

Each class has a mean and a covariance of transformed statistics; the covariance is shrunk towards
the pooled one and its diagonal. A score is the posterior of class 1 from the difference of the two
log densities, whose Mahalanobis distances come from Cholesky factors worked out once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.base import remainder

FOLDS = 5
THRESHOLD = 0.3
FEATURES = [
    "log_words", "word_length", "upper", "digits", "sentence_marks", "other_marks", "other_ascii", "newlines",
    "distinct_words", "ends_odd", "no_letters", "shouted", "longest_word", "marks_per_word",
]

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(97, 123)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[[*b".,;:?'\"-()"]] = 4
_CLASS[[*b"!#$%&*+/<=>@[\\]^_`{|}~"]] = 5
_CLASS[[*b" \t\r\x0b\x0c"]] = 6
_CLASS[10] = 7
_CLASS[[*range(128, 256)]] = 8


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, all 0 for a text without words. Shares are taken to
    their square roots and counts to logarithms, which spreads small values."""
    raw = (text or "").encode("utf-8")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(raw)
    count = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=9) / n
    ends = np.bincount(_CLASS[np.frombuffer(b"".join([w[-1:] for w in words]), dtype=np.uint8)], minlength=9)
    w = len(words)
    no_letters = sum(not any(_CLASS[c] in (1, 2, 8) for c in x) for x in words if len(x) < 4)
    shouted = sum(map(bytes.isupper, words))
    longest = max(map(len, words))
    shares = [count[1], count[3], count[4], count[5], count[0], count[7]]
    return [
        np.log1p(w), (n - w) / w / 10, *np.sqrt(shares), len(set(words)) / w ** 0.8, np.sqrt(ends[5] / w),
        np.sqrt(no_letters / w), np.sqrt(shouted / w), np.log1p(longest), np.log1p(count[5] * n / w),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): statistics of every whole text, where it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.float64())
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([statistics(t) for t in b.column(1).to_pylist()], kind)], names=["doc_id", "x"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, x array<double>")


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log terms of both classes."""

    mean: np.ndarray
    inverse: np.ndarray
    constant: np.ndarray

    @classmethod
    def of(cls, n: np.ndarray, total: np.ndarray, cross: np.ndarray, shrink: float = 0.2, ridge: float = 1e-3) -> Discriminant:
        """From the count, sum and sum of outer products of each class. A class without rows takes
        the pooled values, so with no labels at all every score is one half."""
        d = total.shape[1]
        rows = np.maximum(n, 1)[:, None]
        every = max(float(n.sum()), 1.0)
        grand = total.sum(0) / every
        mean = np.where(n[:, None] > 0, total / rows, grand)
        within = cross - rows[:, :, None] * np.where(n[:, None, None] > 0, mean[:, :, None] * mean[:, None, :], 0)
        pooled = within.sum(0) / every
        diagonal = np.diag(np.diag(pooled) + ridge)
        inverse, constant = np.zeros((2, d, d)), np.zeros(2)
        for k in (0, 1):
            own = within[k] / rows[k] if n[k] > 1 else pooled
            cov = (1 - shrink) * own + shrink * (0.5 * pooled + 0.5 * diagonal) + ridge * np.eye(d)
            factor = np.linalg.cholesky(cov)
            inverse[k] = np.linalg.inv(factor)
            constant[k] = np.log((n[k] + 1) / (n.sum() + 2)) - np.log(np.diag(factor)).sum()
        return cls(mean, inverse, constant)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1 for rows of statistics."""
        log = [self.constant[k] - 0.5 * (((x - self.mean[k]) @ self.inverse[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(labelled: DataFrame, label: str) -> Discriminant:
    """From rows (x, label): each task adds up its rows, Spark adds the tasks, and the driver gets two
    rows of fixed width. Rows whose label is not 0 or 1 are left out."""
    d = len(FEATURES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((2, 1 + d + d * d))
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column(0).to_pylist(), dtype=np.float64).reshape(-1, d)
            y = np.asarray(b.column(1).to_pylist())
            for k in (0, 1):
                xk = x[y == k]
                acc[k] += np.concatenate([[len(xk)], xk.sum(0), (xk.T @ xk).ravel()])
        at = np.arange(acc.shape[1])
        for k in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(acc[k])], names=["k", "at", "v"])

    rows = labelled.where(F.col(label).isin(0, 1)).select("x", F.col(label).cast("int").alias("y"))
    parts = rows.mapInArrow(sums, "k bigint, at bigint, v double").groupBy("k", "at").agg(F.sum("v").alias("v"))
    acc = np.zeros((2, 1 + d + d * d))
    for k, at, v in parts.collect():
        acc[k, at] = v
    return Discriminant.of(acc[:, 0], acc[:, 1 : 1 + d], acc[:, 1 + d :].reshape(2, d, d))


def scores(rows: DataFrame, model: Discriminant) -> DataFrame:
    """``rows`` (doc_id, x) with the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(1).to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS) -> Discriminant:
    """A model from the labelled rows outside the held-out fold. Labels of an id apply to every row
    with that id; a missing id has none. Texts do not move: they become statistics where they lie."""
    known = labels.select(F.col("doc_id").alias("_id"), label).where(remainder("_id", folds) != 0)
    rows = features(docs)
    return fit(rows.join(known, rows.doc_id == known._id), label)


def accepted(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` with a score of at least ``threshold``, unchanged, in one pass without a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b.column("text").to_pylist()], dtype=np.float64).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Null and empty texts have statistics of 0 and a score like any other. Repeated rows give a row
    each; an empty table gives none; other columns are not read.
    """
    done = scores(features(docs), train(docs, labels, label))
    return done.select(
        "doc_id", (remainder("doc_id", FOLDS) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
