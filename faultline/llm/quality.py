"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades: 0 a toxic document, 1 a poor one, 2 a good one.  One weight vector over hashed text features is shared by all
grades; ordered thresholds b0 < b1 cut the score s: P(grade <= k) = sigmoid(b_k - s).  The expected grade is the sum of
the tail probabilities P(grade > k); `p_good`, the tail above grade 1, selects.

Features are the distinct lower-cased tokens of the whole text (runs of letters, of digits and of signs, hashed), and
markers for bins of the shares of capitals, signs and distinct words and of the length.  Long and short documents are
alike to it in that a feature counts once.

Defined results: null and empty texts have only the marker features; with no labelled rows every score is 0 and every
document is kept; repeated rows are scored alike; other columns are ignored (`score`) or passed on (`keep_good`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._labels import MAX_FIT, fit_sample

BITS = 18
GRADES = 3
#: Features seen in fewer fitted documents have no weight.
MIN_DOCS = 4

_KIND = np.full(256, 3, np.uint8)
_KIND[X.SPACE] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_MARK = X.mix(np.arange(1, 257, dtype=np.uint64) << np.uint64(40)) & np.uint64((1 << BITS) - 1)


def _bin(share: np.ndarray) -> np.ndarray:
    return np.searchsorted([0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9], share, "right")


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, buckets) of the distinct features, ascending by document."""
    n = len(off) - 1
    kind = _KIND[data]
    start, end, doc = X.runs(kind, off)
    h = X.hashes(X.LOWER[data], start, end)
    h = np.where(kind[start] == 2, np.uint64(7), h) if len(start) else h
    pair = [(doc.astype(np.uint64) << np.uint64(BITS)) | (h & np.uint64((1 << BITS) - 1))]
    of = lambda flag: X.per_document(flag, off)
    chars = np.maximum(1, of(kind > 0))
    upper = (data >= 65) & (data <= 90)
    tokens = np.bincount(doc, minlength=n)
    cells = np.unique(pair[0])
    distinct = np.bincount((cells >> np.uint64(BITS)).astype(np.int64), minlength=n)
    for k, b in enumerate((_bin(of(upper) / chars), _bin(of(kind == 3) / chars), _bin(distinct / np.maximum(1, tokens)), np.minimum(12, np.log2(1 + tokens).astype(int)))):
        pair.append((np.arange(n, dtype=np.uint64) << np.uint64(BITS)) | _MARK[16 * k + b])
    cells = np.unique(np.concatenate([cells, *pair[1:]]))
    return (cells >> np.uint64(BITS)).astype(np.int64), (cells & np.uint64((1 << BITS) - 1)).astype(np.int64)


def grade(quality, toxic):
    """0 toxic, 1 poor, 2 good; columns."""
    return F.when(toxic > 0, 0).when(quality <= 0, 1).otherwise(2)


class Model:
    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts

    def tails(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0, 1: [document, k]."""
        doc, bucket = features(data, off)
        s = np.bincount(doc, weights=self.weights[bucket], minlength=len(off) - 1)
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - s[:, None], -60, 60)))


def fit_arrays(doc: np.ndarray, bucket: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.05, ridge: float = 2e-4) -> Model:
    """Adam over all rows; thresholds stay ordered as b1 = b0 + exp(d)."""
    dim, n = 1 << BITS, len(y)
    if n == 0:
        return Model(np.zeros(dim), np.array([-3.0, -2.0]))
    seen = np.bincount(bucket, minlength=dim)
    used = seen[bucket] >= min(MIN_DOCS, max(1, n // 50))
    doc, bucket = doc[used], bucket[used]
    freq = np.maximum(1e-9, [(y <= 0).mean(), (y <= 1).mean()])
    b0 = np.log(freq[0] / max(1e-9, 1 - freq[0]))
    b0, d = np.clip(b0, -6, 6), np.log(0.7)
    w, m, v = np.zeros(dim + 2), np.zeros(dim + 2), np.zeros(dim + 2)
    w[dim], w[dim + 1] = b0, d
    for step in range(1, rounds + 1):
        s = np.bincount(doc, weights=w[bucket], minlength=n)
        cut = np.array([w[dim], w[dim] + np.exp(w[dim + 1])])
        f = 1 / (1 + np.exp(-np.clip(cut[None, :] - s[:, None], -40, 40)))
        cdf = np.concatenate([np.zeros((n, 1)), f, np.ones((n, 1))], 1)
        dens = np.concatenate([np.zeros((n, 1)), f * (1 - f), np.zeros((n, 1))], 1)
        row = np.arange(n)
        p = np.maximum(1e-9, cdf[row, y + 1] - cdf[row, y])
        up, down = dens[row, y + 1] / p, dens[row, y] / p  # of -log p: by the upper cut -up, by the lower +down, by s up - down
        g = np.empty(dim + 2)
        g[:dim] = np.bincount(bucket, weights=(up - down)[doc], minlength=dim) / n + ridge * w[:dim]
        by_cut = np.array([(-up * (y == k) + down * (y == k + 1)).mean() for k in (0, 1)])
        g[dim], g[dim + 1] = by_cut.sum(), by_cut[1] * np.exp(w[dim + 1])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(w[:dim], np.array([w[dim], w[dim] + np.exp(w[dim + 1])]))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_FIT) -> Model:
    """Fit on about `most` labelled documents at the most.  The chosen labels have that bound, so they are broadcast;
    the driver gets the features of the chosen documents only.  Rows of one doc_id count once each."""
    chosen = fit_sample(labels, most).select("doc_id", grade(F.col("quality"), F.col("toxic")).cast("int").alias("grade"))

    def run(batches):
        for batch in batches:
            for part in X.blocks(batch, "text"):
                doc, bucket = features(*X.as_bytes(part.column("text")))
                at = np.searchsorted(doc, np.arange(part.num_rows + 1))
                flat = bucket.astype("<u4").tobytes()
                yield pa.record_batch({"grade": part.column("grade"), "cells": pa.array([flat[4 * a : 4 * b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())})

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "grade").mapInArrow(run, "grade int, cells binary").toArrow()
    cells = [np.frombuffer(x, "<u4") for x in rows.column("cells").to_pylist()]
    order = sorted(range(len(cells)), key=lambda k: (len(cells[k]), cells[k].tobytes()))  # so that row order doesn't matter
    y = np.array(rows.column("grade").to_pylist(), np.int64)[order] if cells else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(cells)), [len(cells[k]) for k in order])
    return fit_arrays(doc, np.concatenate([cells[k] for k in order]).astype(np.int64) if cells else doc, y)


def score(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_not_toxic, p_good, kept (p_good is at least `least`)."""

    def run(batches):
        for batch in batches:
            for part in X.blocks(batch, "text"):
                t = model.tails(*X.as_bytes(part.column("text")))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "expected_grade": pa.array(t.sum(1)), "p_not_toxic": pa.array(t[:, 0].copy()), "p_good": pa.array(t[:, 1].copy()), "kept": pa.array(t[:, 1] >= least)})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, expected_grade double, p_not_toxic double, p_good double, kept boolean")


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows, all columns, whose probability of the best grade is at least `least`."""

    def run(batches):
        for batch in batches:
            for part in X.blocks(batch, "text"):
                yield part.filter(pa.array(model.tails(*X.as_bytes(part.column("text")))[:, 1] >= least))

    return docs.mapInArrow(run, docs.schema)


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Expected grade, tail probabilities and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
