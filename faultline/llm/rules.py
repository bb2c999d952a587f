"""Quality rules: gradient-boosted trees over document statistics, flattened into numpy node arrays for vectorised
scoring, with monotonic constraints on chosen features.

Trees are grown on histograms of at most 32 bins with a logistic loss.  For a constrained feature a split is only taken
if it moves the leaf values in the allowed direction, and the mean of the two values bounds both subtrees, so a document
never gains by more repetition, more signs or more repeated lines.  All trees lie in five flat arrays (feature,
threshold, left, right, value); scoring steps every document through one tree at a time, level by level.

Defined results: null and empty texts have no words and fail the base rules; without labelled rows the verdict of the
base rules stands; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._labels import MAX_FIT, fit_sample

#: Feature names, and the sign of the effect on quality that each may have (0: free).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "digit_share": 0,
    "sign_share": -1, "log_lines": 0, "mean_line": 0, "distinct_share": 0, "end_mark_share": 0, "bar_share": -1,
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def statistics(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the five counts [document, 5], the features [document, feature]) of whole texts."""
    n = len(off) - 1
    start, end, doc = X.words(data, off)
    h = X.hashes(data, start, end)
    n_words = np.bincount(doc, minlength=n)
    is_char = (data & 0xC0) != 0x80
    word_chars = X.per_document(is_char & ~X.SPACE[data], off)
    n_symbols = X.per_document(_SYMBOL[data], off)
    # five-word windows found twice or more in their text cover words
    w = np.zeros(len(h), np.uint64)
    m = max(0, len(h) - 4)
    inside = np.zeros(len(h), bool)
    if m:
        w[:m] = X.windows(h)
        inside[:m] = doc[:m] == doc[4:]
    at = np.flatnonzero(inside)
    key = X.mix(w[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(h) + 5, np.int64)
    np.add.at(cover, at[twice], 1)
    np.subtract.at(cover, at[twice] + 5, 1)
    n_repeat = np.bincount(doc[np.cumsum(cover)[: len(h)] > 0], minlength=n) if len(h) else n_words.copy()
    # lines with a word that equal an earlier line of their text
    ls, le, ldoc = X.runs((data != 10).view(np.uint8), off)
    worded = np.searchsorted(start, le, "left") > np.searchsorted(end, ls, "right")
    ls, le, ldoc = ls[worded], le[worded], ldoc[worded]
    lkey = X.mix(X.hashes(data, ls, le) + ldoc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    lorder = np.argsort(lkey, kind="stable")
    ldup = np.zeros(len(lkey), bool)
    ldup[lorder[1:][lkey[lorder][1:] == lkey[lorder][:-1]]] = True
    n_dup = np.bincount(ldoc[ldup], minlength=n)
    n_lines = np.bincount(ldoc, minlength=n)
    counts = np.stack([n_words, word_chars, n_symbols, n_dup, n_repeat], 1).astype(np.int64)
    cells = np.unique(X.mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    distinct = np.bincount(doc[cells], minlength=n)
    one, chars = np.maximum(1, n_words), np.maximum(1, word_chars)
    closed = np.bincount(ldoc[np.isin(data[le - 1], [33, 46, 63])], minlength=n) if len(le) else n_lines
    f = np.stack([
        np.log1p(n_words), word_chars / one, n_symbols / chars, n_dup / np.maximum(1, n_lines), n_repeat / one, X.per_document((data >= 65) & (data <= 90), off) / chars,
        X.per_document((data >= 48) & (data <= 57), off) / chars, X.per_document(_SIGN[data], off) / chars, np.log1p(n_lines), n_words / np.maximum(1, n_lines), distinct / one,
        closed / np.maximum(1, n_lines), X.per_document(data == 124, off) / one,
    ], 1)
    return counts, f


class Forest:
    """Flat node arrays of all trees; `roots` has the first node of each.  A leaf has feature -1."""

    def __init__(self, feature, threshold, left, right, value, roots, base: float):
        self.feature, self.threshold, self.left, self.right, self.value = (np.asarray(x) for x in (feature, threshold, left, right, value))
        self.roots, self.base = list(roots), base

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := np.flatnonzero(self.feature[at] >= 0)).size:
                node = at[inner]
                at[inner] = np.where(x[inner, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 2.0) -> Forest | None:
    """Boost `trees` trees on rows x and 0/1 targets y; None without rows."""
    if len(y) == 0:
        return None
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # code <= k means x <= cuts[k]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    total = np.full(len(y), base)

    def node() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(node())
        todo = [(roots[-1], np.arange(len(y)), depth, -np.inf, np.inf)]
        while todo:
            k, rows, more, low, high = todo.pop()
            gs, hs = g[rows].sum(), hess[rows].sum()
            best = (1e-6, None)
            for j in range(x.shape[1]) if more else ():
                if not len(cuts[j]):
                    continue
                gl = np.cumsum(np.bincount(code[rows, j], weights=g[rows], minlength=len(cuts[j]) + 1))[:-1]
                hl = np.cumsum(np.bincount(code[rows, j], weights=hess[rows], minlength=len(cuts[j]) + 1))[:-1]
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(gs - gl) / (hs - hl + ridge), low, high)
                gain = -(gl * vl + 0.5 * (hl + ridge) * vl**2 + (gs - gl) * vr + 0.5 * (hs - hl + ridge) * vr**2)
                v0 = np.clip(-gs / (hs + ridge), low, high)
                gain += gs * v0 + 0.5 * (hs + ridge) * v0**2
                ok = (hl >= least) & (hs - hl >= least) & ((vr - vl) * signs[j] >= 0)
                gain = np.where(ok, gain, -np.inf)
                c = int(gain.argmax())
                if gain[c] > best[0]:
                    best = (gain[c], (j, c, vl[c], vr[c]))
            if best[1] is None:
                value[k] = rate * float(np.clip(-gs / (hs + ridge), low, high))
                total[rows] += value[k]
                continue
            j, c, vl, vr = best[1]
            feature[k], threshold[k], left[k], right[k] = j, float(cuts[j][c]), node(), node()
            mid = (vl + vr) / 2
            goes = code[rows, j] <= c
            bounds = ((low, high),) * 2 if not signs[j] else ((low, mid), (mid, high)) if signs[j] > 0 else ((mid, high), (low, mid))
            todo += [(left[k], rows[goes], more - 1, *bounds[0]), (right[k], rows[~goes], more - 1, *bounds[1])]
    return Forest(feature, threshold, left, right, value, roots, base)


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_FIT) -> Forest | None:
    """Fit on about `most` labelled documents at the most, whose bounded labels are broadcast."""

    def run(batches):
        for batch in batches:
            for part in X.blocks(batch, "text"):
                _, f = statistics(*X.as_bytes(part.column("text")))
                yield pa.record_batch({"quality": part.column("quality"), **{k: pa.array(f[:, j].copy()) for j, k in enumerate(FEATURES)}})

    chosen = fit_sample(labels, most).select("doc_id", (F.col("quality") > 0).cast("int").alias("quality"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "quality").mapInArrow(run, "quality int, " + ", ".join(f"{k} double" for k in FEATURES)).toPandas()
    rows = rows.sort_values(list(rows.columns))
    return grow(rows[list(FEATURES)].to_numpy(float), rows["quality"].to_numpy(float), list(FEATURES.values()))


def judge(docs: DataFrame, forest: Forest | None, least: float = 0.5) -> DataFrame:
    """The counts of every document, base_failed, p_good and kept."""

    def run(batches):
        for batch in batches:
            for part in X.blocks(batch, "text"):
                counts, f = statistics(*X.as_bytes(part.column("text")))
                failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
                p = forest.probability(f) if forest else np.ones(len(f))
                yield pa.record_batch({"doc_id": part.column("doc_id"), **{k: pa.array(counts[:, j].copy()) for j, k in enumerate(COUNTS)}, "base_failed": pa.array(failed), "kept": pa.array(~failed & (p >= least)), "p_good": pa.array(p)})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, kept boolean, p_good double")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts, base verdict and boosted verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
