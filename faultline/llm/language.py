"""Language identification: script ranges narrow the candidates of each word, then Viterbi over per-word scores with a
switching penalty labels spans of mixed-language text.

A word is a maximal run of letters.  Its score in a language is the sum of smoothed log-probabilities of the hashed byte
trigrams that it and its borders consist of.  Only languages in which the word's script was seen stay candidates (all,
if none was seen).  The path of labels with the highest total score, each switch costing `penalty`, gives the spans; the
document's language is the one whose spans hold most letters (ties: the first in alphabetical order), and its score is
that share of letters times the certainty (0.5 to 1) of the language's lead over the next one.

`keep_known` rejects what is in none of the learned languages, on evidence that does not depend on their number: texts
without letters, texts of which no language holds `MAJORITY` of the letters (letters of a script that the leading language
was not seen in are not its own), and texts whose letters are `STRANGE` less likely, in the mean of their logarithms, than
those of the labelled texts.

Defined results: null, empty or letterless text is `und` with score 0, and rejected; of languages with equal letters the
first in alphabetical order leads; repeated rows are judged alike one by one; with nothing to learn from, everything is
`und` and rejected; an empty table gives an empty result; other columns are ignored (`predict`) or passed on (`keep_known`),
whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X

BUCKETS = 1 << 16
#: Most rows that the model is fitted on, spread over all by a hash.
MAX_FIT = 65_536
#: Log-probability that a change of language costs.
PENALTY = 12.0
#: A language holds a script if that is so large a share of its letters.
SCRIPT_SHARE = 0.02
#: Least share of the letters that the leading language of a known text holds, and the most by which the mean
#: log-probability of its letters lies below that of labelled texts.
MAJORITY, STRANGE = 0.5, 5.0

# fixed values: Unicode blocks of scripts, as first and last code point
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF),
    ("kana", 0x3040, 0x30FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x3400, 0x9FFF), ("han", 0x20000, 0x3134F),
]
NAMES = ["none", "other", *dict.fromkeys(s for s, _, _ in SCRIPTS)]
_table: np.ndarray | None = None


def script_table() -> np.ndarray:
    """Script number of every code point: 0 for what is no letter, 1 for letters of no listed script."""
    global _table
    if _table is None:
        t = np.fromiter((chr(i).isalpha() for i in range(0x32000)), bool, 0x32000).astype(np.uint8)
        for name, a, b in SCRIPTS:
            part = t[a : b + 1]
            part[part > 0] = NAMES.index(name)
        _table = t
    return _table


def letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes (ASCII and Latin-1), and the script of each byte's character; 0 where it is no letter."""
    low = X.LOWER[data]
    script = script_table()[np.where(data < 128, data, 0)]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        b = np.zeros((4, len(lead)), np.int64)
        for k in range(4):
            b[k] = data[np.minimum(lead + k, len(data) - 1)]
        size = 2 + (b[0] >= 0xE0) + (b[0] >= 0xF0)
        t = b & 0x3F
        cp = np.where(size == 2, (b[0] & 31) << 6 | t[1], np.where(size == 3, (b[0] & 15) << 12 | t[1] << 6 | t[2], (b[0] & 7) << 18 | t[1] << 12 | t[2] << 6 | t[3]))
        of = script_table()[np.minimum(cp, len(script_table()) - 1)]
        for k in range(4):
            here = lead[size > k] + k
            script[here[here < len(data)]] = of[size > k][here < len(data)]
        upper = lead[(b[0] == 0xC3) & (b[1] >= 0x80) & (b[1] <= 0x9E) & (b[1] != 0x97)] + 1
        low[upper] += 32
    return low, script


def trigrams(low: np.ndarray, script: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and documents, and the trigram bucket of each byte of the words."""
    start, end, doc = X.runs((script > 0).view(np.uint8), off)
    b = np.where(script > 0, low, 32).astype(np.uint32)
    padded = np.concatenate([[np.uint32(32)], b, [np.uint32(32)]])
    first, last = np.zeros(len(b), bool), np.zeros(len(b), bool)
    first[start], last[end - 1] = True, True
    before, after = np.where(first, 32, padded[:-2]), np.where(last, 32, padded[2:])
    h = (before * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return start, end, doc, (h >> np.uint32(16)).astype(np.int64)


class Model:
    """Languages in alphabetical order, log-probabilities [language, bucket], the scripts of each, and the mean
    log-probability of a letter of each in the labelled texts."""

    def __init__(self, langs: list[str], logp: np.ndarray, scripts: np.ndarray, usual: np.ndarray | None = None):
        self.langs, self.logp, self.scripts = langs, logp, scripts
        self.usual = np.zeros(len(langs)) if usual is None else usual


def _count(key: str) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in X.blocks(batch, "text"):
                data, off = X.as_bytes(part.column("text"))
                start, end, doc, bucket = trigrams(*(ls := letters(data)), off)
                langs = part.column(key).to_pylist()
                names = sorted(set(langs))
                code = np.array([names.index(x) for x in langs], np.int64)
                word = np.repeat(code[doc], end - start)
                inside = ls[1] > 0
                tri = np.bincount(word * BUCKETS + bucket[inside], minlength=len(names) * BUCKETS).reshape(len(names), -1)
                scr = np.bincount(word * len(NAMES) + ls[1][inside], minlength=len(names) * len(NAMES)).reshape(len(names), -1)
                for k, name in enumerate(names):
                    total[name] = total.get(name, 0) + np.concatenate([tri[k], scr[k]])
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.record_batch({"lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at, pa.int64()), "n": pa.array(counts[at], pa.int64())})

    return run


def fit(docs: DataFrame, most: int = MAX_FIT) -> Model:
    """Fit on rows with a text and a lang that are not held out; at most about `most` of them, taken by a hash.

    What comes to the driver is one count for each language and bucket, whatever the number of documents.
    """
    known = docs.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    n = known.select(F.lit(1)).count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30)) < F.lit(int(most / n * (1 << 30))))
    rows = (
        known.select("text", "lang").mapInArrow(_count("lang"), "lang string, bucket long, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS + len(NAMES)))
    counts[[langs.index(x) for x in rows["lang"]], rows["bucket"].to_numpy(int)] = rows["n"]
    tri, scr = counts[:, :BUCKETS], counts[:, BUCKETS:]
    alpha = 0.2
    used = max(1, int((tri.sum(0) > 0).sum())) if langs else 1
    logp = np.log((tri + alpha) / (tri.sum(1, keepdims=True) + alpha * 4 * used))
    logp = np.maximum(logp, logp.max(0, keepdims=True) - 6.0) if langs else logp
    usual = (tri * logp).sum(1) / np.maximum(1, tri.sum(1))
    return Model(langs, logp.astype(np.float32), scr > SCRIPT_SHARE * np.maximum(1, scr.sum(1, keepdims=True)), usual)


def viterbi(score: np.ndarray, doc: np.ndarray, n_docs: int, penalty: float) -> np.ndarray:
    """Best label of every word; score is [word, language], words of a document stand together.  All documents advance
    one word at a time, the longest first, so that the step is one numpy operation for all that still have words."""
    n = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    n_desc = n[order]
    kind = np.min_scalar_type(score.shape[1])  # holds every label
    best = np.empty(score.shape, kind)  # predecessor of each label
    label = np.empty(len(score), np.int64)
    live = int((n_desc > 0).sum())
    if not live:
        return label
    v = score[first[order[:live]]].astype(np.float64)
    ids = np.arange(score.shape[1], dtype=kind)
    longest = int(n_desc[0])
    alive = np.searchsorted(-n_desc, -np.arange(1, longest + 1), "right")  # documents with at least t words
    for t in range(1, longest):
        m = alive[t]
        v = v if m == len(v) else v  # finished documents keep their last values in v
        top = v[:m].argmax(1)
        jump = v[np.arange(m), top] - penalty
        stay = v[:m] >= jump[:, None]
        at = first[order[:m]] + t
        best[at] = np.where(stay, ids, top[:, None].astype(kind))
        v[:m] = np.where(stay, v[:m], jump[:, None]) + score[at]
    now = v.argmax(1)
    for t in range(longest - 1, -1, -1):
        m = alive[t]
        at = first[order[:m]] + t
        label[at] = now[:m]
        if t:
            now[:m] = best[at, now[:m]]
    return label


class Labels:
    """Of one block: the words (start, end, document, label), and of each document its label (-1: und), its score, the
    share of its letters that are the label's own, and the distance of their mean log-probability from the usual one."""

    def __init__(self, start, end, doc, label, n_docs: int):
        self.start, self.end, self.doc, self.label = start, end, doc, label
        self.pred, self.score, self.own, self.distance = np.full(n_docs, -1), np.zeros(n_docs), np.zeros(n_docs), np.zeros(n_docs)


def label_block(model: Model, data: np.ndarray, off: np.ndarray, penalty: float) -> Labels:
    """Labels of the words and documents of a block of texts."""
    n_docs, k = len(off) - 1, len(model.langs)
    low, script = letters(data)
    start, end, doc, bucket = trigrams(low, script, off)
    if not len(start) or not k:
        return Labels(start, end, doc, np.zeros(len(start), np.int64), n_docs)
    b = bucket[script > 0]
    length = end - start
    first = np.cumsum(length) - length
    score = np.stack([np.add.reduceat(row[b], first) for row in model.logp], 1)
    of = script[start]
    can = model.scripts[:, of].T
    held = can.copy()
    can[~can.any(1)] = True
    likely = score
    score = np.where(can, score, score.max(1, keepdims=True) - 60.0)
    label = viterbi(score, doc, n_docs, penalty)
    out = Labels(start, end, doc, label, n_docs)
    size = np.bincount(doc * k + label, weights=length, minlength=n_docs * k).reshape(n_docs, k)
    whole = size.sum(1)
    some = whole > 0
    out.pred[some] = size[some].argmax(1)
    if k > 1:
        total = np.stack([np.bincount(doc, weights=score[:, j], minlength=n_docs) for j in range(k)], 1)
        mine = np.take_along_axis(total, np.maximum(out.pred, 0)[:, None], 1)[:, 0]
        np.put_along_axis(total, np.maximum(out.pred, 0)[:, None], -np.inf, 1)
        lead = 1 / (1 + np.exp(-np.clip(mine - total.max(1), -50, 50)))
    else:
        lead = np.ones(n_docs)
    out.score[some] = np.clip(size.max(1)[some] / whole[some] * np.maximum(lead[some], 0.5), 0, 1)
    word = np.arange(len(doc))
    mine = (label == out.pred[doc]) & held[word, label]
    out.own[some] = np.bincount(doc, weights=length * mine, minlength=n_docs)[some] / whole[some]
    gap = likely[word, label] - length * model.usual[label]
    out.distance[some] = np.bincount(doc, weights=gap, minlength=n_docs)[some] / whole[some]
    return out


def held_out(doc_id):
    """Whether the remainder of crc32(doc_id as text) by 4 is 2; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


SPANS = "array<struct<start:long,end:long,lang:string>>"


def predict(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score, spans (code point start, end and language of each stretch of one language)."""

    def run(batches):
        for batch in batches:
            for part in X.blocks(batch, "text"):
                data, off = X.as_bytes(part.column("text"))
                found = label_block(model, data, off, penalty)
                start, end, doc, label = found.start, found.end, found.doc, found.label
                point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])])) if len(doc) else np.zeros(0, int)
                last = np.concatenate([cut[1:], [len(doc)]])[: len(cut)] - 1
                base = point[off[:-1]][doc[cut]] if len(cut) else cut
                names = np.array([*model.langs, "und"], object)
                spans = pa.StructArray.from_arrays(
                    [pa.array(point[start[cut]] - base if len(cut) else cut, pa.int64()), pa.array(point[end[last]] - base if len(cut) else cut, pa.int64()), pa.array(names[label[cut]] if len(cut) else [], pa.string())], ["start", "end", "lang"]
                )
                at = np.searchsorted(doc[cut] if len(cut) else cut, np.arange(len(off)))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "lang_pred": pa.array(names[found.pred], pa.string()), "score": pa.array(found.score), "spans": pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans)})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, spans {SPANS}")


def keep_known(docs: DataFrame, model: Model, majority: float = MAJORITY, strange: float = STRANGE, penalty: float = PENALTY) -> DataFrame:
    """The rows, all columns, whose text is in one of the model's languages."""

    def run(batches):
        for batch in batches:
            for part in X.blocks(batch, "text"):
                found = label_block(model, *X.as_bytes(part.column("text")), penalty)
                yield part.filter(pa.array((found.pred >= 0) & (found.own >= majority) & (found.distance >= -strange)))

    return docs.mapInArrow(run, docs.schema)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and n_spans of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
