"""Hard negatives by a vector-approximation file.

Components are whole numbers, floor(256 x).  Each dimension is quantised into `CELLS` cells, whose edges come from one
pass over all vectors: evenly spaced within four deviations of the mean, the outermost reaching to the least and greatest
value.  The file holds blocks of rows: ids, labels, cells (a byte a component) and the vectors themselves.  For a block of
anchors against a block of the file, tables of each dimension's cells give middles and half widths, from which the lower
and upper bound of every score follow; only rows whose bounds let them enter the wanted list are scored exactly.  Two
searches are made: an anchor's best rows of its own label, and then, for the windows that those scores set, the best rows of
other labels inside each window.  Blocks of anchors meet blocks of the file in a block join; a task keeps a few rows for each
anchor that it has seen, and the tasks' lists are merged by rank.

Scores are exact: in doubles while all sums stay below 2^53, else in whole numbers of any length; results beyond 64 bits are
shown as the nearest 64-bit number, as components are.

Defined results: rows without an id, a label or a vector, or with a null or non-finite component, take no part; of rows with
one id the one with the least label, then the least vector, does; shorter vectors count as filled with zeros; a table that is
empty, or has one row or one label, gives no rows; anchors without other rows of their label, or with empty windows, have
none; ties go to the smaller id; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import Scratch, read, saved

CELLS = 64
POSITIVES, NEGATIVES = 5, 3
#: Window of a negative's score, in hundredths of the positive's.
LOW, HIGH = 50, 95
#: Most bytes of vectors in a block of the file, and most anchors in a block of anchors.
BLOCK, ANCHORS = 1 << 20, 256
_BIG = np.iinfo(np.int64).max


def rows_of(table: DataFrame, label: Column) -> DataFrame:
    """vec_id, label and v, the whole-numbered vector, of the rows that take part; one for each id."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    good = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) != F.lit(float("inf"))))
    rows = table.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(x, lambda e: F.floor(e * 256)).alias("v")).filter("label IS NOT NULL")
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of whole numbers as rows of `dim` columns, filled with zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(size) and (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(size), dim), np.int64)
    out[np.arange(dim) < size[:, None]] = flat
    return out


def cell_edges(rows: DataFrame) -> np.ndarray:
    """Edges of the cells, CELLS + 1 ascending whole numbers for each dimension; cell c holds edge c to edge c + 1.  One
    row for each dimension is gathered, never more."""
    each = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.count("*").alias("k"), F.min("x").alias("a"), F.max("x").alias("b"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()
    n = rows.count()
    out = np.zeros((max(1, len(each)), CELLS + 1), np.int64)
    for r in each:
        a, b = (r.a, r.b) if r.k == n else (min(r.a, 0), max(r.b, 0))
        inner = np.linspace(max(a, r.m - 4 * r.s), min(b, r.m + 4 * r.s), CELLS + 1)[1:-1]
        out[r.d] = [a, *np.clip(np.floor(inner), a, b).astype(np.int64).tolist(), b]
    return np.maximum.accumulate(out, axis=1)


def cells_of(v: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The cell of each component."""
    return np.stack([np.searchsorted(edges[d, 1:-1], v[:, d], "right") for d in range(v.shape[1])], axis=1).astype(np.uint8)


def bounds(anchors: np.ndarray, cells: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of each anchor's product with the vectors in the cells, by tables of middles and half widths."""
    low, high = edges[:, :-1].astype(float), edges[:, 1:].astype(float)
    d = np.arange(cells.shape[1])
    middle, half = ((low + high) / 2)[d, cells], ((high - low) / 2)[d, cells]
    q = anchors.astype(float)
    centre, reach = q @ middle.T, np.abs(q) @ half.T
    return centre - reach, centre + reach


def _safe(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether all sums of products stay exact in doubles, halves included."""
    most = lambda x: float(np.abs(x.astype(float)).max(initial=0))
    return most(a) * most(b) * a.shape[1] < 2.0**51


def exact(a: np.ndarray, b: np.ndarray, safe: bool) -> np.ndarray:
    """Inner products row by row; Python's whole numbers where doubles would not hold them."""
    if safe:
        return np.einsum("ij,ij->i", a.astype(float), b.astype(float)).astype(np.int64)
    return (a.astype(object) * b.astype(object)).sum(axis=1)


class Best:
    """The best `k` entries of each slot: higher scores first, then smaller ids."""

    def __init__(self, slots: int, k: int):
        self.k, self.slots = k, slots
        self.slot, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.worst = np.full(slots, -np.inf)  # score of a slot's last entry, once it has k

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        s, x, i = np.concatenate([self.slot, slot]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((i, -x, s)) if x.dtype != object else np.array(sorted(range(len(s)), key=lambda j: (s[j], -x[j], i[j])))
        s, x, i = s[order], x[order], i[order]
        first = np.searchsorted(s, s, "left")
        rank = np.arange(len(s)) - first
        keep = rank < self.k
        last = rank == self.k - 1
        # one step down for scores that a double cannot hold
        self.worst[s[last]] = [np.nextafter(float(v), -np.inf) if v.bit_length() > 53 else float(v) for v in map(int, x[last])]
        self.slot, self.score, self.id = s[keep], x[keep], i[keep]


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; minus infinity where a row has fewer columns."""
    n = values.shape[1]
    return np.partition(values, n - k, axis=1)[:, n - k] if n >= k else np.full(len(values), -np.inf)


def _numbers(raw, kind=np.int64) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), kind)


def _packed(dim: int, most: int, cut, extra: dict):
    """A function for mapInArrow that packs rows (vec_id, label, v) into blocks of at most `most`; cut(v) gives the cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                v = _matrix(part.column("v"), dim)
                columns = {"ids": part.column("vec_id").to_numpy(), "labels": part.column("label").to_numpy(), "v": v}
                columns |= {"cells": cut(v)} if cut else {}
                columns |= {name: part.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for name in extra}
                columns |= {f"{name}_n": np.diff(part.column(name).offsets.to_numpy()).astype(np.int64) for name in extra}
                yield pa.record_batch({k: pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for k, c in columns.items()})

    names = ["ids", "labels", "v", *(["cells"] if cut else []), *extra, *(f"{n}_n" for n in extra)]
    return run, ", ".join(f"{n} binary" for n in names)


def _pairs(file: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every block of anchors beside every block of the file.  Few large rows; Spark broadcasts the anchors where they are
    small and otherwise pairs partitions."""
    return file.crossJoin(anchors.select([F.col(c).alias(f"a_{c}") for c in anchors.columns]))


class _Pair:
    """A block of the file and a block of anchors, with bounds where doubles hold them."""

    def __init__(self, batch: pa.RecordBatch, k: int, dim: int, edges: np.ndarray):
        get = lambda name, kind=np.int64: _numbers(batch.column(name)[k], kind)
        self.ids, self.labels, self.v = get("ids"), get("labels"), get("v")
        self.a_ids, self.a_labels, self.a = get("a_ids"), get("a_labels"), get("a_v")
        self.v, self.a = self.v.reshape(len(self.ids), dim), self.a.reshape(len(self.a_ids), dim)
        self.same = self.a_labels[:, None] == self.labels
        self.safe = _safe(self.a, self.v) and _safe(self.a, edges[:, [0, -1]].T)
        if self.safe:
            self.low, self.high = bounds(self.a, get("cells", np.uint8).reshape(self.v.shape), edges)
        else:
            self.low, self.high = np.full(self.same.shape, -np.inf), np.full(self.same.shape, np.inf)

    def scores(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Exact scores of anchor i with row j, some thousand at a time."""
        step = max(1, BLOCK // (8 * self.v.shape[1]))
        parts = [exact(self.a[i[n : n + step]], self.v[j[n : n + step]], self.safe) for n in range(0, len(i), step)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _clipped(score: np.ndarray) -> pa.Array:
    return pa.array([max(-_BIG - 1, min(_BIG, int(x))) for x in score] if score.dtype == object else score, pa.int64())


def _best_same(dim: int, edges: np.ndarray, k: int):
    """For mapInArrow over pairs of blocks: each anchor's best k rows of its label in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[np.ndarray, Best]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                p = _Pair(batch, row, dim, edges)
                _, best = seen.setdefault(p.a_ids.tobytes(), (p.a_ids, Best(len(p.a_ids), k)))
                able = p.same & (p.a_ids[:, None] != p.ids)
                bar = np.maximum(_kth(np.where(able, p.low, -np.inf), k), best.worst)
                i, j = np.nonzero(able & (p.high >= bar[:, None]))
                best.add(i, p.scores(i, j), p.ids[j])
        for ids, best in seen.values():
            yield pa.record_batch({"anchor_id": pa.array(ids[best.slot]), "positive_id": pa.array(best.id), "text_score": pa.array([str(int(x)) for x in best.score], pa.string())})

    return run


def _best_other(dim: int, edges: np.ndarray, k: int, low: int, high: int):
    """For mapInArrow over pairs of blocks: the best k rows of other labels in each window of each anchor in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                p = _Pair(batch, row, dim, edges)
                key = p.a_ids.tobytes()
                if key not in seen:
                    count = _numbers(batch.column("a_positive_n")[row])
                    scores = [int(x) for x in batch.column("a_text_score")[row].as_py().split(b",") if x]
                    seen[key] = (p.a_ids, _numbers(batch.column("a_positive")[row]).copy(), np.repeat(np.arange(len(count)), count), np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count), scores, Best(int(count.sum()), k))
                _, _, anchor, nth, scores, best = seen[key]
                # whole-numbered limits: low * positive <= 100 * negative <= high * positive
                least = [-(-low * s // 100) for s in scores]
                most = [high * s // 100 for s in scores]
                a, b = np.array(least, float), np.array(most, float)
                a, b = np.nextafter(a, -np.inf), np.nextafter(b, np.inf)
                other = ~p.same
                for n in range(int(nth.max(initial=-1)) + 1):
                    slot = np.flatnonzero(nth == n)
                    at = anchor[slot]
                    lo, hi, able = p.low[at], p.high[at], other[at]
                    sure = able & (lo >= np.nextafter(a[slot], np.inf)[:, None]) & (hi <= np.nextafter(b[slot], -np.inf)[:, None])
                    bar = np.maximum(_kth(np.where(sure, lo, -np.inf), k), best.worst[slot])
                    i, j = np.nonzero(able & (hi >= np.maximum(bar, a[slot])[:, None]) & (lo <= b[slot][:, None]))
                    x = p.scores(at[i], j)
                    inside = np.array([least[slot[r]] <= int(v) <= most[slot[r]] for r, v in zip(i.tolist(), x, strict=True)], bool)
                    best.add(slot[i[inside]], x[inside], p.ids[j[inside]])
        for ids, positive, anchor, _, scores, best in seen.values():
            s = best.slot
            yield pa.record_batch({
                "anchor_id": pa.array(ids[anchor[s]]), "positive_id": pa.array(positive[s]), "negative_id": pa.array(best.id),
                "positive_score": _clipped(np.array([scores[k] for k in s.tolist()], object)), "text_score": pa.array([str(int(x)) for x in best.score], pa.string()),
            })

    return run


def _first(rows: DataFrame, by: list[str], id_column: str, k: int) -> DataFrame:
    """The best k of each group: higher scores first, then smaller ids; `rank` from 1.  Scores are whole numbers of up to 38
    digits in text form."""
    w = Window.partitionBy(*by).orderBy(F.col("text_score").cast("decimal(38,0)").desc(), F.col(id_column))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mine(scratch: Scratch, rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """For each anchor and each of its best `positives`, the best `negatives` of other labels whose score is `low` to `high`
    hundredths of the positive's.  rows is a table of vec_id, label and v; the result reads tables of `scratch`."""
    rows = scratch.saved(rows, "vectors")
    edges = cell_edges(rows)
    dim = len(edges)
    size = max(64, BLOCK // (9 * dim))
    run, schema = _packed(dim, size, lambda v: cells_of(v, edges), {})
    file = scratch.saved(rows.mapInArrow(run, schema), "va-file")
    anchors = scratch.saved(rows.filter(is_anchor), "anchors")
    run, schema = _packed(dim, min(ANCHORS, size), None, {})
    blocks = scratch.saved(anchors.coalesce(1 + anchors.count() // 65_536).mapInArrow(run, schema), "anchor-blocks")
    best = _pairs(file, blocks).mapInArrow(_best_same(dim, edges, positives), "anchor_id long, positive_id long, text_score string")
    best = _first(best, ["anchor_id"], "positive_id", positives)
    best = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "text_score"))).alias("p"))
    with_best = anchors.join(best, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "v", F.col("p.positive_id").alias("positive"), F.array_join("p.text_score", ",").alias("text_score"))
    with_best = scratch.saved(with_best, "positives")
    run, schema = _packed(dim, min(ANCHORS, size), None, {"positive": None})

    def with_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of anchors, with their positives' scores in text form."""
        for batch in batches:
            step = min(ANCHORS, size)
            for at, block in zip(range(0, batch.num_rows, step), run([batch]), strict=True):
                joined = ",".join(batch.column("text_score").slice(at, step).to_pylist()).encode()
                yield pa.record_batch([*block.columns, pa.array([joined], pa.binary())], [*block.schema.names, "text_score"])

    blocks = scratch.saved(with_best.coalesce(1 + anchors.count() // 65_536).mapInArrow(with_scores, schema + ", text_score binary"), "anchor-windows")
    found = _pairs(file, blocks).mapInArrow(_best_other(dim, edges, negatives, low, high), "anchor_id long, positive_id long, negative_id long, positive_score long, text_score string")
    found = _first(found, ["anchor_id", "positive_id"], "negative_id", negatives)
    score = F.coalesce(F.col("text_score").try_cast("long"), F.when(F.col("text_score").startswith("-"), F.lit(-_BIG - 1)).otherwise(F.lit(_BIG)))
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", score.alias("negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor (ids divisible by 50) among all embeddings; ids divisible by 7 have a shifted label."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    with Scratch(spark) as scratch:
        return saved(mine(scratch, rows_of(read(spark, sf_dir, "embeddings"), shifted), F.col("vec_id") % 50 == 0), "negatives")


OP11_SQL = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INT) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""
