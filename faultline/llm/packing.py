"""Packing by order-preserving dynamic programming: documents of an input slice form one stream of tokens in their order,
and windows of at most `limit` tokens are cut from it at document or sentence ends so that padding plus penalties for cut
documents are least.

With cut points at stream positions p and penalties c, f(j) = c(j) + min over p(j) - p(i) <= limit of
f(i) + limit - (p(j) - p(i)).  The part that depends on i is f(i) + p(i), and its window only moves on, so a monotone
queue finds each minimum in constant amortised time.  Where ends lie far apart, points between words at a higher penalty
are added, so a cut is always possible.  The stream is worked off in stretches; the last window of a stretch is carried
over to the next.  The remainder of a slice is stored as sequences whose lengths are powers of two, which need no
padding, unless padding it is cheaper.

Defined results: null and empty texts are documents of the end id alone; every row is a document of its own, repeated
rows and equal doc_ids too; a text of any length is cut into as many windows as it takes; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import _text as X
from .encoding import Encoder

TOKENIZER = "word_bpe_49k.json"
LIMIT, END_ID = 4096, 2
#: Padding tokens that a cut at a sentence end or between words of a document is worth.
SENTENCE, ANYWHERE = 16, 96
#: Distance of the points that are added between far ends.
STEP = 128
STRETCH = 1_500_000
#: Most text bytes that are encoded at a time.
BLOCK = 1 << 19


def cut_points(point: np.ndarray, cost: np.ndarray, limit: int) -> list[int]:
    """Indices of the cheapest cuts, from 0 to the last point.  Neighbouring points are at most `limit` apart."""
    p, c = point.tolist(), cost.tolist()
    n = len(p)
    best, back = [0] * n, [0] * n
    queue: deque[tuple[int, int, int]] = deque([(p[0], p[0], 0)])  # least f + p first: (f + p, p, index)
    for j in range(1, n):
        pj = p[j]
        low = pj - limit
        while queue[0][1] < low:
            queue.popleft()
        value, _, i = queue[0]
        f = c[j] + value + limit - pj
        best[j], back[j] = f, i
        value = f + pj
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, pj, j))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def tail_sizes(n: int, limit: int) -> list[int]:
    """The remainder of a slice: powers of two, largest first, or one padded sequence where that is cheaper."""
    if n & (n - 1) == 0 or limit - n <= ANYWHERE * (n.bit_count() - 1):
        return [n]
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class _Stream:
    """Tokens that no sequence holds yet, with the documents and possible cuts among them."""

    def __init__(self, limit: int, task: int, kind: pa.DataType):
        self.limit, self.kind, self.next_id = limit, kind, task << 40
        self.ids: list[np.ndarray] = []
        self.n = 0
        self.docs: list[tuple[object, int, int, int]] = []  # doc_id, position in the stream of its first held id, ids before that, its ids
        self.points: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.costs: list[np.ndarray] = [np.zeros(1, np.int64)]

    def add(self, doc_ids: list, sizes: np.ndarray, ids: np.ndarray, points: np.ndarray, costs: np.ndarray) -> None:
        at = self.n + np.cumsum(sizes) - sizes
        self.docs += zip(doc_ids, at.tolist(), [0] * len(doc_ids), sizes.tolist(), strict=True)
        self.points.append(points + self.n)
        self.costs.append(costs)
        self.ids.append(ids)
        self.n += len(ids)

    def take(self, last: bool):
        if not self.n:
            return None
        ids = np.concatenate(self.ids).astype("<u4")
        point, cost = np.concatenate(self.points), np.concatenate(self.costs)
        cuts = point[cut_points(point, cost, self.limit)]
        if last:
            rest = int(cuts[-1] - cuts[-2])
            cuts = np.concatenate([cuts[:-1], cuts[-2] + np.cumsum(tail_sizes(rest, self.limit))])
        else:
            cuts = cuts[:-1]
        end = int(cuts[-1])
        rows = None
        if len(cuts) > 1:
            start = np.array([d[1] for d in self.docs], np.int64)
            edge = np.union1d(cuts, start[start < end])
            a, b = edge[:-1], edge[1:]
            doc, seq = np.searchsorted(start, a, "right") - 1, np.searchsorted(cuts, a, "right") - 1
            before = np.array([d[2] for d in self.docs], np.int64)
            size = np.array([d[3] for d in self.docs], np.int64)
            raw = memoryview(ids).cast("B")
            rows = pa.record_batch({
                "doc_id": pa.array([self.docs[k][0] for k in doc.tolist()], self.kind), "start": pa.array(a - start[doc] + before[doc]), "length": pa.array(b - a),
                "ids_crc32": pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.int64()), "doc_tokens": pa.array(size[doc]),
                "sequence_id": pa.array(self.next_id + seq), "offset": pa.array(a - cuts[seq]),
            })
            self.next_id += len(cuts) - 1
        left = [d for d in self.docs if d[1] + d[3] - d[2] > end]
        self.docs = [(d[0], max(0, d[1] - end), d[2] + max(0, end - d[1]), d[3]) for d in left]
        self.ids, self.n = [ids[end:]], len(ids) - end
        at = point >= end
        self.points, self.costs = [point[at] - end], [cost[at]]
        return rows


def _in_order(point: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending points, each once and at its least cost."""
    order = np.lexsort((cost, point))
    point, cost = point[order], cost[order]
    one = np.concatenate([[True], point[1:] != point[:-1]])
    return point[one], cost[one]


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of a document in a sequence.  sequence_id holds the number of the input slice above bit 40."""

    def run(batches):
        stream = None
        for batch in batches:
            if stream is None:
                stream = _Stream(limit, TaskContext.get().partitionId(), batch.schema.field("doc_id").type)
            for part in X.blocks(batch, "text", BLOCK):
                data, off = X.as_bytes(part.column("text"))
                u = Encoder.of(path).units(data, off)
                n = part.num_rows
                body = np.bincount(u.doc, weights=u.size, minlength=n).astype(np.int64)
                sizes = body + 1
                begin = np.cumsum(sizes) - sizes
                ids = np.full(int(sizes.sum()), end_id, np.uint32)
                spot = np.ones(len(ids), bool)
                spot[begin + body] = False
                ids[spot] = u.stream()
                # cut points behind units: sentence ends, and where those are rare, ends of words
                behind = np.cumsum(u.size) + u.doc
                follows = np.ones(len(u.end), bool)
                inner = u.end < len(data)
                follows[inner] = X.SPACE[data[u.end[inner]]]
                closes = follows & np.isin(data[u.end - 1], [33, 46, 63]) if len(u.end) else follows
                grid = follows & (behind // STEP != np.concatenate([[0], behind[:-1]]) // STEP) if len(behind) else follows
                ends = begin + sizes
                p = np.concatenate([ends, behind[closes], behind[grid & ~closes]])
                c = np.concatenate([np.zeros(n, np.int64), np.full(int(closes.sum()), SENTENCE), np.full(int((grid & ~closes).sum()), ANYWHERE)])
                p, c = _in_order(p, c)
                if np.diff(p, prepend=0).max() > limit:  # a word of more than `limit` ids
                    far = np.arange(limit, len(ids), limit)
                    p, c = _in_order(np.concatenate([p, far]), np.concatenate([c, np.full(len(far), 4 * ANYWHERE)]))
                stream.add(part.column("doc_id").to_pylist(), sizes, ids, p, c)
                if stream.n >= STRETCH and (rows := stream.take(False)):
                    yield rows
        if stream and (rows := stream.take(True)):
            yield rows

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {SCHEMA}")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER))
