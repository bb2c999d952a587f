"""Sum-of-squares packing: each piece of a document goes where the squared counts of open sequences per residual gap
become smallest.

Pieces (a document's remainder first, then pieces of `limit` tokens) are written once as small rows without text.  Full
pieces are sequences of their own.  The others are dealt at random into slices of about `SLICE` pieces, a number that
follows the input, and each slice is packed on its own: counts are held for every gap from 1 to `limit` - 1, and a piece of
size s goes from gap g to gap g - s, or opens a sequence, as the change of the sum of squares says; ties go to the smallest
gap, and to an open sequence before a new one.  Larger pieces come first, since a slice knows its sizes.

Defined results: null and empty texts are documents of the end id alone; every row is a document of its own, repeated rows
and equal or null doc_ids too; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._store import Scratch, saved
from .byte_encoding import ByteEncoder

TOKENIZER = "byte_bpe_50k.json"
LIMIT, END_ID = 1024, 2
#: Pieces that a task packs together, on average.
SLICE = 32_768
#: Most text bytes that are encoded at a time.
BLOCK = 1 << 19


def sum_of_squares(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence (from 0) and offset of each piece, placed in the given order."""
    after = np.zeros(limit + 1)  # open sequences of each gap
    after[0] = -0.5  # a sequence that is full counts no more, which saves the square of one
    before = np.full(limit + 1, np.inf)  # the same negated, and infinite where there is none to take
    holds: list[list[int]] = [[] for _ in range(limit + 1)]
    sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    opened = 0
    for k, s in enumerate(sizes.tolist()):
        change = after[: limit - s] + before[s:limit]
        g = int(change.argmin()) if s < limit else -1
        if g >= 0 and change[g] <= after[limit - s] - 0.5:
            g += s
            number = holds[g].pop()
            after[g] -= 1
            before[g] = -after[g] if after[g] else np.inf
        else:
            g, number = limit, opened
            opened += 1
        sequence[k], offset[k] = number, limit - g
        if g > s:
            holds[g - s].append(number)
            after[g - s] += 1
            before[g - s] = -after[g - s]
    return sequence, offset


def packed(sizes: np.ndarray, limit: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, and the number of sequences, when pieces come in `order` and what was left in
    sequences that are not full is packed again."""
    sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    done, least = 0, len(sizes) + 1
    while len(order):
        got, at = sum_of_squares(sizes[order], limit)
        n = int(got.max()) + 1
        if n >= least:
            break
        sequence[order], offset[order] = got + done, at
        short = np.bincount(got, weights=sizes[order]) < limit
        # full sequences keep the first numbers, so that the others can be given anew
        number = np.where(short, np.cumsum(short) + n - int(short.sum()), np.cumsum(~short)) - 1
        sequence[order] = number[got] + done
        least = int(short.sum())
        done += n - least
        order = order[short[got]]
        order = order[np.argsort(-sizes[order], kind="stable")]
    return sequence, offset, int(sequence.max()) + 1 if len(sizes) else 0


def pieces(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for part in X.blocks(batch, "text", BLOCK):
                data, off = X.as_bytes(part.column("text"))
                u = ByteEncoder.of(path).units(data, off)
                total = np.bincount(u.doc, weights=u.size, minlength=part.num_rows).astype(np.int64) + 1
                begin = np.cumsum(total) - total
                ids = np.full(int(total.sum()), end_id, "<u4")
                text = np.ones(len(ids), bool)
                text[begin + total - 1] = False
                ids[text] = u.stream()
                count = -(-total // limit)
                doc = np.repeat(np.arange(part.num_rows), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                first = total - (count - 1) * limit  # tokens of the first piece, the only one that may be short
                start = np.where(piece > 0, first[doc] + (piece - 1) * limit, 0)
                length = np.where(piece > 0, limit, first[doc])
                raw, at = memoryview(ids).cast("B"), 4 * (begin[doc] + start)
                crc = [zlib.crc32(raw[a : a + n]) for a, n in zip(at.tolist(), (4 * length).tolist(), strict=True)]
                yield pa.record_batch({
                    "doc_id": part.column("doc_id").take(pa.array(doc)).cast(kind), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                })

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


def place(rows: DataFrame, limit: int = LIMIT, slices: int | None = None) -> DataFrame:
    """The rows (a unique long `row`, a `length` of 1 to limit - 1, and others) with sequence_id and offset.  A slice's
    number is above bit 32 of its sequences' ids."""
    slices = slices or max(1, round(rows.count() / SLICE))

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        size = table.column("length").to_numpy()
        dealt = np.argsort(table.column("row").to_numpy())
        dealt = dealt[np.random.default_rng(0).permutation(len(dealt))]
        sequence, offset, _ = min((packed(size, limit, o) for o in (dealt, dealt[np.argsort(-size[dealt], kind="stable")])), key=lambda p: p[2])
        sequence = sequence + (key[0].as_py() << 32)
        out = table.drop_columns(["slice"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from out.to_batches()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices))).groupBy("slice").applyInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(scratch: Scratch, docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of a document, with its place in a sequence.  The result reads tables of `scratch`."""
    rows = scratch.saved(pieces(docs, path, limit, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    full = rows.filter(F.col("length") == limit).select("*", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return place(rows.filter(F.col("length") < limit), limit).unionByName(full).drop("row")


def op13_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens, only longer documents being cut."""
    with Scratch(spark) as scratch:
        return saved(pack(scratch, spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER)), "best-fit")
