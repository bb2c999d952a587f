"""Vectorised views of Arrow text columns, shared by the text operators of this subpackage.

A column is seen as one uint8 array of UTF-8 bytes with document offsets, so counting, hashing and run
detection are numpy passes instead of a Python loop for each word.  A null text is an empty text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_S33 = np.uint64(33)

#: `[\x20\x09-\x0D]`
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit changes every output bit with probability near one half."""
    h = (h ^ (h >> _S33)) * _M1
    h = (h ^ (h >> _S33)) * _M2
    return h ^ (h >> _S33)


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 64)
        p = np.full(size, _BASE, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


def as_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; len(offsets) is the row count plus one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def release() -> None:
    """Give freed memory back to the system: idle Python workers would otherwise hold it beside the JVM's next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def blocks(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of at most `most` text bytes; a longer text is a slice of its own.  Freed memory is given back
    after the last one."""
    _, off = as_bytes(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    release()


def runs(kind: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of maximal runs of equal non-zero `kind` that cross no document end."""
    n = len(kind)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:n])
    cut[off[(off < n)]] = True
    edge = np.flatnonzero(cut)
    start, end = edge[:-1], edge[1:]
    keep = kind[start] != 0
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(off, start, "right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; ranges are ascending and do not overlap."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    inside = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    value = (data[inside + np.repeat(start, size)].astype(np.uint64) + np.uint64(1)) * powers(int(size.max()))[inside]
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the words `[^\\x20\\x09-\\x0D]+`."""
    return runs((~SPACE[data]).view(np.uint8), off)


_W = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def windows(h: np.ndarray, n: int = 5) -> np.ndarray:
    """A hash of every n consecutive word hashes (n is at most 5); shorter input gives one hash of the whole."""
    if len(h) == 0:
        return h
    if len(h) < n:
        return mix(np.sum(h * np.array(_W[: len(h)]), keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    m = len(h) - n + 1
    total = h[:m] * _W[0]
    for k in range(1, n):
        total = total + h[k : k + m] * _W[k]
    return mix(total)


def per_document(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of `values` (one for each byte) over the documents."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]
