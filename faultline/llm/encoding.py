"""Encoding of whole texts with a word-level BPE file of the tokenizers library, one distinct unit at a time.

Such a tokenizer (normaliser NFC, white space, lower case; pieces of letters, single digits or signs; no merge across
pieces) gives a text the ids of its pieces in order.  So a block of texts is cut into units in numpy, equal units are
found by a 64-bit hash, and the library is asked once for each new unit.  A unit is a piece where the word consists of
ASCII and Latin-1 characters without an apostrophe, and otherwise the whole word, which the library then normalises and
cuts itself.  `checked` makes sure at the start that the file is of this kind.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from tokenizers import Tokenizer

from . import _text as X

#: Units remembered by a worker (about 40 bytes each); when full, the memory starts anew.
MEMORY = 2_000_000

_KIND = np.full(256, 3, np.uint8)
_KIND[X.SPACE] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[0xC3] = _KIND[0x80:0xC0] = 1
_KIND[48:58] = 2
_HARD = np.zeros(256, bool)
_HARD[[0x27, *range(0x00, 0x09), *range(0x0E, 0x20), 0x7F, *range(0xC0, 0xC3), *range(0xC4, 0x100)]] = True


def checked(path: str) -> Tokenizer:
    """The tokenizer of the file, if it is of the kind described above."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    split = pre[0] if pre else {}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    same = steps == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre] == ["Split", "ByteLevel"] and split["pattern"] == {"Regex": pattern} and spec["model"]["type"] == "BPE" and not spec["post_processor"]
    if not same or pre[1]["add_prefix_space"] or pre[1]["use_regex"]:
        raise ValueError(f"{path} is not a word-level BPE tokenizer of the supported kind")
    return Tokenizer.from_file(path)


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def gathered(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges flat[first : first + size] one behind the other."""
    n = int(size.sum())
    return flat[np.arange(n, dtype=np.int64) + np.repeat(first - (np.cumsum(size) - size), size)]


@dataclass
class Units:
    """Units of a block of texts: byte range, document, and the ids of each as a range of `ids`."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    size: np.ndarray
    ids: np.ndarray

    def stream(self) -> np.ndarray:
        """The ids of all units, in order."""
        return gathered(self.ids, self.first, self.size)


class Memory:
    """Ids of units by 64-bit hash, in flat sorted arrays; `flags` has a truth value for each unit."""

    def __init__(self, most: int = MEMORY):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.key, self.first, self.size, self.ids, self.flags = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32), np.zeros(0, bool)

    def places(self, h: np.ndarray, make) -> np.ndarray:
        """Place of each hash in the arrays.  make(examples) gives (ids, flag) for the new ones, by an index into h each."""
        distinct, example, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.key) > self.most:
            self.forget()
        place = np.searchsorted(self.key, distinct)
        known = self.key[np.minimum(place, len(self.key) - 1)] == distinct if len(self.key) else np.zeros(len(distinct), bool)
        new = np.flatnonzero(~known)
        if len(new):
            got = make(example[new])
            size = np.array([len(g[0]) for g in got], np.int32)
            flat = np.fromiter((i for g in got for i in g[0]), np.uint32, int(size.sum()))
            key = np.concatenate([self.key, distinct[new]])
            first = np.concatenate([self.first, len(self.ids) + np.cumsum(size, dtype=np.int64) - size])
            order = np.argsort(key, kind="stable")
            self.key, self.first, self.size = key[order], first[order], np.concatenate([self.size, size])[order]
            self.flags = np.concatenate([self.flags, np.array([g[1] for g in got], bool)])[order]
            self.ids = np.concatenate([self.ids, flat])
            place = np.searchsorted(self.key, distinct)
        return place[back]


class Encoder:
    """Remembers units between blocks; one for each worker and file."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        self.tokenizer = checked(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.memory = Memory()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _ids(self, raw: bytes, whole: bool) -> list[int]:
        if whole:
            return self.tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids
        letters = self.letters
        return [t.id for t in self.model.tokenize("".join([letters[b] for b in raw]))]

    def units(self, data: np.ndarray, off: np.ndarray) -> Units:
        low = X.LOWER[data]
        high = np.flatnonzero(data == 0xC3) + 1
        up = high[(high < len(data))]
        up = up[(data[up] >= 0x80) & (data[up] <= 0x9E) & (data[up] != 0x97)]
        low[up] += 32
        kind = _KIND[data]
        times = high[high < len(data)]
        times = times[(data[times] == 0x97) | (data[times] == 0xB7)]  # multiplication and division signs are no letters
        kind[times] = kind[times - 1] = 3
        ws, we, wdoc = X.words(data, off)
        hard = np.flatnonzero(_HARD[data])
        bad = np.zeros(len(ws), bool)
        if len(hard):
            bad[np.searchsorted(ws, hard, "right") - 1] = True
            # an added token's text must stay whole for the library to find it
        angle = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if len(data) > 1 else hard[:0]
        if len(angle):
            bad[np.searchsorted(ws, angle, "right") - 1] = True
        edge = np.empty(len(data) + 1, bool)
        if len(data):
            edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
            edge[0] = edge[-1] = True
            edge[off[:-1][off[:-1] < len(data)]] = True
            for a, b in zip(ws[bad], we[bad], strict=True):
                edge[a + 1 : b] = False
                edge[a] = edge[b] = True
        at = np.flatnonzero(edge) if len(data) else np.zeros(0, np.int64)
        start, end = at[:-1], at[1:]
        keep = kind[start] != 0
        start, end = start[keep], end[keep]
        word = np.searchsorted(ws, start, "right") - 1
        whole = bad[word]
        text = low
        if bad.any():
            text = low.copy()
            inside = np.zeros(len(data) + 1, np.int8)
            inside[ws[bad]] += 1
            inside[we[bad]] -= 1
            text = np.where(np.cumsum(inside[:-1]) > 0, data, low)
        h = X.hashes(text, start, end)
        h = np.where(whole, X.mix(h + np.uint64(1)), h) if len(h) else h
        m = self.memory
        at = m.places(h, lambda new: [(self._ids(text[start[k] : end[k]].tobytes(), bool(whole[k])), True) for k in new])
        return Units(start, end, wdoc[word], m.first[at], m.size[at].astype(np.int64), m.ids)
