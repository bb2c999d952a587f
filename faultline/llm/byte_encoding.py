"""Encoding of whole texts with a byte-level BPE file of the tokenizers library, one distinct unit at a time.

Such a file has no normaliser and cuts a text by the usual byte-level pattern: contractions; an optional space and letters,
digits or signs; white space, whose last character goes to what follows.  Blocks of texts are cut into these units in
numpy, equal units are found by a 64-bit hash, and the library is asked once for each new one.  Words with an apostrophe
or with characters outside ASCII and Latin-1 letters are units as a whole, which the library cuts itself.  Texts with other
kinds of white space or with the start of an added token are given to the library whole.
"""

from __future__ import annotations

import json

import numpy as np
from tokenizers import Tokenizer

from . import _text as X
from .encoding import MEMORY, Memory, Units, _byte_letters

_KIND = np.full(256, 3, np.uint8)
_KIND[X.SPACE] = 0
_KIND[65:91] = _KIND[97:123] = _KIND[0x80:0xC0] = _KIND[0xC3] = 1
_KIND[48:58] = 2
_HARD = np.zeros(256, bool)
_HARD[[0x27, *range(0xC0, 0xC3), *range(0xC4, 0x100)]] = True
#: White space beyond `X.SPACE`, as UTF-8.
_WIDE = [bytes([c]) for c in range(0x1C, 0x20)] + [chr(c).encode() for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_LEADS = sorted({w[0] for w in _WIDE} | {ord("<")})


def checked(path: str) -> Tokenizer:
    """The tokenizer of the file, if it is of the kind described above."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = not spec["normalizer"] and not spec["post_processor"] and all(t["content"].startswith("<|") for t in spec["added_tokens"])
    if not plain or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["type"] != "BPE" or model["dropout"]:
        raise ValueError(f"{path} is not a byte-level BPE tokenizer of the supported kind")
    return Tokenizer.from_file(path)


class ByteEncoder:
    """Remembers units between blocks; one for each worker and file."""

    _made: dict[str, ByteEncoder] = {}

    def __init__(self, path: str):
        self.tokenizer = checked(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.memory = Memory()

    @classmethod
    def of(cls, path: str) -> ByteEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def whole(self, raw: bytes) -> list[int]:
        """The library's ids of a text."""
        return self.tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids

    def _ids(self, raw: bytes, whole: bool) -> list[int]:
        if whole:
            return self.whole(raw)
        letters = self.letters
        return [t.id for t in self.model.tokenize("".join([letters[b] for b in raw]))]

    @staticmethod
    def odd(data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Documents that the library must see whole."""
        found = []
        for lead in _LEADS:
            at = np.flatnonzero(data == lead)
            for w in [w for w in (*_WIDE, b"<|") if w[0] == lead]:
                here = at[at + len(w) <= len(data)]
                for k, byte in enumerate(w[1:], 1):
                    here = here[data[here + k] == byte]
                found.append(here)
        return np.unique(np.searchsorted(off, np.concatenate(found), "right") - 1)

    def units(self, data: np.ndarray, off: np.ndarray) -> Units:
        """The units of all texts, in order; together they hold every byte."""
        n = len(data)
        if not n:
            z = np.zeros(0, np.int64)
            return Units(z, z, z, z, z, np.zeros(0, np.uint32))
        kind = _KIND[data]
        lead = np.flatnonzero(data == 0xC3)
        lead = lead[lead + 1 < n]
        signs = lead[(data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7)]  # multiplication and division signs
        kind[signs] = kind[signs + 1] = 3
        edge = np.empty(n + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
        first = off[:-1][off[1:] > off[:-1]]
        edge[first] = edge[n] = True
        ws, we, _ = X.words(data, off)
        begins = np.zeros(n + 1, bool)
        begins[first] = True
        after = ws[~begins[ws]]  # words behind white space: its last character is cut off, and a space joins the word
        edge[after - 1] = True
        joined = after[data[after - 1] == 0x20]
        edge[joined] = False
        whole = np.zeros(n + 1, bool)
        hard = np.flatnonzero(_HARD[data])
        if len(hard):
            bad = np.unique(np.searchsorted(ws, hard, "right") - 1)
            a, b = ws[bad], we[bad]
            joint = ~edge[a]
            step = np.zeros(n + 1, np.int8)
            step[a + 1] += 1
            step[b] -= 1
            edge[np.cumsum(step) > 0] = False
            whole[np.where(joint, a - 1, a)] = True
        odd = self.odd(data, off)
        for d in odd.tolist():
            edge[off[d] + 1 : off[d + 1]] = False
        at = np.flatnonzero(edge)
        start, end = at[:-1], at[1:]
        flag = whole[start]
        doc = np.searchsorted(off, start, "right") - 1
        m = self.memory
        if len(m.ids) > 4 * MEMORY:
            m.forget()
        apart = np.isin(doc, odd) if len(odd) else np.zeros(len(start), bool)
        size, place = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        near = np.flatnonzero(~apart)
        if len(near):
            s, e, f = start[near], end[near], flag[near]
            h = X.hashes(data, s, e)
            h = np.where(f, X.mix(h + np.uint64(1)), h)
            got = m.places(h, lambda new: [(self._ids(data[s[k] : e[k]].tobytes(), bool(f[k])), True) for k in new])
            place[near], size[near] = m.first[got], m.size[got]
        ids = m.ids
        if len(odd):
            more = [np.array(self.whole(data[start[k] : end[k]].tobytes()), np.uint32) for k in np.flatnonzero(apart)]
            size[apart] = [len(x) for x in more]
            place[apart] = len(ids) + np.cumsum(size[apart]) - size[apart]
            ids = np.concatenate([ids, *more])
        return Units(start, end, doc, place, size, ids)
