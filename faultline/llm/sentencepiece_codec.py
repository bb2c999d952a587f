"""SentencePiece encoding and decoding on the tokenizers library.

The model file is read with a small protobuf parser of our own: pieces, scores, types, trainer and normaliser settings.
From these the library's tokenizer is rebuilt: the precompiled character map, the dummy prefix and the metaspace marker
U+2581, a Unigram model with the scores or a BPE model whose merges come from the scores, and byte fallback.  Text is
cut before each run of markers, which changes nothing, since `rebuilt` makes sure that no piece holds a marker behind
another character; so the distinct units of a block of texts are encoded once, as multithreaded batches.

Parity with the sentencepiece library is verified on every distinct unit that a worker meets: it is encoded by both, and
a text with a unit that differs is reported with parity false.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows get equal values; decoding
gives the normalised text, and `lossless` says whether that is the text itself; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

from . import _text as X
from .encoding import Memory, gathered

MODEL = "piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
#: Units remembered by a worker; when full, the memory starts anew.
MEMORY = 2_000_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed-width values stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"wire type {kind} in a model file")
            size = varint()
        yield tag >> 3, raw[at : at + size]
        at += size


@dataclass
class Spec:
    """What a model file says.  Field numbers and defaults are those of the public sentencepiece_model.proto."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    unigram: bool = True
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix: bool = False


def parse(raw: bytes) -> Spec:
    s = Spec()
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    (score,) = struct.unpack("<f", v)
                elif n == 3:
                    kind = v
            s.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    s.unigram = v == 1
                    if v not in (1, 2):
                        raise ValueError("only unigram and BPE models can be rebuilt")
                elif n == 24:
                    s.suffix = bool(v)
                elif n == 35:
                    s.byte_fallback = bool(v)
                elif n == 40:
                    s.unk_id = v
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    s.charsmap = v
                elif n == 3:
                    s.dummy_prefix = bool(v)
                elif n == 4:
                    s.squeeze = bool(v)
                elif n == 5:
                    s.escape = bool(v)
    return s


def merges_of(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """BPE merges in order of use: the better the score of the whole, the earlier; then by the ids of the halves."""
    ids = {p: k for k, (p, _, _) in enumerate(pieces)}
    found = []
    for whole, score, kind in pieces:
        if kind == NORMAL or kind == USER:
            for cut in range(1, len(whole)):
                a, b = ids.get(whole[:cut]), ids.get(whole[cut:])
                if a is not None and b is not None:
                    found.append((-score, a, b, whole[:cut], whole[cut:]))
    return [(a, b) for *_, a, b in sorted(found)]


@dataclass
class Encoded:
    """Ids of a block of texts with document offsets, the decoded bytes with theirs, and flags of each document."""

    ids: np.ndarray
    at: np.ndarray
    text: np.ndarray
    text_at: np.ndarray
    parity: np.ndarray
    lossless: np.ndarray


class Codec:
    """Encodes and decodes with the rebuilt tokenizer; one for each worker and file."""

    _made: dict[str, Codec] = {}

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.spec = s = parse(f.read())
        if s.suffix or not s.escape or any(MARK in p.lstrip(MARK) for p, _, k in s.pieces if k in (NORMAL, USER)):
            raise ValueError("markers stand before words in supported models")
        if s.unigram:
            model = models.Unigram([(p, x) for p, x, _ in s.pieces], unk_id=s.unk_id, byte_fallback=s.byte_fallback)
        else:
            model = models.BPE({p: k for k, (p, _, _) in enumerate(s.pieces)}, merges_of(s.pieces), unk_token=s.pieces[s.unk_id][0], fuse_unk=True, byte_fallback=s.byte_fallback)
        self.tokenizer = Tokenizer(model)
        self.normalizer = normalizers.Precompiled(s.charsmap) if s.charsmap else None
        self.tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
        self.parity = sentencepiece.SentencePieceProcessor(model_file=path)
        spelled = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, _, k in s.pieces]
        self.size = np.array([len(x) for x in spelled], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)
        self.memory = Memory(MEMORY)

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def normalised(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the normalised texts, with plain spaces for markers and with the dummy prefix."""
        s = self.spec
        data, off = X.as_bytes(column)
        if self.normalizer is not None or s.squeeze or MARK.encode() in data.tobytes():
            texts = [(t or "").replace(MARK, " ") for t in column.to_pylist()]
            if self.normalizer is not None:
                texts = [self.normalizer.normalize_str(t) for t in texts]
            if s.squeeze:
                texts = [" ".join(x for x in t.split(" ") if x) for t in texts]
            data, off = X.as_bytes(pa.array(texts, pa.large_string()))
        if not s.dummy_prefix:
            return data, off
        some = np.flatnonzero(off[1:] > off[:-1])
        grown = np.insert(data, off[some], 32)
        return grown, off + np.searchsorted(some, np.arange(len(off)))

    def _learn(self, units: list[str]) -> list[tuple[list[int], bool]]:
        """Ids by the rebuilt tokenizer, in one multithreaded batch, and whether the sentencepiece library gives the same."""
        ours = self.tokenizer.encode_batch_fast([u.replace(" ", MARK) for u in units], add_special_tokens=False)
        # the library adds the dummy prefix itself, so it is given the unit without its first space; a unit without one begins no text
        plain = [u[1:] if self.spec.dummy_prefix and u.startswith(" ") else u for u in units]
        theirs = self.parity.encode(plain, num_threads=1)
        out = []
        for u, p, a, b in zip(units, plain, ours, theirs, strict=True):
            comparable = p and (p is not u or not self.spec.dummy_prefix) and not (self.spec.squeeze and p != p.strip(" "))
            out.append((a.ids, a.ids == b if comparable else self.spell(np.array(a.ids, np.int64)).tobytes().decode("utf-8", "replace") == u))
        return out

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the pieces, spaces for markers."""
        return gathered(self.flat, self.first[ids], self.size[ids])

    def encode(self, column) -> Encoded:
        """Encode and decode a column of texts; only the distinct units that are new go through the library."""
        data, off = self.normalised(column)
        n = len(off) - 1
        edge = np.zeros(len(data) + 1, bool)
        if len(data):
            space = data == 32
            edge[1:-1] = space[1:] & ~space[:-1]
            edge[off] = True
        start = np.flatnonzero(edge)[:-1]
        end = np.concatenate([start[1:], [len(data)]])[: len(start)]
        doc = np.searchsorted(off, start, "right") - 1
        m = self.memory
        at = m.places(X.hashes(data, start, end), lambda new: [g for k in range(0, len(new), 20_000) for g in self._learn([data[start[i] : end[i]].tobytes().decode("utf-8", "replace") for i in new[k : k + 20_000]])])
        size = m.size[at].astype(np.int64)
        ids = gathered(m.ids, m.first[at], size).astype(np.int64)
        count = np.bincount(doc, weights=size, minlength=n).astype(np.int64)
        ids_at = np.concatenate([[0], np.cumsum(count)])
        text = self.spell(ids)
        text_at = np.concatenate([[0], np.cumsum(self.size[ids])])[ids_at]
        if self.spec.dummy_prefix:
            drop = np.flatnonzero((text_at[1:] > text_at[:-1]))
            drop = drop[text[text_at[drop]] == 32]
            text = np.delete(text, text_at[drop])
            text_at = text_at - np.searchsorted(drop, np.arange(n + 1))
        parity = np.bincount(doc, weights=~m.flags[at], minlength=n) == 0
        raw, raw_off = X.as_bytes(column)
        same = (text_at[1:] - text_at[:-1]) == (raw_off[1:] - raw_off[:-1])
        if same.all():
            lossless = X.per_document(text != raw, raw_off) == 0
        else:
            lossless = np.array([bool(s) and np.array_equal(text[a:b], raw[c:d]) for s, a, b, c, d in zip(same, text_at[:-1], text_at[1:], raw_off[:-1], raw_off[1:], strict=True)])
        return Encoded(ids, ids_at, text, text_at, parity, lossless)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array), decoded, parity, lossless."""

    def run(batches):
        codec = Codec.of(path)
        for batch in batches:
            for part in X.blocks(batch, "text"):
                e = codec.encode(part.column("text"))
                raw = e.text.tobytes()
                back = [raw[a:b].decode("utf-8", "replace") for a, b in zip(e.text_at[:-1], e.text_at[1:], strict=True)]
                ids = pa.ListArray.from_arrays(pa.array(e.at.astype(np.int32)), pa.array(e.ids.astype(np.int32)))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "ids": ids, "decoded": pa.array(back, pa.string()), "parity": pa.array(e.parity), "lossless": pa.array(e.lossless)})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>, decoded string, parity boolean, lossless boolean")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian 32-bit ids), decoded_crc32 (of its UTF-8), parity, lossless: as `encode`, but small."""

    def run(batches):
        codec = Codec.of(path)
        for batch in batches:
            for part in X.blocks(batch, "text"):
                e = codec.encode(part.column("text"))
                ids, text = memoryview(e.ids.astype("<u4")).cast("B"), memoryview(e.text)
                yield pa.record_batch({
                    "doc_id": part.column("doc_id"), "n_ids": pa.array(np.diff(e.at)), "ids_crc32": pa.array([zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(e.at[:-1], e.at[1:], strict=True)], pa.int64()),
                    "decoded_crc32": pa.array([zlib.crc32(text[a:b]) for a, b in zip(e.text_at[:-1], e.text_at[1:], strict=True)], pa.int64()), "parity": pa.array(e.parity), "lossless": pa.array(e.lossless),
                })

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_ids long, ids_crc32 long, decoded_crc32 long, parity boolean, lossless boolean")


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids, decoded text (as checksums), parity and losslessness of every document."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(MODEL))
