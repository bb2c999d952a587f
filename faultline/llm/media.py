"""Media columns: payloads stored as images in archives, and a Spark data source that reads archive directories.

Storing: each slice of a table writes ZIP archives of about `ARCHIVE` bytes below a shared folder, each member an 8-bit
grey PNG, 64 samples wide, whose samples are the payload bytes.  An archive is written under a temporary name and then
moved to a name that depends on the slice alone; a task that finds its archive there, by an earlier or a second attempt
on the same slice, leaves it as it is, so there is no moment without it.

Reading: `ArchiveSource` (format name `archives`) plans byte-range partitions from the names and sizes of the archives
alone.  A reader opens the archive at its end, takes the members whose local header lies in its range, and streams them
in Arrow batches of bounded size.  A member that cannot be read or fails its checksum is read again, from its own offset,
up to `retries` times, without reading its neighbours again; so is the archive's directory.

Folders may be of any kind that pyarrow.fs opens from a URI (file, hdfs, s3, gs).

Defined results: a null text is an empty payload, which still gets 64 zero bytes; repeated rows are members of their own
and equal texts have equal members; an empty table makes no archives and an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import os
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import _text as X
from ._store import new_path

UNIT = 64
#: Bytes of an archive, of a planned range and of a batch of payloads.
ARCHIVE, RANGE, BATCH = 32 << 20, 16 << 20, 8 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(raw: bytes) -> bytes:
    """An 8-bit grey PNG, 64 wide, of the bytes padded with zeros to a positive multiple of 64; the unpadded length is in a text chunk."""
    size = max(1, -(-len(raw) // UNIT)) * UNIT
    rows = np.zeros((size // UNIT, UNIT + 1), np.uint8)  # the first column is the filter type 0
    rows[:, 1:] = np.frombuffer(raw.ljust(size, b"\0"), np.uint8).reshape(-1, UNIT)
    head = struct.pack(">IIBBBBB", UNIT, size // UNIT, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0" + str(len(raw)).encode()) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """(payload, unpadded length) of an image made by `to_png`; every chunk's checksum is verified."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, width, height, n, data = 8, 0, 0, None, []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if struct.pack(">I", zlib.crc32(kind + body)) != media[at + 8 + size : at + 12 + size]:
            raise ValueError("a chunk fails its checksum")
        if kind == b"IHDR":
            width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", body)
            if (width, depth, colour) != (UNIT, 8, 0):
                raise ValueError("not 8-bit grey samples, 64 wide")
        elif kind == b"tEXt" and body.startswith(b"bytes\0"):
            n = int(body[6:])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any() or n is None:
        raise ValueError("a filter or no length, which this writer never makes")
    return rows[:, 1:].tobytes(), n


def feature(payload: bytes) -> str:
    """Mean, deviation, mean row-to-row difference and eight-bin histogram of the samples."""
    a = np.frombuffer(payload, np.uint8)
    hist = np.bincount(a >> 5, minlength=8)
    rows = a.reshape(-1, UNIT).astype(np.int64)
    total, squares = int(a.sum(dtype=np.int64)), int((a.astype(np.int64) ** 2).sum())
    mean = total / len(a)
    step = int(np.abs(np.diff(rows, axis=0)).sum()) / max(1, (len(rows) - 1) * UNIT)
    return f"mean={mean:.4f};dev={max(0.0, squares / len(a) - mean * mean) ** 0.5:.4f};step={step:.4f};hist={'/'.join(map(str, hist.tolist()))}"


def store(docs: DataFrame, folder: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Write the column's UTF-8 bytes as images in archives below `folder`; one row for each archive: name, members, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        task = TaskContext.get()
        system.create_dir(root, recursive=True)
        out: zipfile.ZipFile | None = None
        done, held, members = 0, None, 0

        def close():
            nonlocal out, done, members
            out.close()
            final = f"{root}/slice-{task.partitionId():06d}-{done:05d}.zip"
            temporary = f"{root}/_{task.taskAttemptId()}-{done}"
            with system.open_output_stream(temporary) as f:
                f.write(held.getbuffer())
            try:
                if system.get_file_info(final).type == fs.FileType.NotFound:
                    system.move(temporary, final)
            except OSError:  # another attempt was first
                if system.get_file_info(final).type == fs.FileType.NotFound:
                    raise
            if system.get_file_info(temporary).type != fs.FileType.NotFound:
                system.delete_file(temporary)
            row = pa.record_batch({"archive": pa.array([final]), "members": pa.array([members], pa.int64()), "bytes": pa.array([held.tell()], pa.int64())})
            out, done, members = None, done + 1, 0
            return row

        for batch in batches:
            for part in X.blocks(batch, column):
                data, off = X.as_bytes(part.column(column))
                for k, name in enumerate(part.column(key).to_pylist()):
                    if out is None:
                        held = io.BytesIO()
                        out = zipfile.ZipFile(held, "w", zipfile.ZIP_STORED)
                    label = "null" if name is None else str(name)
                    out.writestr(zipfile.ZipInfo(f"{members:08d}_{label}.png"), to_png(data[off[k] : off[k + 1]].tobytes()))
                    members += 1
                    if held.tell() > ARCHIVE:
                        yield close()
        if out is not None:
            yield close()

    return docs.select(key, column).mapInArrow(run, "archive string, members long, bytes long")


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.retries = int(options.get("retries", 3))
        self.range = int(options.get("rangebytes", options.get("rangeBytes", RANGE)))

    def partitions(self) -> list[Range]:
        """Ranges by file names and sizes alone; members are looked up by the readers."""
        system, root = _open(self.folder)
        found = sorted((f for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.path.endswith(".zip")), key=lambda f: f.path)
        return [Range(f.path, at, min(f.size, at + self.range)) for f in found for at in range(0, f.size, self.range)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = _open(self.folder)
        f = None

        def again(read):
            """read(handle), with a new handle for each further try."""
            nonlocal f
            for left in range(self.retries, -1, -1):
                try:
                    f = f or system.open_input_file(partition.path)
                    return read(f)
                except (OSError, ValueError, zipfile.BadZipFile):
                    if f:
                        f.close()
                    f = None
                    if not left:
                        raise
                    time.sleep(0.05 * (self.retries - left + 1))

        rows: list[tuple] = []
        size = 0
        try:
            for m in again(self.directory):
                if not partition.start <= m.header_offset < partition.end:
                    continue
                media = again(lambda handle: self.member(handle, m))  # noqa: B023  (called at once)
                rows.append((partition.path.rsplit("/", 1)[-1], m.filename, m.header_offset, media))
                size += len(media)
                if size > BATCH:
                    yield self.batch(rows)
                    rows, size = [], 0
        finally:
            if f:
                f.close()
        if rows:
            yield self.batch(rows)

    @staticmethod
    def directory(f) -> list[zipfile.ZipInfo]:
        f.seek(0)
        with zipfile.ZipFile(f) as z:
            return z.infolist()

    @staticmethod
    def member(f, m: zipfile.ZipInfo) -> bytes:
        """The stored bytes of one member, read from its own offset and held against its checksum."""
        f.seek(m.header_offset)
        head = f.read(30)
        if len(head) < 30 or head[:4] != b"PK\x03\x04":
            raise ValueError(f"no member at {m.header_offset}")
        name, extra = struct.unpack("<HH", head[26:30])
        f.seek(m.header_offset + 30 + name + extra)
        media = f.read(m.compress_size)
        if len(media) != m.compress_size or zlib.crc32(media) != m.CRC:
            raise ValueError(f"the member at {m.header_offset} fails its checksum")
        return media

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        archive, member, offset, media = zip(*rows, strict=True)
        return pa.record_batch({"archive": pa.array(archive, pa.string()), "member": pa.array(member, pa.string()), "offset": pa.array(offset, pa.int64()), "media": pa.array(media, pa.binary())})


class ArchiveSource(DataSource):
    """spark.read.format("archives").load(folder): archive, member, offset and media of every stored member."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return "archive string, member string, offset long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archives").options(**options).load(folder)


def described(media: DataFrame, kind: str = "bigint") -> DataFrame:
    """The stored key, sizes, checksums and the feature of every member read by `read_archives`."""
    number = pa.int64() if kind in ("bigint", "int") else pa.string()

    def run(batches):
        for batch in batches:
            rows = []
            for name, stored in zip(batch.column("member").to_pylist(), batch.column("media"), strict=True):
                raw = stored.as_py()
                payload, n = from_png(raw)
                key = name.split("_", 1)[1][:-4]
                rows.append((None if key == "null" else key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(payload)))
            keys, *cols = zip(*rows, strict=True) if rows else [()] * 8
            yield pa.record_batch({
                "doc_id": pa.array([int(k) if k is not None and number == pa.int64() else k for k in keys], number), "n_bytes": pa.array(cols[0], pa.int64()), "payload_bytes": pa.array(cols[1], pa.int64()), "payload_sha256": pa.array(cols[2], pa.string()),
                "tail_crc32": pa.array(cols[3], pa.int64()), "media_bytes": pa.array(cols[4], pa.int64()), "media_sha256": pa.array(cols[5], pa.string()), "feature": pa.array(cols[6], pa.string()),
            })

    return media.select("member", "media").mapInArrow(run, f"doc_id {'long' if number == pa.int64() else 'string'}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_media_columns(spark, sf_dir: str) -> DataFrame:
    """Store every document's bytes as an image in archives, read the archives back by the data source and describe them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_path(spark, "archives")
    store(docs, folder).write.parquet(new_path(spark, "archive-list"))
    return described(read_archives(spark, folder), dict(docs.dtypes)["doc_id"])
