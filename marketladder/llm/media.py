"""Media columns: payloads stored as images in archives, read back by a Spark data source.

``MediaArchives`` is a data source.  Its writer streams members into ZIP
archives, each of a bounded size, and publishes them in one manifest when all
tasks are done; files of failed attempts are never listed.  Its reader plans
byte ranges over the listed archives: a task reads the archive's directory and
streams the members that start within its range, as Arrow batches of bounded
size.  Each member is read by its own offset, checked, and tried again by
itself.  Paths are opened through Arrow's file systems, so the folder may be in
any store that they know.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

WIDTH = 192
MANIFEST = "_archives.json"
SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed by the image format


def padded(data: bytes) -> bytes:
    """The payload: spaces up to the next positive multiple of ``WIDTH``."""
    return data + b" " * (max(-(-len(data) // WIDTH), 1) * WIDTH - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_image(payload: bytes, level: int = 1) -> bytes:
    """A grey 8-bit image (PNG), one sample a byte, ``WIDTH`` samples a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line starts with filter 0
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines, level)) + _chunk(b"IEND", b"")


def samples(image: bytes) -> np.ndarray:
    """Samples of an image that ``to_image`` made, by row; checksums are verified."""
    if not image.startswith(SIGNATURE):
        raise ValueError("not an image of this format")
    at, packed, width = len(SIGNATURE), [], 0
    while at < len(image):
        size = struct.unpack_from(">I", image, at)[0]
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", image, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("a damaged chunk")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"IDAT":
            packed.append(body)
        at += size + 12
    return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, width + 1)[:, 1:]


def describe(pixels: np.ndarray) -> str:
    """Feature of an image: rows, mean, deviation, mean step between neighbours, and the shares of eight grey ranges."""
    wide = pixels.astype(np.int64)
    n = wide.size
    mean = wide.sum() / n
    deviation = max((wide * wide).sum() / n - mean * mean, 0.0) ** 0.5
    step = np.abs(np.diff(wide, axis=1)).mean()
    shares = np.bincount(pixels.ravel() >> 5, minlength=8) / n
    return f"rows={len(wide)};mean={mean:.4f};std={deviation:.4f};step={step:.4f};grey=" + ",".join(f"{s:.4f}" for s in shares)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[5:])


@dataclass
class Written(WriterCommitMessage):
    archives: list[tuple[str, int]]


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, archive_bytes: int):
        self.path, self.archive_bytes = path, archive_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _open(self.path)
        store.create_dir(folder, recursive=True)
        done: list[tuple[str, int]] = []
        sink = archive = None

        def close() -> None:
            nonlocal sink, archive
            if archive is not None:
                archive.close()
                done[-1] = (done[-1][0], sink.tell())
                sink.close()
            sink = archive = None

        for batch in iterator:
            for member, media in zip(batch.column(0), batch.column(1)):
                if archive is None:
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zip"
                    done.append((name, 0))
                    sink = store.open_output_stream(posixpath.join(folder, name))
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                archive.writestr(zipfile.ZipInfo(member.as_py()), media.as_buffer())
                if sink.tell() >= self.archive_bytes:
                    close()
        close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _open(self.path)
        store.create_dir(folder, recursive=True)
        listed = sorted(a for m in messages if m is not None for a in m.archives)
        with store.open_output_stream(posixpath.join(folder, MANIFEST)) as sink:
            sink.write("".join(json.dumps(a) + "\n" for a in listed).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing is listed, so nothing is read; the files are left to whoever owns the folder."""


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, batch_bytes: int, attempts: int):
        self.path, self.range_bytes, self.batch_bytes, self.attempts = path, range_bytes, batch_bytes, attempts

    def partitions(self) -> list[ByteRange]:
        store, folder = _open(self.path)
        with store.open_input_stream(posixpath.join(folder, MANIFEST)) as source:
            listed = [json.loads(line) for line in source.read().splitlines()]
        return [
            ByteRange(name, start, min(start + self.range_bytes, size))
            for name, size in listed
            for start in range(0, size, self.range_bytes)
        ] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        store, folder = _open(self.path)
        place = posixpath.join(folder, partition.archive)
        with store.open_input_file(place) as source, zipfile.ZipFile(source) as archive:
            members = [m for m in archive.infolist() if partition.start <= m.header_offset < partition.end]
        held: list[tuple[str, int, bytes]] = []
        size = 0
        for member in members:
            held.append((member.filename, member.header_offset, self.member(store, place, member)))
            size += len(held[-1][2])
            if size >= self.batch_bytes:
                yield self.batch(held)
                held, size = [], 0
        if held:
            yield self.batch(held)

    def member(self, store: fs.FileSystem, place: str, member: zipfile.ZipInfo) -> bytes:
        """One member by its offset, checked; on an error this member alone is read again."""
        for attempt in range(self.attempts):
            try:
                with store.open_input_file(place) as source:
                    lengths = source.read_at(4, member.header_offset + 26)
                    if len(lengths) != 4:
                        raise OSError(f"{place}: read cut short at {member.header_offset}")
                    name, extra = struct.unpack("<HH", lengths)
                    body = source.read_at(member.file_size, member.header_offset + 30 + name + extra)
                if len(body) != member.file_size or zlib.crc32(body) != member.CRC:
                    raise OSError(f"{place}: member at {member.header_offset} is damaged")
                return body
            except OSError:
                if attempt + 1 == self.attempts:
                    raise
        raise ValueError("attempts must be at least 1")

    @staticmethod
    def batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
        names, offsets, media = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(media, pa.binary())],
            ["member", "offset", "media"],
        )


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(path)`` and the writer of (member, media) rows.

    Options: path; archive_bytes (a new archive is begun beyond it); range_bytes
    (a read task's share of an archive); batch_bytes; attempts a member.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "member string, offset bigint, media binary"

    def _number(self, name: str, default: int) -> int:
        return int(self.options.get(name, default))

    def writer(self, schema: object, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], self._number("archive_bytes", 64 << 20))

    def reader(self, schema: object) -> ArchiveReader:
        numbers = self._number("range_bytes", 16 << 20), self._number("batch_bytes", 4 << 20), self._number("attempts", 3)
        return ArchiveReader(self.options["path"], *numbers)


def store_documents(docs: DataFrame, path: str) -> None:
    """Write every text's payload as an image; a member's name holds the id and the unpadded size."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, images, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = (text.as_py() or "").encode()
                names.append(f"{'null' if doc is None else doc}/{len(data)}.png")
                images.append(to_image(padded(data)))
                size += len(images[-1])
                if size >= 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(images, pa.binary())], ["member", "media"])
                    names, images, size = [], [], 0
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(images, pa.binary())], ["member", "media"])

    docs.sparkSession.dataSource.register(MediaArchives)
    rows = docs.select("doc_id", "text").mapInArrow(work, "member string, media binary")
    rows.write.format("media_archives").mode("append").save(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Digests and features of what the archives below ``path`` hold, one row per member.

    Null and empty texts are one row of spaces; a null id stays null; repeated
    rows give repeated members and rows; an empty table gives no rows.  Equal
    texts have equal values.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for member, media in zip(batch.column(0).to_pylist(), batch.column(2)):
                doc, _, size = member.removesuffix(".png").partition("/")
                image = media.as_py()
                pixels = samples(image)
                payload = pixels.tobytes()
                rows.append((
                    None if doc == "null" else int(doc), int(size), len(payload), hashlib.sha256(payload).hexdigest(),
                    zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), describe(pixels),
                ))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), KINDS)]
            yield pa.RecordBatch.from_arrays(columns, NAMES)

    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").load(path).mapInArrow(work, SCHEMA)


SCHEMA = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
    "media_bytes bigint, media_sha256 string, feature string"
)
NAMES = [field.split()[0] for field in SCHEMA.split(", ")]
KINDS = [pa.int64() if field.endswith("bigint") else pa.string() for field in SCHEMA.split(", ")]
