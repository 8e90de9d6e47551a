"""Media columns: payloads as images in archives, read by a Spark data source that plans byte ranges.

Writing: each task streams its payloads, as 8-bit grey PNG images 64 samples wide, into zip archives (members stored as
they are) of at most ``ARCHIVE`` bytes in the shared folder. Names carry the task attempt, and the manifest lists only
archives of attempts that succeeded.

Reading: ``ArchiveSource`` plans partitions of ``RANGE`` bytes (more, where that were over ``PLANNED``) from the manifest alone, one row an archive; no member is
listed on the driver. A task reads the archive's directory, keeps the members that begin in its range, and streams them in
Arrow batches of about ``BATCH`` bytes. Each member is read by its offset and checked against the directory's crc; a
failing member is retried by itself on a fresh handle, and the members before it are not read again.

Null and empty texts are one row of 64 zero bytes. Repeated rows are members of their own (names hold a running number). An
empty table gives no archives and no rows. Further columns are not read. Null ids are kept.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import common
from .tokenfile import file_system

WIDTH = 64
ARCHIVE = 256 << 20
RANGE = 16 << 20
PLANNED = 100_000
BATCH = 4 << 20
ATTEMPTS = 4
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEMA = "member string, offset long, media binary"


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes appended up to a positive multiple of the image width."""
    return data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH), b"\0")


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with its filter, 0: none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """Samples of an image that ``to_png`` made; anything else is a ValueError."""
    if not media.startswith(SIGNATURE):
        raise ValueError("not a PNG image")
    at, body, height = len(SIGNATURE), [], 0
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        part = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", part)
            if (width, depth, colour) != (WIDTH, 8, 0):
                raise ValueError("not an 8-bit grey image of the expected width")
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("a line is filtered")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy (bits a sample) of the samples."""
    n = np.bincount(np.frombuffer(payload, np.uint8), minlength=256) / len(payload)
    level = np.arange(256)
    mean = float(n @ level)
    p = n[n > 0]
    return f"{mean:.4f} {float(n @ (level - mean) ** 2) ** 0.5:.4f} {float(-(p * np.log2(p)).sum()):.4f}"


def archiver(folder: str, limit: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, place = file_system(folder)
        system.create_dir(place, recursive=True)
        stem = f"{place}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}"
        made: list[dict] = []
        sink = archive = None
        size = count = 0

        def close() -> None:
            archive.close()
            made[-1] |= {"n_bytes": sink.tell(), "members": count}
            sink.close()

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                data = (text.as_py() or "").encode()
                media = to_png(padded(data))
                if archive is not None and size + len(media) > limit:
                    close()
                    archive = None
                if archive is None:
                    made.append({"path": f"{stem}-{len(made)}.zip"})
                    sink = system.open_output_stream(made[-1]["path"])
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                    size = count = 0
                archive.writestr(zipfile.ZipInfo(f"{'' if doc_id is None else doc_id}_{len(data)}_{count}.png"), media)
                size += len(media)
                count += 1
        if archive is not None:
            close()
        yield pa.RecordBatch.from_pylist(made, pa.schema([("path", pa.string()), ("n_bytes", pa.int64()), ("members", pa.int64())]))

    return write


def write_archives(docs: DataFrame, folder: str, limit: int = ARCHIVE) -> str:
    """Writes archives under ``folder`` and returns the path of their manifest, a Parquet table with a row an archive."""
    manifest = f"{folder}/manifest"
    docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(archiver(f"{folder}/archives", limit), "path string, n_bytes long, members long").write.parquet(manifest)
    return manifest


class ByteRange(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


def read_member(source, offset: int, size: int, crc: int) -> bytes:
    """The stored bytes of the member whose header is at ``offset``."""
    source.seek(offset)
    head = source.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no member at {offset}")
    name, extra = struct.unpack("<HH", head[26:30])
    source.seek(offset + 30 + name + extra)
    data = source.read(size)
    if len(data) != size or zlib.crc32(data) != crc:
        raise ValueError(f"member at {offset} is damaged")
    return data


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.manifest = options["manifest"]
        self.range = int(options.get("range", RANGE))
        self.attempts = int(options.get("attempts", ATTEMPTS))

    def partitions(self) -> list[ByteRange]:
        import pyarrow.dataset as ds

        system, place = file_system(self.manifest)
        rows = ds.dataset(place, filesystem=system, format="parquet").to_table(columns=["path", "n_bytes"]).to_pylist()
        # Ranges grow with the archives, so that the plan stays within some PLANNED partitions on the driver.
        step = max(self.range, -(-sum(r["n_bytes"] for r in rows) // PLANNED))
        return [ByteRange(r["path"], low, low + step) for r in sorted(rows, key=lambda r: r["path"]) for low in range(0, r["n_bytes"], step)]

    def open(self, path: str):
        return file_system(self.manifest)[0].open_input_file(path)

    def read(self, part: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark asks so when nothing was planned
            return
        source = self.open(part.path)
        members = [m for m in zipfile.ZipFile(source).infolist() if part.low <= m.header_offset < part.high]
        names, offsets, media, size = [], [], [], 0
        for m in members:
            for attempt in range(self.attempts):
                try:
                    data = read_member(source, m.header_offset, m.compress_size, m.CRC)
                    break
                except (OSError, ValueError):
                    if attempt + 1 == self.attempts:
                        raise
                    time.sleep(0.1 * 2**attempt)
                    source = self.open(part.path)
            names.append(m.filename)
            offsets.append(m.header_offset)
            media.append(data)
            size += len(data)
            if size >= BATCH:
                yield self.batch(names, offsets, media)
                names, offsets, media, size = [], [], [], 0
        if names:
            yield self.batch(names, offsets, media)

    @staticmethod
    def batch(names: list[str], offsets: list[int], media: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(offsets, pa.int64()), pa.array(media, pa.binary())], names=["member", "offset", "media"])


class ArchiveSource(DataSource):
    """``spark.read.format("archive_members").option("manifest", path)``: (member, offset, media)."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, manifest: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive_members").options(manifest=manifest, **options).load()


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for name, value in zip(batch.column("member").to_pylist(), batch.column("media"), strict=True):
            media = value.as_py()
            payload = from_png(media)
            doc_id, n_bytes, _ = name.split("_")
            out.append((int(doc_id) if doc_id else None, int(n_bytes), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [c.split()[0] for c in FEATURES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names=names)


def describe(media: DataFrame) -> DataFrame:
    """Samples and features of members read back."""
    return media.select("member", "media").mapInArrow(described, FEATURES)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(common.table(spark, sf_dir, "documents"), common.new_dir(spark, "media"))
    return describe(read_archives(spark, manifest))
