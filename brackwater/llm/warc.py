"""WARC records in seekable Zstandard bundles, with an index from record identifiers to places in frames.

Writing: a record a row, each a whole WARC/1.1 record with an HTTP block. Rows whose payloads are equal and have ``LEAST``
bytes or more are told once: that with the largest page_id as ``response``, the others as ``revisit`` records that name it;
smaller payloads are always responses. Each task streams its records into bundles: consecutive records of about ``FRAME``
bytes are one independent Zstandard frame, and behind the last frame of a bundle stands the seek table of the public
seekable format, a skippable frame of all frames' sizes. Any Zstandard tool reads a bundle from end to end; a reader that
knows the table reads one frame by its place. Names carry the task attempt, and the index lists only bundles of attempts
that succeeded.

The index (Parquet, a row a frame) holds the identifiers of a frame's records and their offsets within the frame:
``located`` makes a row a record of it, and ``lookup`` reads the records of given identifiers, a frame each at most once.

Null and empty texts are payloads of no bytes. Null ids are kept and take part as duplicates, but are no target while any
id is known; rows of equal payloads that all lack an id are all responses. Repeated rows of the largest id are each a
response. A null url is left out of the record. Line ends within a url are escaped. An empty table gives no bundles and no
rows. Further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokenfile import file_system

LEAST = 1000
FRAME = 1 << 20
BUNDLE = 1 << 30
LEVEL = 3
#: Frames that one task reads back.
TOGETHER = 16
#: The pages have no time of capture; a record must have one.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed values of the seekable format: number of the skippable frame, number at the end, and the descriptor (no checksums).
SKIPPABLE, SEEKABLE, PLAIN = 0x184D2A5E, 0x8F92EAB1, 0
INDEX = "path string, frame long, at long, stored long, bytes long, page_ids array<long>, offsets array<long>"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class Record(NamedTuple):
    """A record as it is read back. ``payload`` is None for revisits."""

    page_id: int | None
    kind: str
    url: str | None
    payload_bytes: int
    digest: str
    refers_to: int | None
    payload: bytes | None


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    name = identifier.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit of ``refers_to``; the HTTP head of a revisit keeps the length of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(data: memoryview | bytes, at: int) -> tuple[Record, int]:
    """The record at ``at`` of a frame's bytes, and where it ends. A payload that its digest does not fit is a ValueError."""
    body = data.index(b"\r\n\r\n", at) + 4
    lines = bytes(data[at : body - 4]).decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    end = body + int(head["Content-Length"])
    http = data.index(b"\r\n\r\n", body, end) + 4
    declared = int(dict(line.split(": ", 1) for line in bytes(data[body : http - 4]).decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    payload = bytes(data[http:end]) if head["WARC-Type"] == "response" else None
    if payload is not None and (len(payload) != declared or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {head['WARC-Record-ID']} is damaged")
    url = head.get("WARC-Target-URI")
    url = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    target = head.get("WARC-Refers-To")
    return Record(page_of(head["WARC-Record-ID"]), head["WARC-Type"], url, declared, digest, page_of(target) if target else None, payload), end + 4


class BundleWriter:
    """Streams frames to ``sink`` and ends with their seek table."""

    def __init__(self, sink):
        import zstandard

        self.sink, self.compressor = sink, zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.sizes: list[tuple[int, int]] = []
        self.at = 0

    def frame(self, data: bytes) -> tuple[int, int, int]:
        """Writes a frame; (its number, its place, its stored bytes)."""
        stored = self.compressor.compress(data)
        self.sink.write(stored)
        self.sizes.append((len(stored), len(data)))
        self.at += len(stored)
        return len(self.sizes) - 1, self.at - len(stored), len(stored)

    def close(self) -> None:
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), PLAIN, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.sink.close()


class BundleReader:
    """Frames of a bundle by number, through the seek table at its end."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        source.seek(end - 9)
        n, descriptor, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        width = 12 if descriptor & 0x80 else 8  # another writer may add a checksum to each entry
        source.seek(end - 9 - n * width - 8)
        head = source.read(8)
        if struct.unpack("<II", head) != (SKIPPABLE, n * width + 9):
            raise ValueError("the seek table is damaged")
        table = source.read(n * width)
        self.places: list[tuple[int, int, int]] = []
        at = 0
        for i in range(n):
            stored, size = struct.unpack_from("<II", table, i * width)
            self.places.append((at, stored, size))
            at += stored

    def frame(self, i: int) -> bytes:
        import zstandard

        at, stored, size = self.places[i]
        self.source.seek(at)
        data = zstandard.ZstdDecompressor().decompress(self.source.read(stored), max_output_size=size)
        if len(data) != size:
            raise ValueError(f"frame {i} is damaged")
        return data


def payload() -> Column:
    return F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")


def told_once(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``pages`` (page_id, url, html) with digest and refers_to (null: a response).

    Only digests and ids are grouped. Digests that occur twice are joined back: told to every task where they are few, else
    shuffled, where a row with no twin has a key of its own and AQE splits the rows of a hot digest.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("digest", F.sha1(payload())).withColumn("long", F.octet_length(payload()) >= least)
    twins = common.written(rows.filter("long").groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("newest")).filter("n > 1 and newest is not null"), "twins")
    twins = twins.select(F.col("digest").alias("twin"), "newest")
    key = F.when(F.col("long"), F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.xxhash64("url").cast("string"))))
    joined = rows.join(common.small(twins), key == F.col("twin"), "left")
    same = F.coalesce(F.col("page_id") == F.col("newest"), F.lit(False))
    return joined.select("page_id", "url", "html", "digest", F.when(~same, F.col("newest")).alias("refers_to"))


def writer(folder: str, frame: int, bundle: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, place = file_system(folder)
        system.create_dir(place, recursive=True)
        stem = f"{place}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}"
        out, n_bundles, size, held = None, 0, 0, 0
        ids: list[int | None] = []
        offsets: list[int] = []
        records: list[bytes] = []
        path = ""

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            number, at, stored = out.frame(b"".join(records))
            row = {"path": path, "frame": number, "at": at, "stored": stored, "bytes": held, "page_ids": list(ids), "offsets": list(offsets)}
            size += held
            held = 0
            for kept in (ids, offsets, records):
                kept.clear()
            return pa.RecordBatch.from_pylist([row], pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("frame", "at", "stored", "bytes")), ("page_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64()))]))

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")]
            for values in zip(*columns, strict=True):
                page_id, url, html, digest, refers_to = (v.as_py() for v in values)
                if out is None:
                    path = f"{stem}-{n_bundles}.warc.zst"
                    out, size = BundleWriter(system.open_output_stream(path, compression=None)), 0
                    n_bundles += 1
                record = encode_record(page_id, url, (html or "").encode(), digest, refers_to)
                ids.append(page_id)
                offsets.append(held)
                records.append(record)
                held += len(record)
                if held >= frame:
                    yield flush()
                    if size >= bundle:
                        out.close()
                        out = None
        if out is not None:
            if records:
                yield flush()
            out.close()

    return write


def write_bundles(pages: DataFrame, folder: str, least: int = LEAST, frame: int = FRAME, bundle: int = BUNDLE) -> DataFrame:
    """Writes bundles under ``folder`` and their index beside them; returns the index, a row a frame."""
    spark = pages.sparkSession
    told_once(pages, least).mapInArrow(writer(f"{folder}/bundles", frame, bundle), INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def located(index: DataFrame) -> DataFrame:
    """(page_id, path, frame, offset): where the record of an identifier begins, within the bytes of its frame."""
    pairs = F.explode(F.arrays_zip("page_ids", "offsets")).alias("r")
    return index.select("path", "frame", pairs).select(F.col("r.page_ids").alias("page_id"), "path", "frame", F.col("r.offsets").alias("offset"))


def reader(folder: str, whole: bool):
    """Reads frames. ``whole``: all records of each; else those at ``offsets``, with their payloads."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        names = Record._fields if not whole else [c.split()[0] for c in RECORDS.split(", ")]
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
        opened: tuple[str, BundleReader | None] = ("", None)
        for batch in batches:
            for row in batch.select(["path", "frame", "offsets"]).to_pylist():
                if opened[0] != row["path"]:
                    if opened[1]:
                        opened[1].source.close()
                    opened = (row["path"], BundleReader(system.open_input_file(row["path"])))
                data = opened[1].frame(row["frame"])
                out, at = [], 0
                if whole:
                    while at < len(data):
                        r, at = decode_record(data, at)
                        out.append({"page_id": r.page_id, "payload_bytes": r.payload_bytes, "payload_digest": r.digest, "record_type": r.kind, "refers_to": r.refers_to})
                else:
                    out = [decode_record(data, at)[0]._asdict() for at in row["offsets"]]
                yield pa.RecordBatch.from_pylist(out, schema)
        if opened[1]:
            opened[1].source.close()

    return read


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the bundles, from their bytes: payloads are checked against their digests and not returned."""
    frames = index.select("path", "frame", F.array().cast("array<long>").alias("offsets"))
    # As many partitions as asked for, each of some neighbouring frames: tiny rows, whose reading is the work.
    return frames.repartitionByRange(max(1, -(-index.count() // TOGETHER)), "path", "frame").mapInArrow(reader(f"{folder}/bundles", True), RECORDS)


def lookup(index: DataFrame, folder: str, ids: DataFrame) -> DataFrame:
    """The records of the page_ids in ``ids``, with payloads (null for revisits). Frames without one of them are not read."""
    wanted = ids.select(F.col("page_id").cast("long").alias("page_id")).distinct()
    found = located(index).join(common.small(wanted), "page_id", "left_semi").groupBy("path", "frame").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    return found.mapInArrow(reader(f"{folder}/bundles", False), "page_id long, kind string, url string, payload_bytes long, digest string, refers_to long, payload binary")


def op11_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_dir(spark, "warc")
    return read_bundles(write_bundles(common.table(spark, sf_dir, "pages"), folder), folder)


OP11_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
g as (select *, max(page_id) over (partition by payload_digest) as newest from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> newest then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> newest then newest end as refers_to
from g
"""
