"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that each decompress alone. A bundle ends with
two skippable frames: an index of record identifiers (frame, offset inside the
decompressed frame, length) and the seek table of the public seekable format
(sizes and checksums of all frames), whose fixed footer closes the file. A
reader thus finds any record by two small reads and one frame.

Payloads that are equal are stored once: of those with enough bytes the page of
the smallest id is the response, the others revisit it. One aggregate with
partial sums finds the smallest id of each repeated digest; the pages then join
to the repeated digests alone, so a digest of a third of all pages is one row
on one side and a side that adaptive execution splits on the other.

Defined cases: a null payload is an empty one; payloads below the bound are all
responses; a null url has no target header; control characters of a url are
percent-encoded; rows with a null id are responses if their payload isn't
repeated or none of its ids is known, else revisits; rows that repeat the
smallest id are responses all. An empty table gives an empty result and no
bundle; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from ._common import file_system, scratch, stored, table, write_file

SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 256 << 20, 3
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _id(value) -> str:
    return f"<urn:page:{'null' if value is None else value}>"


def _value(record_id: str) -> str | None:
    text = record_id.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "null" else text


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, is_revisit: bool, date: str) -> bytes:
    head = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", _id(page_id)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if is_revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _id(refers_to))]
    block = HTTP_HEAD if is_revisit else HTTP_HEAD + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at an offset."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no record begins here")
    head = dict(line.split(": ", 1) for line in lines)
    start = end + 4
    stop = start + int(head["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    return head, data[start:stop], stop + 4


class BundleWriter:
    """Collects records into frames; ``finish`` returns the closing frames."""

    def __init__(self, emit, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        import zstandard

        self.emit, self.frame_bytes = emit, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frame, self.size, self.seek, self.index, self.total = [], 0, [], [], 0

    def add(self, record_id: str, data: bytes) -> None:
        if self.size and self.size + len(data) > self.frame_bytes:
            self._close()
        self.index.append((record_id, len(self.seek), self.size, len(data)))
        self.frame.append(data)
        self.size += len(data)
        self.total += len(data)

    def _close(self) -> None:
        import xxhash

        data = b"".join(self.frame)
        packed = self.zstd.compress(data)
        self.emit(packed)
        self.seek.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.frame, self.size = [], 0

    def finish(self) -> None:
        if self.size:
            self._close()
        body = self.zstd.compress(json.dumps(self.index).encode())
        self.emit(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        self.seek.append((len(body) + 8, 0, 0))
        table = b"".join(struct.pack("<III", *x) for x in self.seek) + struct.pack("<IBI", len(self.seek), 0x80, SEEK_MAGIC)
        self.emit(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class BundleReader:
    """Random access to the records of one bundle."""

    def __init__(self, stream):
        import zstandard

        self.stream, self.zstd = stream, zstandard.ZstdDecompressor()
        size = stream.seek(0, 2) or stream.tell()
        frames, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError("no seek table closes this file")
        length = 12 * frames + 9
        kind, own = struct.unpack("<II", self._read(size - length - 8, 8))
        if (kind, own) != (SKIPPABLE_SEEK, length):
            raise ValueError("the seek table is damaged")
        rows = self._read(size - length, 12 * frames)
        self.frames, at = [], 0
        for packed, plain, check in struct.iter_unpack("<III", rows):
            self.frames.append((at, packed, plain, check))
            at += packed

    def _read(self, at: int, size: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(size)

    def frame(self, k: int) -> bytes:
        import xxhash

        at, packed, plain, check = self.frames[k]
        data = self.zstd.decompress(self._read(at, packed))
        if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def index(self) -> dict[str, list[tuple[int, int, int]]]:
        """Record identifier to its (frame, offset, length) places."""
        at, packed, _, _ = self.frames[-1]
        found: dict[str, list[tuple[int, int, int]]] = {}
        for name, frame, offset, length in json.loads(self.zstd.decompress(self._read(at + 8, packed - 8))):
            found.setdefault(name, []).append((frame, offset, length))
        return found

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        head, block, _ = parse(self.frame(frame), offset)
        return head, block

    def records(self):
        for k in range(len(self.frames) - 1):
            data, at = self.frame(k), 0
            while at < len(data):
                head, block, at = parse(data, at)
                yield head, block


def decided(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """page_id, url, payload, digest, first: first is set where a page revisits it."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    repeated = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter(F.col("n") > 1).drop("n")
    first = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    return rows.join(repeated, "digest", "left").withColumn("first", first)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 100, date: str = "2024-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes bundles into the shared folder; returns (path, records, bytes).

    Files of a repeated task have names of their own; only the attempt that
    ended well is listed.
    """

    def run(batches):
        shard, rows = TaskContext.get().partitionId(), iter(row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first")), strict=True))
        row, number = next(rows, None), 0
        while row is not None:
            path = f"{folder}/part-{shard:05d}-{number:03d}-{uuid.uuid4().hex[:12]}.warc.zst"
            state = {"records": 0}

            def fill(stream, state=state):
                nonlocal row
                writer = BundleWriter(stream.write, frame_bytes)
                while row is not None and writer.total < bundle_bytes:
                    page_id, url, payload, digest, first = row
                    writer.add(_id(page_id), record(page_id, url, payload, digest, first, first is not None, date))
                    state["records"] += 1
                    row = next(rows, None)
                writer.finish()
                state["bytes"] = writer.total

            write_file(path, fill)
            number += 1
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([state["records"]], pa.int64()), "bytes": pa.array([state["bytes"]], pa.int64())})

    rows = decided(pages, id_col, url_col, payload_col, least_bytes).select("page_id", "url", "payload", "digest", "first")
    return stored(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def read(manifest: DataFrame, id_type="long") -> DataFrame:
    """One row per record of the listed bundles, checked against its digest."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    schema = StructType().add("page_id", StringType()).add("payload_bytes", LongType()).add("payload_digest", StringType()).add("record_type", StringType()).add("refers_to", StringType())

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, inside = file_system(path)
                out: list[tuple] = []
                with fs.open_input_file(inside) as stream:
                    for head, block in BundleReader(stream).records():
                        kind, digest, size = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                        if kind == "response":
                            payload = block[len(HTTP_HEAD) :]
                            if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
                                raise ValueError(f"{head['WARC-Record-ID']} in {path} is damaged")
                        refers = _value(head["WARC-Refers-To"]) if kind == "revisit" else None
                        out.append((_value(head["WARC-Record-ID"]), size, digest, kind, refers))
                        if len(out) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=names)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=names)

    files = manifest.select("path")
    files = files.repartition(max(1, files.count()), "path")
    found = files.mapInArrow(run, schema)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def query(spark, sf_dir: str) -> DataFrame:
    """op9: all pages, written and read back."""
    pages = table(spark, sf_dir, "pages")
    return read(write(pages, scratch(spark, "warc")), pages.schema["page_id"].dataType)


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
