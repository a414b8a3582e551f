"""Seekable Zstandard WARC bundles.

A bundle is a WARC file in independent Zstandard frames, so ``zstd -d`` gives plain
WARC, followed by two skippable frames: a record index (record id, frame, offset in the
frame) and, last, a seek table in the public seekable format, which says where each
frame lies. One record is read by decompressing its frame alone.

Equal payloads are stored once: the page with the smallest id holds the response and
the others are revisit records that name it. Which page that is comes from one
aggregation of digests, combined before the shuffle, and a join that AQE can split.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from functools import partial

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize, new_path, open_fs, write_atomic

# Fixed values of the public Zstandard formats.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

FRAME_BYTES = 1 << 20
FRAME_RECORDS = 256


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def page_of(rid: str) -> int | None:
    own = rid.split(":")[2]
    return int(own) if own else None


def warc_record(page_id: int | None, url: str | None, payload: bytes | None, n_bytes: int, digest: str, first: int | None, date: str) -> bytes:
    """A response record, or with payload None a revisit of page ``first``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if payload is None:
        head.append(f"WARC-Refers-To: {record_id(first, digest)}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, end) of the record at an offset."""
    cut = raw.index(b"\r\n\r\n", at)
    lines = raw[at:cut].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record at this offset")
    head = dict(x.split(": ", 1) for x in lines[1:])
    begin = cut + 4
    end = begin + int(head["Content-Length"])
    block = raw[begin:end]
    split = block.index(b"\r\n\r\n") + 4
    http = dict(x.split(": ", 1) for x in block[: split - 4].decode().split("\r\n")[1:])
    head["Payload-Length"] = http["Content-Length"]
    return head, block[split:], end + 4


class BundleWriter:
    def __init__(self, level: int = 3):
        self.packer = zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.waiting = 0
        self.index: list[list] = []

    def add(self, rid: str, record: bytes) -> None:
        self.index.append([rid, len(self.frames), self.waiting])
        self.open.append(record)
        self.waiting += len(record)
        if self.waiting >= FRAME_BYTES or len(self.open) >= FRAME_RECORDS:
            self._close()

    def _close(self) -> None:
        if self.open:
            raw = b"".join(self.open)
            self.frames.append(self.packer.compress(raw))
            self.sizes.append((len(self.frames[-1]), len(raw)))
            self.open, self.waiting = [], 0

    def finish(self) -> bytes:
        self._close()
        index = self.packer.compress(json.dumps(self.index).encode())
        table = b"".join(struct.pack("<II", *x) for x in [*self.sizes, (len(index) + 8, 0)])
        foot = struct.pack("<IBI", len(self.sizes) + 1, 0, SEEKABLE_MAGIC)
        return b"".join([*self.frames, struct.pack("<II", SKIPPABLE_INDEX, len(index)), index, struct.pack("<II", SKIPPABLE_SEEK, len(table) + len(foot)), table, foot])


class BundleReader:
    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        table = self.file.read_at(8 * n, size - 9 - 8 * n)
        sizes = [struct.unpack_from("<II", table, 8 * i) for i in range(n)]
        self.starts = [0]
        for packed, _ in sizes:
            self.starts.append(self.starts[-1] + packed)
        self.unpacker = zstandard.ZstdDecompressor()
        *self.sizes, (own, _) = sizes
        self.index = json.loads(self.unpacker.decompress(self.file.read_at(own - 8, self.starts[n - 1] + 8)))
        self._last: tuple[int, bytes] = (-1, b"")

    def frame(self, i: int) -> bytes:
        if self._last[0] != i:
            self._last = i, self.unpacker.decompress(self.file.read_at(self.sizes[i][0], self.starts[i]))
        return self._last[1]

    def record(self, place: list) -> tuple[dict[str, str], bytes]:
        rid, frame, offset = place
        head, payload, _ = parse_record(self.frame(frame), offset)
        if head["WARC-Record-ID"] != rid:
            raise ValueError(f"the index of {rid} names another record")
        return head, payload


_MANIFEST = "file string, n_records long"
#: Bytes of one bundle's compressed frames, about; a partition with more goes to several.
BUNDLE_BYTES = 64 << 20


def _write(batches, folder: str, level: int, date: str):
    part, k, packed = TaskContext.get().partitionId(), 0, 0
    out = BundleWriter(level)

    def close():
        uri = f"{folder}/part-{part:08d}-{k:04d}.warc.zst"
        write_atomic(uri, out.finish())
        return pa.RecordBatch.from_pydict({"file": [uri], "n_records": pa.array([len(out.index)])})

    for batch in batches:
        columns = [batch.column(x) for x in ("page_id", "url", "payload", "payload_bytes", "sha1", "first_id")]
        for i in range(batch.num_rows):
            page, url, payload, n_bytes, sha, first = (c[i].as_py() for c in columns)
            digest = base64.b32encode(bytes.fromhex(sha)).decode()
            frames = len(out.frames)
            out.add(record_id(page, digest), warc_record(page, url, payload, n_bytes, digest, first, date))
            if len(out.frames) > frames:
                packed += len(out.frames[-1])
                if packed >= BUNDLE_BYTES:
                    yield close()
                    out, k, packed = BundleWriter(level), k + 1, 0
    if out.index:
        yield close()


def write_bundles(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of ``pages(page_id, url, html)``; returns the manifest (file, n_records).

    Null html is an empty payload and a null url leaves its header out. Of equal
    payloads of at least ``min_revisit_bytes``, every row with the smallest page_id is a
    response (repeated rows too) and the others revisit it; a null page_id is never the
    smallest, and where a payload has no other page_id, all its rows are responses.
    Other columns are not read; an empty table writes no file.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    shared = rows.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    shared = materialize(shared.select(F.col("sha1").alias("shared_sha1"), "first_id"), "payloads")
    rows = rows.join(shared, F.col("sha1") == F.col("shared_sha1"), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = rows.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "sha1", "first_id")
    return materialize(rows.mapInArrow(partial(_write, folder=folder, level=level, date=date), _MANIFEST), "bundles")


def _read(batches):
    for batch in batches:
        for uri in batch.column("file").to_pylist():
            bundle = BundleReader(uri)
            for lo in range(0, len(bundle.index), 5000):
                rows = []
                for place in bundle.index[lo : lo + 5000]:
                    head, payload = bundle.record(place)
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    n_bytes = int(head["Payload-Length"])
                    if head["WARC-Type"] == "response" and (len(payload) != n_bytes or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"payload of {place[0]} in {uri} is damaged")
                    rows.append((page_of(place[0]), n_bytes, digest, head["WARC-Type"], page_of(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None))
                page, n, digest, kind, refers = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({"page_id": pa.array(page, pa.int64()), "payload_bytes": pa.array(n, pa.int64()), "payload_digest": pa.array(digest, pa.string()), "record_type": pa.array(kind, pa.string()), "refers_to": pa.array(refers, pa.int64())})


def read_bundles(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, read through the seek tables and checked."""
    files = manifest.count()
    return manifest.repartition(max(1, files)).select("file").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
