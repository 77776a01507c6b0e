"""WARC records in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle ends with
a seek table in a skippable frame (the public seekable format), and an index maps
each record's identifier to its frame and the offset inside it. Bundles are rows
of a Parquet table in shared storage, or files where ``export_bundles`` is used.

Of records with equal payloads of at least ``least`` bytes the one with the
smallest identifier is a response, the others are revisits that name it.

Defined results: a null payload is empty; a null identifier is kept, sorts after
all others and never becomes a response that others name unless all are null;
rows that share the smallest identifier are all responses; null urls have no
target line; control characters of a url are escaped in its target line, and a
line of our own keeps such a url as it was; the date of all records is the one
given; empty tables give no bundles; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

#: A frame closes at so many records or bytes, a bundle at so many bytes of frames.
FRAME_RECORDS, FRAME_BYTES, BUNDLE_BYTES = 64, 1 << 18, 1 << 22


def revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload (binary) -> the same with digest, payload_bytes and refers_to (null: a response).

    Payloads that at least a thousandth of all rows share are at most a thousand and are broadcast;
    any other is joined by digest, so that no task gets more than a thousandth of the rows for one key.
    Payloads under ``least`` bytes, and those that are broadcast, take no part in that join: their keys
    are hashes of row and input partition, so that equal rows of different partitions don't meet either.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("payload").cast("binary"), F.lit("").cast("binary")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    groups = rows.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    many = F.lit(max(2, pages.count() // 1000))
    hot = groups.where(F.col("n") >= many).select("digest", F.col("first").alias("hot"))
    rest = groups.where(F.col("n") < many).select("digest", F.col("first").alias("cold"))
    apart = F.concat(F.lit("#"), F.xxhash64("page_id", "url", "digest").cast("string"), F.lit("/"), F.spark_partition_id().cast("string"))
    found = rows.join(F.broadcast(hot), "digest", "left").withColumn("key", F.when(F.col("hot").isNull() & (F.col("payload_bytes") >= least), F.col("digest")).otherwise(apart))
    found = found.join(rest.withColumnRenamed("digest", "key"), "key", "left")
    first = F.coalesce("hot", "cold")
    return found.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(first), first)).select("page_id", "url", "payload", "digest", "payload_bytes", "refers_to")


#: The date of records where none is given: tables of pages have none.
DATE = "1970-01-01T00:00:00Z"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record; a response holds an HTTP answer with the payload, a revisit nothing."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        plain = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)
        head.append("WARC-Target-URI: " + plain)
        if plain != url:
            head.append("Page-Target-JSON: " + json.dumps(url))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"Page-Payload-Length: {size}", "Content-Type: application/http;msgtype=response"]
    block = b""
    if refers_to is None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundle:
    """Gathers records into frames."""

    def __init__(self, level: int = 3):
        self.zip = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[bytes, int]] = []
        self.open: list[bytes] = []
        self.open_bytes = self.size = 0
        self.index: list[dict] = []

    def add(self, page_id: int | None, data: bytes) -> None:
        self.index.append({"page_id": page_id, "frame": len(self.frames), "offset": self.open_bytes, "length": len(data)})
        self.open.append(data)
        self.open_bytes += len(data)
        if len(self.open) >= FRAME_RECORDS or self.open_bytes >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            packed = self.zip.compress(b"".join(self.open))
            self.frames.append((packed, self.open_bytes))
            self.size += len(packed)
            self.open, self.open_bytes = [], 0

    def close(self) -> tuple[bytes, list[dict]]:
        self.close_frame()
        table = b"".join(struct.pack("<II", len(f), n) for f, n in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        return b"".join(f for f, _ in self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table, self.index


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """Of each frame: its place, its size and the size of what it holds; read from the bundle's end."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    at, out = 0, []
    begin = len(data) - 9 - 8 * n
    for k in range(n):
        packed, held = struct.unpack_from("<II", data, begin + 8 * k)
        out.append((at, packed, held))
        at += packed
    if at + 8 != begin:
        raise ValueError("the seek table doesn't fit the frames")
    return out


def read_frame(data: bytes, entry: tuple[int, int, int]) -> bytes:
    at, packed, held = entry
    return zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=held)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header lines and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where its length says")
    return fields, rest[:n].partition(b"\r\n\r\n")[2]


BUNDLES = "bundle string, n_records long, data binary, index array<struct<page_id:long,frame:int,offset:long,length:long>>"
_INDEX = pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))


def write_bundles(records: DataFrame, level: int = 3, date: str = DATE) -> DataFrame:
    """Rows of ``revisits`` -> a row for each bundle: its bytes and its index. ``date``: of all records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, b = TaskContext.get().partitionId(), 0, Bundle(level)

        def done() -> pa.RecordBatch:
            data, index = b.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{k:06d}"]), pa.array([len(index)]), pa.array([data], pa.binary()), pa.array([index], _INDEX)], names=["bundle", "n_records", "data", "index"])

        for batch in batches:
            for page_id, url, payload, digest, size, refers in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "payload_bytes", "refers_to")), strict=True):
                i = page_id.as_py()
                b.add(i, record(i, url.as_py(), payload.as_py(), digest.as_py(), size.as_py(), refers.as_py(), date))
                if b.size >= BUNDLE_BYTES:
                    yield done()
                    k, b = k + 1, Bundle(level)
        if b.index:
            yield done()

    return records.mapInArrow(run, BUNDLES)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def read_bundles(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the bundles, found through index and seek table; a response's digest is checked."""
    import hashlib

    def number(urn: str) -> int | None:
        return int(urn[len("<urn:page:") : -1]) if len(urn) > len("<urn:page:>") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, index in zip(batch.column("data"), batch.column("index"), strict=True):
                data = data.as_py()
                frames, held, at, out = seek_table(data), b"", -1, []
                for e in sorted(index.as_py(), key=lambda e: (e["frame"], e["offset"])):
                    if e["frame"] != at:
                        at = e["frame"]
                        held = read_frame(data, frames[at])
                    fields, content = parse(held[e["offset"] : e["offset"] + e["length"]])
                    page_id, digest = number(fields["WARC-Record-ID"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if page_id != e["page_id"]:
                        raise ValueError("the index names another record")
                    response = fields["WARC-Type"] == "response"
                    if response and hashlib.sha256(content).hexdigest() != digest:
                        raise ValueError(f"record {page_id}: digest and payload differ")
                    refers = None if response else number(fields["WARC-Refers-To"])
                    url = json.loads(fields["Page-Target-JSON"]) if "Page-Target-JSON" in fields else fields.get("WARC-Target-URI")
                    out.append((page_id, int(fields["Page-Payload-Length"]), digest, fields["WARC-Type"], refers, url, content if payloads else None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True)],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"],
                )

    return bundles.mapInArrow(run, READ)


def export_bundles(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each bundle to ``folder``, one that all executors mount, as <bundle>.warc.zst; returns name and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes = [], []
            for name, data in zip(batch.column("bundle").to_pylist(), batch.column("data"), strict=True):
                path, raw = os.path.join(folder, f"{name}.warc.zst"), data.as_py()
                with open(f"{path}.{TaskContext.get().taskAttemptId()}", "wb") as f:
                    f.write(raw)
                os.replace(f.name, path)  # whole or not at all, also when a task runs twice
                names.append(path)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return bundles.mapInArrow(run, "path string, bytes long")
