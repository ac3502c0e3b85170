"""WARC archives of individually compressed records under an embedded Zstandard dictionary.

A file is a skippable frame with the dictionary, then one Zstandard frame for each record. The
dictionary is trained on records of the file itself. Pages with equal payloads are archived
once; the others are revisit records. Files have names that follow from the partition and the
attempt; the manifest names those of the attempts that counted, so a task that runs again, or
twice at once, neither overwrites a file nor leaves one that is read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_dir, small_batches, table

#: Skippable frame that holds the dictionary, by the public WARC-Zstandard proposal.
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
#: Bytes of evenly spaced records that a dictionary is trained on, the most of one of them (what
#: follows is archived like all else, but not trained on), and bytes of records in a file.
TRAINING_BYTES, TRAINING_RECORD, FILE_BYTES = 2 << 20, 128 << 10, 32 << 20
#: Payloads that repeat, 28 bytes each, which are sent to all tasks at most.
SENT = 1 << 20
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
URN = "urn:x-page:"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None) -> str:
    """Control characters, spaces and brackets would end a header; they are escaped."""
    return re.sub(r"[\x00-\x20<>\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "urn:x-unknown"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{URN}{refers_to}>"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info() -> bytes:
    body = b"software: kvlog\r\nformat: WARC File Format 1.1\r\n"
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-info:0>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """None where there is too little to learn from; such a file has no dictionary frame."""
    total, step = sum(map(len, records)), 1
    step = max(1, -(-total // TRAINING_BYTES))
    sample = [r[:TRAINING_RECORD] for r in records[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=512, d=8, level=LEVEL)
    except zstandard.ZstdError:
        return None


def archive(records: list[bytes]) -> bytes:
    learned, out = train(records), io.BytesIO()
    if learned:
        data = learned.as_bytes()
        out.write(struct.pack("<II", DICTIONARY_FRAME, len(data)) + data)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=learned, write_checksum=True)
    if learned:
        learned.precompute_compress(level=LEVEL)
    for r in [_info(), *records]:
        out.write(compressor.compress(r))
    return out.getvalue()


def read_archive(stream):
    """(headers, block) of each record of a binary stream, warcinfo included."""
    start, learned = stream.read(8), None
    if len(start) == 8 and struct.unpack("<I", start[:4])[0] == DICTIONARY_FRAME:
        learned = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", start[4:])[0]))
        start = b""
    rest = io.BufferedReader(_Joined(start, stream))
    plain = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=learned).stream_reader(rest, read_across_frames=True), 1 << 20)
    while plain.readline():
        headers = {}
        while line := plain.readline().rstrip(b"\r\n"):
            name, _, value = line.decode("utf-8", "surrogatepass").partition(": ")
            headers[name] = value
        block = plain.read(int(headers["Content-Length"]))
        plain.read(4)
        yield headers, block


class _Joined(io.RawIOBase):
    def __init__(self, start: bytes, stream):
        self.start, self.stream = start, stream

    def readable(self):
        return True

    def readinto(self, buffer):
        got = self.start[: len(buffer)] or self.stream.read(len(buffer))
        self.start = self.start[len(buffer) :]
        buffer[: len(got)] = got
        return len(got)


def decided(pages: DataFrame, sent: int = SENT) -> DataFrame:
    """(page_id, url, html, refers_to): the page whose record holds the payload, null for that page
    itself. A digest's largest page_id is a partial aggregate of narrow rows. Up to `sent`
    payloads that repeat are looked up where the pages are; more are joined by digest, in a join
    that Spark may split, so a payload that most pages share is never one task's work."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    shared = cut(rows.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).filter("n > 1 and kept is not null").select("digest", "kept"))
    shared = F.broadcast(shared) if shared.count() <= sent else shared
    return rows.join(shared, "digest", "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes `pages` (page_id, url, html) to WARC files under `folder`, an address that
    pyarrow's file systems open, and returns their manifest (path, records, bytes).

    A null html is an empty payload. Of rows with equal payloads those of the largest page_id
    are responses, the others revisits; rows without a page_id are revisits if any has one,
    else responses. Repeated rows are records of their own; no rows give no files.
    """
    small_batches(pages.sparkSession)

    def write(batches):
        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, held, size, files = TaskContext.get().partitionId(), [], 0, 0

        def flush():
            path = f"{root}/part-{part:06d}-{TaskContext.get().taskAttemptId()}-{files:04d}.warc.zst"
            data = archive(held)
            with fs.open_output_stream(path, compression=None) as f:
                f.write(data)
            return pa.RecordBatch.from_pydict({"path": [path], "records": [len(held)], "bytes": [len(data)]})

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, refers_to is not None))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield flush()
                    held, size, files = [], 0, files + 1
        if held:
            yield flush()

    return cut(decided(pages).mapInArrow(write, "path string, records long, bytes long"))


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record; that of a
    response is checked against its payload."""

    def read(batches):
        fs, _ = pa.fs.FileSystem.from_uri(folder)
        number = lambda urn: int(urn[len(URN) + 1 : -1]) if urn and len(urn) > len(URN) + 2 else None
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(path, compression=None) as f:
                    for h, block in read_archive(f):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), h["WARC-Payload-Digest"][5:]
                        if h["WARC-Type"] == "response" and (len(payload) != size or sha1_base32(payload) != digest):
                            raise ValueError(f"{path}: {h['WARC-Record-ID']} is damaged")
                        rows.append((number(h["WARC-Record-ID"]), size, digest, h["WARC-Type"], number(h.get("WARC-Refers-To"))))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return manifest.select("path").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "warc")
    return read_archives(write_archives(table(spark, sf_dir, "pages"), folder), folder)


OP8_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS kept,
    list_transform(range(8), lambda i: CAST('0x' || substr(hex, CAST(i * 5 + 1 AS INTEGER), 5) AS BIGINT)) AS groups
  FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(groups, lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((g >> s) & 31) + 1 AS INTEGER), 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = kept OR kept IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = kept THEN NULL ELSE kept END AS refers_to
FROM d
"""
