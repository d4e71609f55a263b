"""Operator 1, WARC: a writer and a sequential reader of compressed archives, one gzip member per record.

Writer: every row becomes one ``response`` record, or a ``revisit`` when a row with an equal payload of at least
``min_revisit_bytes`` and a smaller id exists. Archives are files ``*.warc.gz`` in the shared folder; a task names its
files after itself and reports them, so files of a task that was lost or repeated are never read.
Reader: bytes are inflated member by member, each record is framed by its Content-Length, and block and
payload digests are verified.

Defined results: null payload: empty; null or empty url: ``urn:row:<id>``; control characters and blanks in a url are
percent-encoded; rows that share the smallest id of equal payloads are all responses; a row with null id is a response
that nobody refers to; an empty table gives no archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, block_ok boolean, payload_ok boolean"
_READ = 1 << 18


class WarcError(ValueError):
    """The archive is not a sequence of well-formed records."""


def _filesystem(path: str):
    from pyarrow import fs

    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def record_id(page_id: int | None) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'row:{page_id}')}"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int = 6) -> bytes:
    """One record as a gzip member."""
    revisit = refers_to is not None
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:row:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{record_id(page_id)}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Row-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(refers_to)}>"), ("X-Refers-To-Row-ID", str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    raw = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class _Members:
    """Bytes of a stream of gzip members, inflated in pieces of bounded size; ``ended`` is set at the end of a member."""

    def __init__(self, stream):
        self.stream, self.raw, self.buffer = stream, b"", bytearray()
        self.unpacker, self.ended = None, False

    def _more(self) -> bool:
        """Inflate one piece of the present member; False when the member is over."""
        if self.ended:
            return False
        if not self.raw:
            self.raw = self.stream.read(_READ)
            if not self.raw:
                raise WarcError("the archive ends inside a record")
        self.buffer += self.unpacker.decompress(self.raw, _READ)
        self.raw = self.unpacker.unconsumed_tail
        if self.unpacker.eof:
            self.raw, self.ended = self.unpacker.unused_data, True
        return True

    def next_member(self) -> bool:
        if self.buffer:
            raise WarcError("bytes behind a record")
        if not self.raw:
            self.raw = self.stream.read(_READ)
        if not self.raw:
            return False
        self.unpacker, self.ended = zlib.decompressobj(31), False
        return True

    def until(self, mark: bytes) -> bytes:
        at, seen = self.buffer.find(mark), 0
        while at < 0:
            seen = max(0, len(self.buffer) - len(mark))
            if not self._more():
                raise WarcError("a record without end of header")
            at = self.buffer.find(mark, seen)
        out = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise WarcError("a record shorter than its Content-Length")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def rest(self) -> bytes:
        while self._more():
            if len(self.buffer) > 2 * _READ:
                raise WarcError("bytes behind a record")
        out = bytes(self.buffer)
        self.buffer.clear()
        return out


def read_records(stream) -> Iterator[dict]:
    """Records of one archive in order. Raises WarcError on broken framing; digests are reported as booleans."""
    members = _Members(stream)
    while members.next_member():
        lines = members.until(b"\r\n\r\n").split(b"\r\n")
        if not lines[0].startswith(b"WARC/1."):
            raise WarcError("not a WARC record")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
        if not head.get("content-length", "").isdigit():
            raise WarcError("no Content-Length")
        block = members.exactly(int(head["content-length"]))
        if members.rest() != b"\r\n\r\n":
            raise WarcError("a record does not end with two line ends")
        payload = block.partition(b"\r\n\r\n")[2]
        revisit = head.get("warc-type") == "revisit"
        number = lambda k: int(head[k]) if head.get(k) else None
        digest = head.get("warc-payload-digest", "").removeprefix("sha256:")
        yield {
            "page_id": number("x-row-id"),
            "url": head.get("warc-target-uri"),
            "record_type": head.get("warc-type"),
            "refers_to": number("x-refers-to-row-id"),
            "payload": None if revisit else payload,
            "payload_bytes": number("x-payload-length") if revisit else len(payload),
            "payload_digest": digest,
            "block_ok": head.get("warc-block-digest") == f"sha256:{hashlib.sha256(block).hexdigest()}",
            "payload_ok": None if revisit else hashlib.sha256(payload).hexdigest() == digest,
        }


def assign(pages: DataFrame, min_revisit_bytes: int = 100) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: equal payloads refer to the smallest id that has them."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= min_revisit_bytes).select("page_id", "digest")
    # counts are summed before the shuffle, so the digest of a third of all rows is one row per task
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # only ids pass the skewed join; payloads are shuffled once, by id
    refers = large.join(first, "digest").where("page_id > first").select(F.col("page_id"), F.col("first").alias("refers_to"), "digest").distinct()
    return rows.join(refers, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


def write_archives(assigned: DataFrame, folder: str, max_bytes: int = 1 << 30, level: int = 6) -> DataFrame:
    """Write the rows of :func:`assign`; one row ``(path, records, bytes)`` for each finished archive."""

    def write(batches):
        from pyspark import TaskContext

        system, root = _filesystem(folder)
        system.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"{task.partitionId() if task else 0:06d}-{task.taskAttemptId() if task else os.getpid()}-{uuid.uuid4().hex[:8]}"
        part, out, size, count = 0, None, 0, 0

        def finished():
            out.close()
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}-{part:04d}.warc.gz", "records": count, "bytes": size}], schema=schema)

        schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for i in range(batch.num_rows):
                page_id, url, payload, digest, refers = (c[i].as_py() for c in columns)
                if out is None:
                    out, size, count = system.open_output_stream(f"{root}/{name}-{part:04d}.warc.gz", compression=None), 0, 0
                data = build_record(page_id, url, payload, digest, refers, level)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= max_bytes:
                    yield finished()
                    out, part = None, part + 1
        if out is not None:
            yield finished()

    return assigned.mapInArrow(write, "path string, records long, bytes long")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the archives named in column ``path``, read sequentially, one file after the other within a task."""

    def read(batches):
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block_ok", pa.bool_()), ("payload_ok", pa.bool_())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = _filesystem(path)
                with system.open_input_stream(name, compression=None) as stream:
                    rows, size = [], 0
                    for record in read_records(stream):
                        size += len(record["payload"] or b"")
                        if not payloads:
                            record["payload"] = None
                        rows.append(record)
                        if len(rows) >= 2000 or size >= 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return archives.select("path").mapInArrow(read, RECORD_SCHEMA)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back. A digest that fails verification ends the query."""
    pages = common.table(spark, sf_dir, "pages")
    folder = common.shared_path(spark, "warc")
    manifest, _ = common.materialize(spark, write_archives(assign(pages), folder), "warc-manifest")
    paths = manifest.repartition(max(spark.sparkContext.defaultParallelism, manifest.count()), "path")
    records = read_archives(paths, payloads=False)
    checked = F.when(F.col("block_ok") & F.coalesce("payload_ok", F.lit(True)), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a digest does not match")))
    return records.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, CAST(d.payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
  CASE WHEN f.first_id < d.page_id AND d.payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_id < d.page_id AND d.payload_bytes >= 100 THEN f.first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
