"""WARC archives: writing them, and reading them record by record.

Archives hold one gzip member for each record. The reader is sequential: it feeds zlib in small pieces, takes each
record's block by its Content-Length, and checks block and payload digests while the bytes pass by.

Spark's text writer stores the archives, so any file system that Spark can reach will do and a task that is run again
commits once. That writer ends every row with a separator; here it is one NUL byte, the last byte of each member: the
high byte of the size field, which is zero for records under 16 MiB. A larger record is stored whole and the NUL
after it is padding, which gzip readers skip, and this one too.

Defined results: a null payload is an empty one; a null url is written as an empty target; a null id sorts after all
ids; equal payloads with equal ids count as the same capture, so none of these refers to another; an empty table
gives no archives and no rows; other columns are left alone. A damaged archive raises DamagedArchive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, written

PIECE = 64 * 1024
STREAMED = ("file", "s3", "gs")  # stores that pyarrow opens without further set-up
EPOCH = "1970-01-01T00:00:00Z"
HEX_TO_B32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
ROWS_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


class DamagedArchive(ValueError):
    """An archive breaks the format or a digest does not fit."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def base32_sha1_column(payload: Column) -> Column:
    """Upper-case base32 SHA-1: five hex digits are twenty bits are four base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), *HEX_TO_B32)


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    version: str = "WARC/1.1"
    http_headers: dict[str, str] = field(default_factory=dict)

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2] if self.http_headers else self.block


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise DamagedArchive(f"header line without a colon: {line[:80]!r}")
        out[name.decode().strip().lower()] = value.decode().strip()
    return out


def write_member(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


class _Inflater:
    """The bytes of one gzip member, decompressed as they are asked for."""

    def __init__(self, pieces: Iterator[bytes], rest: bytes):
        self.pieces, self.raw, self.zip, self.ready = pieces, rest, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        if self.zip.eof:
            return False
        if not self.raw:
            self.raw = next(self.pieces, b"")
            if not self.raw:
                raise DamagedArchive("archive ends inside a record")
        try:
            self.ready += self.zip.decompress(self.raw, PIECE)
        except zlib.error as e:
            raise DamagedArchive(str(e)) from e
        self.raw = self.zip.unused_data if self.zip.eof else self.zip.unconsumed_tail
        return True

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        while (at := self.ready.find(mark)) < 0:
            if len(self.ready) > most or not self._more():
                raise DamagedArchive("record header is not closed")
        out = bytes(self.ready[:at])
        del self.ready[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.ready and not self._more():
                raise DamagedArchive("record is shorter than its Content-Length")
            part = bytes(self.ready[:n])
            del self.ready[: len(part)]
            n -= len(part)
            yield part

    def finish(self) -> bytes:
        while self._more():
            pass
        if bytes(self.ready) != b"\r\n\r\n":
            raise DamagedArchive("record is longer than its Content-Length")
        return self.raw


def read_records(pieces: Iterator[bytes], verify: bool = True) -> Iterator[Record]:
    """The records of an archive that comes in pieces of any size."""
    rest = b""
    while True:
        rest = rest.lstrip(b"\0")
        while not rest:
            rest = next(pieces, None)
            if rest is None:
                return
            rest = rest.lstrip(b"\0")
        member = _Inflater(pieces, rest)
        version, *lines = member.until(b"\r\n\r\n").split(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise DamagedArchive(f"not a record: {version[:40]!r}")
        headers = _fields(lines)
        if not headers.get("content-length", "").isdigit():
            raise DamagedArchive("record without Content-Length")
        digest, parts = hashlib.sha1(), []
        for part in member.take(int(headers["content-length"])):
            digest.update(part)
            parts.append(part)
        rest = member.finish()
        record = Record(headers, b"".join(parts), version.decode())
        if headers.get("content-type", "").startswith("application/http"):
            record.http_headers = _fields(record.block.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:])
        if verify:
            said = headers.get("warc-block-digest", "").removeprefix("sha1:")
            if said and said != base64.b32encode(digest.digest()).decode():
                raise DamagedArchive("block digest does not fit")
            said = headers.get("warc-payload-digest", "").removeprefix("sha1:")
            if said and headers.get("warc-type") == "response" and said != base32_sha1(record.payload):
                raise DamagedArchive("payload digest does not fit")
        yield record


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes and refers_to; only digests are grouped, a payload moves once.

    Groups of one need no entry, so the joined side holds repeated payloads only; Spark broadcasts it where it is
    small and otherwise splits a hot digest's rows (adaptive skew join), as the joined side has one row a digest.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), base32_sha1_column(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes")
    )
    repeated = rows.filter(F.col("payload_bytes") >= least_revisit_bytes).groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    repeated = written(repeated, "repeated-payloads")
    return rows.join(repeated, ["payload_digest", "payload_bytes"], "left").select(
        "page_id", "url", "payload", "payload_digest", "payload_bytes", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to")
    )


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    value = (urn or "").rstrip(">").rpartition(":")[2]
    return int(value) if value.lstrip("-").isdigit() else None


def page_member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit that keeps the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = " ".join((url or "").split())
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", EPOCH), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to))]
    return write_member(headers, block)


def write_archives(records: DataFrame, path: str, chunk_bytes: int = 4 << 20, chunks_per_file: int = 8) -> None:
    """Writes plan_records() rows as archives of about chunk_bytes * chunks_per_file."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (batch.column(c)[i].as_py() for c in range(5))
                member = page_member(page_id, url, payload, digest, refers_to)
                parts.append(member)
                size += len(member)
                if size >= chunk_bytes or member[-1]:
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array([_open_ended(parts)], pa.binary())})
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([_open_ended(parts)], pa.binary())})

    chunks = records.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(pack, "chunk binary")
    chunks.select(F.col("chunk").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", chunks_per_file).text(path)


def _open_ended(parts: list[bytes]) -> bytes:
    """The members without the last NUL, which the text writer's separator gives back."""
    data = b"".join(parts)
    return data if data[-1] else data[:-1]


def streamed(path: str) -> Iterator[bytes]:
    """A file's bytes in pieces, none of which is kept."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    with store.open_input_stream(at) as file:
        while piece := file.read(PIECE):
            yield piece


def read_archives(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """One row for each response or revisit record of the archives in a folder. An archive is one task's work, and its
    records are decompressed one at a time. Where workers can open the store themselves (STREAMED), archives of any size
    are read in pieces; elsewhere Spark hands over archives of up to 2 GB whole."""
    files = spark.read.format("binaryFile").load(path)
    store = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    by_name = store.getScheme() in STREAMED

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                if by_name:
                    pieces = streamed(archive.as_py())
                else:
                    view = memoryview(archive.as_buffer())
                    pieces = (bytes(view[i : i + PIECE]) for i in range(0, len(view), PIECE))
                rows = []
                for record in read_records(pieces, verify):
                    h = record.headers
                    if h.get("warc-type") in ("response", "revisit"):
                        rows.append({"page_id": _page_of(h.get("warc-record-id")), "url": h.get("warc-target-uri"), "payload_bytes": int(record.http_headers.get("content-length", len(record.payload))), "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:"), "record_type": h["warc-type"], "refers_to": _page_of(h.get("warc-refers-to"))})
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    return files.select("path" if by_name else "content").mapInArrow(unpack, ROWS_SCHEMA)


def round_trip(pages: DataFrame, path: str | None = None, **columns: str) -> DataFrame:
    """Writes the pages as archives and reads these back."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_archives(plan_records(pages, **columns), path)
    return read_archives(spark, path)
