"""Operator 4: legacy ARC archives read by their version's header line and turned into WARC.

``arc_records`` reads ARC version 1 and 2 streams: the version block says which
fields a record's header line has; the last one is the declared length of what
follows. ``warc_record`` makes the equivalent WARC record: an identifier from page
and content, the 14-digit date as ISO 8601, the type, and SHA-1 digests of block and
payload. A payload that another record holds becomes a revisit record that refers to
it and keeps only the HTTP header, whose Content-Length still tells the payload's size.

Archives are gzip members, one a record, written below a shared folder by the tasks
themselves under names of their own; a manifest of the files of completed tasks says
which to read, so a repeated task leaves an unlisted file and nothing else.

Defined results: null payloads are empty; empty and short ones are always responses;
of equal payloads of at least ``least`` bytes the largest page_id is the response
(rows that repeat this id too), others revisit it, rows with a null page_id last;
a null url is written as ``unknown:``, white space in a url percent-encoded; an
empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read, ship

#: Field names of an ARC record's header line, by version (fixed by the ARC format).
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
LEAST_BYTES, ARCHIVE_BYTES, BUFFER = 1000, 64 << 20, 1 << 16
DATE = "20240101000000"


class ArcRecord(NamedTuple):
    version: int
    fields: dict[str, str]
    block: bytes


def arc_version_block(version: int, name: str, date: str = DATE) -> bytes:
    text = f"{version} 0 weftline\n{' '.join(ARC_FIELDS[version])}\n".encode()
    tail = "text/plain" if version == 1 else f"text/plain 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {date} {tail} {len(text)}\n".encode() + text + b"\n"


def arc_record(version: int, url: str, block: bytes, name: str, offset: int, date: str = DATE) -> bytes:
    middle = "" if version == 1 else f"200 - - {offset} {name} "
    return f"{url} 0.0.0.0 {date} text/html {middle}{len(block)}\n".encode() + block + b"\n"


@functools.cache
def _header(n: int) -> re.Pattern:
    """A header line of n fields. URL and content type may hold spaces: the address and the date between them, and the fields behind, tell them apart."""
    address = r"(\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f]*:[0-9A-Fa-f:.]*|-)"
    return re.compile(rf"(.+) {address} (\d{{8}}|\d{{12}}|\d{{14}}) (\S.*?)" + r" (\S+)" * (n - 4))


def header_values(line: str, n: int) -> list[str]:
    """The n fields of a record's header line; dates are filled up to 14 digits with zeros."""
    found = _header(n).fullmatch(line)
    if not found or not found[n].isdecimal():
        raise ValueError(f"bad ARC header line: {line[:200]!r}")
    values = list(found.groups())
    values[2] = values[2].ljust(14, "0")
    try:
        datetime.strptime(values[2], "%Y%m%d%H%M%S")
    except ValueError:
        raise ValueError(f"bad date in an ARC header line: {line[:200]!r}") from None
    return values


def arc_records(stream: BinaryIO) -> Iterator[ArcRecord]:
    """Records of an uncompressed ARC stream, one in memory at a time; the version block itself is not one."""
    head = stream.readline().decode("utf-8", "surrogateescape").rstrip("\r\n")
    if not head:
        return
    if not head.startswith("filedesc://"):
        raise ValueError(f"not an ARC version block: {head[:80]!r}")
    described = stream.read(int(head.rsplit(" ", 1)[1])).decode("utf-8", "replace").split("\n")
    version = int(described[0].split()[0])
    fields = tuple(described[1].split()) if len(described) > 1 and described[1].strip() else ARC_FIELDS.get(version, ("",))
    if version not in ARC_FIELDS or fields[:4] != ARC_FIELDS[version][:4] or fields[-1] != "Archive-length":
        raise ValueError(f"unknown ARC version block: {described[:2]}")
    while line := stream.readline():
        line = line.decode("utf-8", "surrogateescape").rstrip("\r\n")
        if not line:
            continue
        values = header_values(line, len(fields))
        length = int(values[-1])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"ARC record cut short: {len(block)} of {length} bytes")
        yield ArcRecord(version, dict(zip(fields, values, strict=True)), block)


LEGACY = "file string, record long, version int, url string, ip string, date string, content_type string, payload_bytes long, payload_digest string, warc binary"


def _converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, content) of whole ARC files, gzip members or plain, to a row for each record with its WARC twin."""
    names = [x.split()[0] for x in LEGACY.split(", ")]
    types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            raw = pa.BufferReader(content.as_buffer())
            packed = content.as_buffer().slice(0, 2).to_pybytes() == b"\x1f\x8b" if content.as_buffer().size > 1 else False
            rows, size = [], 0
            for n, record in enumerate(arc_records(io.BufferedReader(Inflated(raw) if packed else raw, BUFFER))):
                _, payload = split_http(record.block)
                f = record.fields
                # a record is known by its file and number
                own = int.from_bytes(hashlib.sha256(f"{path} {n}".encode()).digest()[:8], "big", signed=True)
                rows.append((path, n, record.version, f["URL"].encode("utf-8", "replace").decode(), f["IP-address"], f["Archive-date"], f["Content-type"], len(payload), hashlib.sha1(payload).hexdigest(), warc_record(record, own)))
                size += len(record.block)
                if size > ARCHIVE_BYTES // 8:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)


def arc_table(files: DataFrame) -> DataFrame:
    """Legacy files of many records as a table: one row a record, with the equivalent WARC record.

    files: path and content, as Spark's binaryFile source reads them through Hadoop's file
    systems. An empty file has no records; a file that is no ARC, or is cut short, is an error.
    """
    ship(files.sparkSession)
    return files.select("path", "content").mapInArrow(_converted, LEGACY)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header (with its empty line) and payload; without a header all is payload."""
    at = block.find(b"\r\n\r\n")
    return (block[: at + 4], block[at + 4 :]) if block.startswith(b"HTTP/") and at >= 0 else (b"", block)


def http_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?mi)^" + re.escape(name.encode()) + rb":[ \t]*(.*?)\r?$", head)
    return found[1].decode("latin-1") if found else None


def record_id(page_id: int | None, digest: bytes) -> str:
    """A custom (version 8) UUID of 64 bits of page id, a bit for null, and 57 bits of digest."""
    bits = ((0 if page_id is None else page_id) & (2**64 - 1)) << 58 | (page_id is None) << 57 | int.from_bytes(digest[:8], "big") >> 7
    return str(uuid.UUID(int=(bits >> 74) << 80 | 8 << 76 | (bits >> 62 & 0xFFF) << 64 | 2 << 62 | bits & (2**62 - 1)))


def page_of(record: str) -> int | None:
    n = uuid.UUID(record).int
    bits = (n >> 80) << 74 | (n >> 64 & 0xFFF) << 62 | n & (2**62 - 1)
    page = bits >> 58
    return None if bits >> 57 & 1 else page - 2**64 if page >> 63 else page


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(arc: ArcRecord, page_id: int | None, target: int | None = None, revisit: bool = False) -> bytes:
    """The WARC/1.1 record that is equivalent to an ARC record."""
    head, payload = split_http(arc.block)
    digest = hashlib.sha1(payload).digest()
    block = head if revisit else arc.block
    d = arc.fields["Archive-date"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{record_id(page_id, digest)}>",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        f"WARC-Target-URI: {arc.fields['URL']}",
        f"WARC-IP-Address: {arc.fields['IP-address']}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"WARC-Block-Digest: {_sha1(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{record_id(target, digest)}>"]
    lines += [f"Content-Type: {'application/http; msgtype=response' if head else arc.fields['Content-type']}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block + b"\r\n\r\n"


class Inflated(io.RawIOBase):
    """Reads a stream of gzip members as one stream."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.more, self.kept, self.member = raw, True, b"", zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        while True:
            if not self.kept and self.more:
                self.kept = self.raw.read(BUFFER)
                self.more = bool(self.kept)
            if not self.kept and not self.more:
                return 0
            out = self.member.decompress(self.kept, len(b))
            self.kept = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            if self.member.eof:
                self.member = zlib.decompressobj(31)
            if out:
                b[: len(out)] = out
                return len(out)


def warc_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of an uncompressed WARC stream, one record in memory at a time."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            fields[name] = value.strip()
        length = int(fields["Content-Length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("WARC record cut short")
        yield fields, block


def clean_url(url: str | None) -> str:
    return re.sub(r"[\s\x00-\x1f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else "unknown:"


def _write(folder: str) -> Callable:
    """Rows (page_id, url, payload, target, revisit) to WARC files; yields their paths and record counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        out, name, size, count, version = None, "", 0, 0, 1
        for batch in batches:
            for page_id, url, payload, target, revisit in zip(*(batch.column(i) for i in range(5)), strict=True):
                page_id, payload = page_id.as_py(), payload.as_buffer()
                if out is None:
                    name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, size, count, version = fs.open_output_stream(name), 0, 0, 1 + int(name[-10], 16) % 2
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n" + (f"X-Page-Id: {page_id}\r\n" if page_id is not None else "") + "\r\n"
                arc = arc_version_block(version, "pages.arc") + arc_record(version, clean_url(url.as_py()), head.encode() + payload, "pages.arc", size)
                for legacy in arc_records(io.BytesIO(arc)):
                    known = http_field(split_http(legacy.block)[0], "X-Page-Id")
                    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
                    data = pack.compress(warc_record(legacy, None if known is None else int(known), target.as_py(), revisit.as_py())) + pack.flush()
                    out.write(data)
                    size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], ["file", "records"])
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], ["file", "records"])

    return run


def _read(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, _ = FileSystem.from_uri(folder)
        for batch in batches:
            for file, records in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                rows, seen = [], 0
                with fs.open_input_stream(file) as raw:
                    for fields, block in warc_records(io.BufferedReader(Inflated(raw), BUFFER)):
                        seen += 1
                        rows.append(described(fields, block))
                        if len(rows) == 5000:
                            yield _rows(rows)
                            rows = []
                if seen != records:
                    raise ValueError(f"{file}: {seen} records of {records}")
                if rows:
                    yield _rows(rows)

    return run


def described(fields: dict[str, str], block: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a WARC record; digests are verified."""
    if _sha1(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest differs: {fields['WARC-Record-ID']}")
    head, payload = split_http(block)
    revisit = fields["WARC-Type"] == "revisit"
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    if not revisit and hashlib.sha1(payload).digest() != digest:
        raise ValueError(f"payload digest differs: {fields['WARC-Record-ID']}")
    size = int(http_field(head, "Content-Length")) if revisit else len(payload)
    inner = lambda name: page_of(fields[name].strip("<>").removeprefix("urn:uuid:"))
    return inner("WARC-Record-ID"), size, digest.hex(), fields["WARC-Type"], inner("WARC-Refers-To") if revisit else None


SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])


def write_archives(pages: DataFrame, scratch: Scratch, least: int = LEAST_BYTES) -> tuple[DataFrame, str]:
    """WARC files of (page_id, url, html); the manifest (file, records) and the folder."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    copies = keyed.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = scratch.write(copies, "copies")
    marked = keyed.join(copies, ["digest", "bytes"], "left")
    revisit = F.col("target").isNotNull() & F.coalesce(F.col("page_id") < F.col("target"), F.col("page_id").isNull())
    folder = scratch.path("archives")
    sc = scratch.spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).mkdirs(path)
    manifest = marked.select("page_id", "url", "payload", "target", revisit.alias("revisit")).mapInArrow(_write(folder), "file string, records long")
    return scratch.write(manifest, "manifest"), folder


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row for each record of the listed files."""
    files = max(1, manifest.count())
    return manifest.repartition(min(files, 100_000), "file").mapInArrow(_read(folder), SCHEMA)


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(*write_archives(read(spark, sf_dir, "pages"), Scratch(spark, "archive")))
