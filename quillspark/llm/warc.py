"""Legacy ARC archives converted to WARC/1.1.

An ARC archive begins with a version block, ``filedesc://<name> <ip> <date> text/plain <length>``
and a body whose first line is the version and whose second names the fields of the header lines:
version 1 has URL IP-address Archive-date Content-type Archive-length; version 2 has URL
IP-address Archive-date Content-type Result-code Checksum Location Offset Filename
Archive-length. The parser takes the field count from the version line and each record's end from
its declared length, never from its content.

A WARC record gets what ARC lacks: a record id (an RFC 9562 version 8 UUID that holds the row id),
an ISO timestamp, a type (response, or revisit for a payload that another record holds) and base32
SHA-1 digests of payload and block. A revisit keeps the HTTP header, not the payload.

Files are written by Spark's text writer with the record end as line separator, so they work on
any file system and are committed once; their number of records is bounded, and a reader parses
whole files by declared lengths.

Null payloads are empty; a null or odd URL is written percent-encoded or as ``-``. A page without
page_id is a response, and no revisit refers to it; equal rows with the largest page_id of their
payload are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import keep, scratch

#: Field names of ARC header lines by version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
RECORD_END = "\r\n\r\n"
#: Records of a WARC file, at most.
FILE_RECORDS = 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE48 = 0x5155494C4C00


def record_uuid(row_id: int | None) -> str:
    """The version 8 UUID that stands for a row; the nil UUID for a row without id."""
    if row_id is None:
        return str(uuid.UUID(int=0))
    n = row_id & (1 << 64) - 1
    return str(uuid.UUID(int=_SPACE48 << 80 | 8 << 76 | n >> 62 << 64 | 2 << 62 | n & (1 << 62) - 1))


def row_of(value: str) -> int | None:
    """The row that a record id stands for; the inverse of record_uuid()."""
    n = uuid.UUID(value).int
    if n == 0:
        return None
    x = (n >> 64 & 3) << 62 | n & (1 << 62) - 1
    return x - (1 << 64) if x >> 63 else x


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_url(url: str | None) -> str:
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]") or "-" if url else "-"


def arc_archive(records: list[tuple[str, str, str, str, bytes]], version: int, name: str = "legacy.arc") -> bytes:
    """An ARC archive of (url, ip, 14-digit date, content type, content)."""
    body = f"{version} 0 quillspark\n{' '.join(ARC_FIELDS[version])}\n".encode()
    base = f"filedesc://{name} 0.0.0.0 19960923142103 text/plain"
    out = [f"{base} {'' if version == 1 else f'200 - - 0 {name} '}{len(body)}\n".encode(), body, b"\n"]
    at = sum(map(len, out))
    for url, ip, date, kind, content in records:
        more = "" if version == 1 else f"200 {hashlib.md5(content).hexdigest()} - {at} {name} "
        head = f"{url} {ip} {date} {kind} {more}{len(content)}\n".encode()
        out += [head, content, b"\n"]
        at += len(head) + len(content) + 1
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an archive as dicts of its header fields and ``content``; ValueError if it is broken."""
    end = data.find(b"\n")
    first = data[:end].decode("utf-8", "replace").split(" ")
    if end < 0 or not first[0].startswith("filedesc://"):
        raise ValueError("no version block")
    size = int(first[-1])
    block = data[end + 1 : end + 1 + size]
    version = int(block.split(b" ", 1)[0])
    fields = ARC_FIELDS.get(version)
    if fields is None:
        raise ValueError(f"unknown ARC version {version}")
    at = end + 1 + size
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        parts = data[at:end].decode("utf-8", "replace").split(" ")
        if end < 0 or len(parts) != len(fields):
            raise ValueError(f"header line at byte {at} has {len(parts)} fields, not {len(fields)}")
        size = int(parts[-1])
        if end + 1 + size > len(data):
            raise ValueError(f"record at byte {at} is cut short")
        yield dict(zip(fields, parts)) | {"content": data[end + 1 : end + 1 + size], "version": version}
        at = end + 1 + size


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """The HTTP header with its empty line, and the payload."""
    cut = content.find(b"\r\n\r\n")
    return (content[: cut + 4], content[cut + 4 :]) if content.startswith(b"HTTP/") and cut >= 0 else (b"", content)


def iso_date(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z" if re.fullmatch(r"\d{14}", date) else "1970-01-01T00:00:00Z"


def to_warc(record: dict, row_id: int | None, refers_to: int | None = None) -> bytes:
    """The WARC record of a parsed ARC record, without the two line ends after its block."""
    head, payload = split_http(record["content"])
    block = record["content"] if refers_to is None else head
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{record_uuid(row_id)}>",
        f"WARC-Target-URI: {record['URL']}",
        f"WARC-IP-Address: {record['IP-address']}",
        f"WARC-Date: {iso_date(record['Archive-date'])}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response" if head else f"Content-Type: {record['Content-type']}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:uuid:{record_uuid(refers_to)}>"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record; digests are verified."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at byte {at}")
        lines = data[at:end].decode("utf-8").split("\r\n")[1:]
        fields = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        if fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
            raise ValueError(f"record at byte {at} has another block digest")
        yield fields, block
        at = end + 8 + size


def legacy_records(pages: DataFrame) -> DataFrame:
    """(page_id, digest, arc): each page as a deflated ARC archive of one record, in both versions."""

    def run(batches):
        for batch in batches:
            arcs = []
            for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                payload = (html or "").encode("utf-8", "surrogatepass")
                content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                arcs.append(zlib.compress(arc_archive([(arc_url(url), "0.0.0.0", "20050101000000", "text/html", content)], 1 + (page or 0) % 2), 1))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("digest"), pa.array(arcs, pa.binary())], names=["page_id", "digest", "arc"])

    return with_digest(pages).mapInArrow(run, "page_id long, digest binary, arc binary")


def with_digest(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long"), "url", "html", F.unhex(F.sha1(F.coalesce("html", F.lit("")))).alias("digest"))


def with_originals(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds refers_to: the largest page_id of the same digest, or null for that one and for single payloads.

    ids has the (page_id, digest) of all records. Its groups are aggregated first and only those of
    two or more are written and joined; as both sides of the join are then plain scans, Spark
    splits a partition that a hot digest fills.
    """
    groups = ids.groupBy("digest").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1")
    groups = keep(groups.select(F.col("digest").alias("_digest"), "_last"), "warc-groups")
    joined = records.join(groups, F.col("digest") == F.col("_digest"), "left")
    return joined.select("page_id", "arc", F.when(F.col("_last") != F.col("page_id"), F.col("_last")).alias("refers_to"))


def write_warc(records: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Converts (page_id, arc, refers_to) and writes WARC files under ``path``."""

    def run(batches):
        for batch in batches:
            out = []
            for page, arc, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "arc", "refers_to"))):
                out += [to_warc(r, page, refers) for r in parse_arc(zlib.decompress(arc))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    lines = records.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def read_warc(spark, path: str) -> DataFrame:
    """One row per record under ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for fields, block in parse_warc(zlib.decompress(data.as_py(), 31)):
                    head, payload = split_http(block)
                    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)[1]) if head else len(payload)
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (size != len(payload) or digest != base32_sha1(payload)):
                        raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
                    refers = fields.get("warc-refers-to")
                    rows.append((row_of(fields["warc-record-id"][10:-1]), size, digest, kind, row_of(refers[10:-1]) if refers else None))
                cols = list(zip(*rows)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return files.mapInArrow(run, schema)


def dangling_revisits(records: DataFrame) -> DataFrame:
    """The revisits of read_warc() without a response record of the id that they refer to and of equal payload."""
    origin = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    return records.where("record_type = 'revisit'").join(origin, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages to ARC, ARC to WARC files, and the files read back."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_warc(with_originals(legacy_records(pages), with_digest(pages).select("page_id", "digest")), path)
    return read_warc(spark, path)
