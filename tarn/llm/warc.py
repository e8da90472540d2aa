"""Web archives: legacy ARC files, and their conversion to WARC.

ARC records have one header line, whose fields the version block at the start of the file declares:

    version 1   URL IP-address Archive-date Content-type Archive-length
    version 2   URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length

followed by as many bytes as declared, and a line break. The converter parses them by their file's own version
and their declared lengths alone, and makes up what WARC has and ARC has not: record identifiers (name-based
UUIDs of URL, date and digest, so a conversion repeated gives the same), W3C timestamps, record types, and
digests of block and payload. Of records with equal payloads one is a response, the others revisit it.

The archive's address becomes WARC-IP-Address; where a record has no HTTP head, its content type stays its own. A
checksum of version 2 that is a SHA-1 in base32 is held against the body.

Files are compressed with gzip, written by Spark's text writer, whose line separator is the format's own record
end, and read by its binary reader, so they can be in any store that Spark reaches. A file is closed at FILE_BYTES, or
after one record larger than that. Conversion reads them twice: first for digests, which decide on record types, then to
write.

Defined cases: null HTML counts as empty; a null URL is written as -; bytes that a header line can't hold are
percent-encoded; a record without X-Page-Id has no page id; a null page id is the smallest of its group; of rows that repeat a page id and payload one
is the response; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import new_dir, saved, table

#: The header fields of either version, in order.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
ARC_TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the RFC 4122 name space of URLs
END = "\r\n\r\n"
#: A file is closed once it has so many bytes, uncompressed.
FILE_BYTES = 8_000_000


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 tarn\n{ARC_TITLES[version]}\n".encode()
    rest = ["-", "-", "-", "0", name] if version == 2 else []
    return " ".join([f"filedesc://{name}", "0.0.0.0", date, "text/plain", *rest, str(len(body))]).encode() + b"\n" + body


def arc_record(version: int, url: str, ip: str, date: str, body: bytes, kind: str = "text/html", status: int = 200, name: str = "-") -> bytes:
    rest = [str(status), base32_sha1(body), "-", "0", name] if version == 2 else []
    return " ".join([quote(url or "-", safe=":/?#[]@!$&'()*+,;=%~"), ip, date, kind, *rest, str(len(body))]).encode() + b"\n" + body


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields and body of each record but the version block."""
    fields, at = None, 0
    while at < len(data):
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if not line:  # breaks between records
            at = end + 1
            continue
        parts = line.split(" ")
        if fields is None:
            if not line.startswith("filedesc://"):
                raise ValueError("an ARC file starts with its version block")
            body = data[end + 1 : end + 1 + int(parts[-1])]
            version = int(body.split(None, 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            fields = ARC_FIELDS[version]
            if len(parts) != len(fields):
                raise ValueError("the version block has another version's header line")
        elif len(parts) != len(fields):
            raise ValueError(f"a record has {len(parts)} header fields in place of {len(fields)}")
        header = dict(zip(fields, parts, strict=True))
        size = int(header["length"])
        body = data[end + 1 : end + 1 + size]
        if len(body) < size:
            raise ValueError("a record is shorter than it says")
        if re.fullmatch("[A-Z2-7]{32}", header.get("checksum", "")) and header["checksum"] != base32_sha1(body):
            raise ValueError("a record's body doesn't have its checksum")
        at = end + 1 + size
        if not line.startswith("filedesc://"):
            yield header, body


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its blank line, and payload; without a header, all is payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    head, found, payload = body.partition(b"\r\n\r\n")
    return (head + found, payload) if found else (body, b"")


def http_field(head: bytes, name: str) -> str | None:
    found = re.search(rf"\r\n{re.escape(name)}:[ \t]*([^\r\n]*)".encode(), head, re.I)
    return found[1].decode("utf-8", "replace").strip() if found else None


def timestamp(date: str) -> str:
    """YYYYMMDDhhmmss, or a shorter form of it, as a W3C date."""
    full = date + "00000101000000"[len(date) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


@dataclass
class Record:
    type: str
    url: str
    date: str
    id: str
    head: bytes
    payload: bytes
    fields: dict[str, str] = field(default_factory=dict)
    kind: str = "application/octet-stream"

    def serialised(self) -> bytes:
        """The record without the line breaks that end it."""
        body = self.head + self.payload
        lines = [
            f"WARC-Type: {self.type}",
            f"WARC-Record-ID: {self.id}",
            f"WARC-Date: {self.date}",
            f"WARC-Target-URI: {self.url}",
            *(f"{k}: {v}" for k, v in self.fields.items()),
            f"WARC-Block-Digest: sha1:{base32_sha1(body)}",
            f"Content-Type: {'application/http; msgtype=response' if self.head else self.kind}",
            f"Content-Length: {len(body)}",
        ]
        return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + body


def record_id(url: str, date: str, digest: str, number: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, ' '.join((url, date, digest, number)))}>"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, by lower-case name, and block of each record."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError("not a WARC record")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        at = end + 4 + int(fields["content-length"])
        body = data[end + 4 : at]
        if len(body) < int(fields["content-length"]) or data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record is shorter than it says")
        if f"sha1:{base32_sha1(body)}" != fields.get("warc-block-digest", f"sha1:{base32_sha1(body)}"):
            raise ValueError("a record's block doesn't have its digest")
        at += 4
        yield fields, body


def _arc_files(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Whole ARC files, a row for each; they take turns at the versions."""
    from pyspark import TaskContext

    part, date = TaskContext.get().partitionId(), "20240601120000"
    out: list[bytes] = []
    held = made = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            for page, url, html in zip(*(c.slice(at, 500).to_pylist() for c in batch.columns), strict=True):
                version, name = 1 + (part + made) % 2, f"part-{part:05d}-{made:05d}.arc"
                if not out:
                    out.append(arc_version_block(version, name, date))
                payload = (html or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {'' if page is None else page}\r\n\r\n".encode()
                out.append(arc_record(version, url, "192.0.2.1", date, head + payload, name=name))
                held += len(out[-1])
                if held >= limit:
                    yield _file(b"\n".join(out))
                    out, held, made = [], 0, made + 1
    if out:
        yield _file(b"\n".join(out))


def _file(content: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["value"])


def _write_files(rows: DataFrame, to: str, end: str) -> None:
    """A file for each row (value), which the separator ends."""
    rows.select(F.col("value").cast("string")).write.option("lineSep", end).option("maxRecordsPerFile", 1).option("compression", "gzip").text(to)


def write_arc(pages: DataFrame, to: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES) -> None:
    """Write pages as ARC files of about file_bytes."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    _write_files(rows.mapInArrow(partial(_arc_files, limit=file_bytes), "value binary"), to, "\n")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


_FOUND = "path string, at int, number string, url string, date string, digest string, bytes long"


def _index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What decides on records' types: all but their bodies."""
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            rows = []
            for at, (header, body) in enumerate(parse_arc(gzip.decompress(content))):
                head, payload = split_http(body)
                rows.append((path, at, http_field(head, "X-Page-Id") or None, header["url"], timestamp(header["date"]), base32_sha1(payload), len(payload)))
            if rows:
                yield pd.DataFrame(rows, columns=["path", "at", "number", "url", "date", "digest", "bytes"])


def _to_warc(frames: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for content, revisits in zip(frame["content"], frame["revisits"], strict=True):
            of = {r["at"]: r for r in revisits} if revisits is not None else {}
            out: list[bytes] = []
            held = 0
            for at, (header, body) in enumerate(parse_arc(gzip.decompress(content))):
                out.append(converted(header, body, of.get(at)).serialised())
                held += len(out[-1])
                if held >= limit:
                    yield pd.DataFrame({"value": [END.encode().join(out)]})
                    out, held = [], 0
            if out:
                yield pd.DataFrame({"value": [END.encode().join(out)]})


def converted(header: dict[str, str], body: bytes, of: dict[str, str] | None = None) -> Record:
    """An ARC record as a WARC response, or as a revisit of another record (its url, date and number)."""
    head, payload = split_http(body)
    url, date, digest = header["url"], timestamp(header["date"]), base32_sha1(payload)
    mine = record_id(url, date, digest, http_field(head, "X-Page-Id") or "")
    fields = {"WARC-IP-Address": header["ip"], "WARC-Payload-Digest": f"sha1:{digest}"}
    if of is not None:
        fields |= {
            "WARC-Refers-To": record_id(of["url"], of["date"], digest, of["number"] or ""),
            "WARC-Refers-To-Target-URI": of["url"],
            "WARC-Refers-To-Date": of["date"],
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        }
    return Record("response" if of is None else "revisit", url, date, mine, head, payload if of is None else b"", fields, header["type"])


def arc_to_warc(spark: SparkSession, arc: str, to: str, least: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Convert the ARC files of a folder to WARC files of about file_bytes in another.

    Of records whose payloads are equal and have `least` bytes or more, that with the largest page id (else the
    last in the order of the files) is a response; the others revisit it.
    """
    files, key = _files(spark, arc), ["digest", "bytes"]
    found = saved(files.mapInPandas(_index, _FOUND), "arc-index")
    last = found.where(F.col("bytes") >= least).groupBy(*key).agg(F.max(F.struct(F.col("number").cast("long").alias("id"), "path", "at", "url", "date", "number")).alias("of"), F.count("*").alias("copies")).where("copies > 1")
    # written first, so that both sides of the join are dealt anew and Spark can split a payload that very many records have
    revisits = found.select("path", "at", *key).join(saved(last, "payloads"), key).where((F.col("at") != F.col("of.at")) | (F.col("path") != F.col("of.path")))
    by_file = revisits.groupBy("path").agg(F.collect_list(F.struct("at", F.col("of.url").alias("url"), F.col("of.date").alias("date"), F.col("of.number").alias("number"))).alias("revisits"))
    ready = files.join(by_file, "path", "left").select("content", "revisits")
    _write_files(ready.mapInPandas(partial(_to_warc, limit=file_bytes), "value binary"), to, END)


def _from_warc(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for content in frame["content"]:
            rows = []
            for fields, body in parse_warc(gzip.decompress(content)):
                head, payload = split_http(body)
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                size = len(payload) if fields["warc-type"] == "response" else int(http_field(head, "Content-Length") or 0)
                if fields["warc-type"] == "response" and base32_sha1(payload) != digest:
                    raise ValueError("a record's payload doesn't have its digest")
                number = http_field(head, "X-Page-Id")
                rows.append((fields["warc-record-id"], int(number) if number else None, size, digest, fields["warc-type"], fields.get("warc-refers-to")))
            if rows:
                out = pd.DataFrame(rows, columns=["record_id", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to_id"])
                out["page_id"] = out["page_id"].astype("Int64")
                yield out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record_id, page_id, payload_bytes, payload_digest, record_type and refers_to_id of each record of a folder of WARC files."""
    return _files(spark, path).mapInPandas(_from_warc, "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to_id string")


def archived(pages: DataFrame, least: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages to ARC, convert to WARC and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    arc, warc = new_dir(spark, "arc"), new_dir(spark, "warc")
    write_arc(pages, arc, file_bytes=file_bytes)
    arc_to_warc(spark, arc, warc, least, file_bytes)
    rows = saved(read_warc(spark, warc), "warc-index")
    of = rows.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).dropDuplicates(["refers_to_id"])
    return rows.join(of.hint("merge"), "refers_to_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM h
"""
