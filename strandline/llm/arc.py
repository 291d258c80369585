"""Legacy ARC archives converted to WARC, written and read by Spark.

ARC files start with a version block (``filedesc://``) that says which header line its records have:
version 1 has URL, address, date, type and length; version 2 adds result code, checksum, location,
offset and file name before the length. After the header line come as many bytes as it declares,
then a line feed. The converter makes a WARC record of each: identifiers are UUIDs over URL, date
and payload digest, dates turn from 14 digits to ISO form, the type is response where there is an
HTTP head and resource elsewhere (revisit where the caller says so), digests are base32 SHA-1.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import fresh_path, materialise, small, whole_text

#: Header fields of ARC records by version (fixed values of the format).
ARC_FIELDS = {
    "1": ["url", "ip", "date", "type", "length"],
    "2": ["url", "ip", "date", "type", "result", "checksum", "location", "offset", "file", "length"],
}
CRLF = b"\r\n"
#: Payloads of fewer bytes are stored again rather than revisited.
LEAST_REVISIT = 1000
PAGE_DATE = "20240101000000"
#: An archive is closed once it has this many bytes before compression.
ARCHIVE_BYTES = 32 * 1024 * 1024


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    type: str
    content: bytes

    def payload(self) -> bytes:
        """The content without an HTTP head."""
        if self.content.startswith(b"HTTP/"):
            return self.content.partition(b"\r\n\r\n")[2]
        return self.content


def write_arc(records: list[ArcRecord], version: str, name: str = "pages.arc") -> bytes:
    """An ARC file: version block, then records. Spaces in fields are percent-encoded; empty fields become ``-``."""
    block = f"{version} 0 strandline\n{' '.join(_TITLES[version])}\n".encode()
    first = ArcRecord(f"filedesc://{name}", "0.0.0.0", PAGE_DATE, "text/plain", block)
    out, at = [], 0
    for r in [first, *records]:
        sha = base64.b32encode(hashlib.sha1(r.content).digest()).decode()
        has = {"url": r.url, "ip": r.ip, "date": r.date, "type": r.type, "result": "200", "checksum": sha, "location": "-", "offset": str(at), "file": name, "length": str(len(r.content))}
        line = " ".join(re.sub(r"\s", lambda m: quote(m[0]), has[f]) or "-" for f in ARC_FIELDS[version])
        made = line.encode() + b"\n" + r.content + b"\n"
        out.append(made)
        at += len(made)
    return b"".join(out)


#: Titles in the version block (fixed values of the format).
_TITLES = {
    "1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    "2": ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file of either version, without its version block.

    The length a record declares is what counts: a line feed inside the content ends nothing. A file
    that is cut off or has no version block raises ValueError.
    """
    at, fields = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("a header line has no end")
        parts = data[at:end].decode("utf-8").split(" ")
        size = int(parts[-1])
        content = data[end + 1 : end + 1 + size]
        if len(content) < size:
            raise ValueError("a record is cut off")
        if fields is None:
            if not parts[0].startswith("filedesc://"):
                raise ValueError("no version block")
            fields = ARC_FIELDS[content.split(b" ", 1)[0].decode()]
        else:
            if len(parts) != len(fields):
                raise ValueError(f"a header line has {len(parts)} fields, not {len(fields)}")
            got = dict(zip(fields, parts, strict=True))
            yield ArcRecord(got["url"], got["ip"], got["date"], got["type"], content)
        at = end + 1 + size + 1


def record_id(url: str, date: str, digest: str, page_id: str | None = None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {page_id}')}>"


def warc_date(date: str) -> str:
    """14 digits (or fewer, filled up) to ISO form."""
    d = (date + "00000101000000"[len(date):])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def to_warc(record: ArcRecord, more: dict[str, str], revisit: str | None = None) -> bytes:
    """A WARC record without the two line ends that close it. ``revisit``: the URL-less id it refers to."""
    payload = record.payload()
    head = record.content[: len(record.content) - len(payload)]
    sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = head if revisit else record.content
    kind = "revisit" if revisit else "response" if head else "resource"
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(record.url, record.date, sha, more.get("X-Page-Id")),
        "WARC-Date": warc_date(record.date),
        "WARC-Target-URI": record.url,
        "WARC-IP-Address": record.ip,
        "WARC-Payload-Digest": f"sha1:{sha}",
        "WARC-Block-Digest": f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
    }
    if revisit:
        fields |= {"WARC-Refers-To": revisit, "WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"}
    fields |= more | {
        "Content-Type": "application/http; msgtype=response" if head else record.type,
        "Content-Length": str(len(block)),
    }
    lines = [b"WARC/1.0", *(f"{k}: {v}".encode() for k, v in fields.items())]
    return CRLF.join(lines) + CRLF + CRLF + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record; gzip files are unpacked. Lengths rule, not separators."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if end < 0 or lines[0] != "WARC/1.0":
            raise ValueError("not a WARC record")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield fields, block
        at = end + 8 + size


def _rolled(parts: Iterator[list[bytes]]) -> Iterator[pd.DataFrame]:
    """Records in archives of about ``ARCHIVE_BYTES``, however long single records are; the last separator is left to the writer."""
    kept, size = [], 0
    for part in parts:
        for record in part:
            if kept and size + len(record) > ARCHIVE_BYTES:
                yield pd.DataFrame({"value": [(CRLF + CRLF).join(kept)]})
                kept, size = [], 0
            kept.append(record)
            size += len(record)
    if kept:
        yield pd.DataFrame({"value": [(CRLF + CRLF).join(kept)]})


def _write_archives(archives: DataFrame, path: str) -> None:
    """One gzip file for each row, through Spark's commit protocol; the writer's line end is what closes a record."""
    files = archives.select(F.col("value").cast("string").alias("value"))
    files.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def convert_archives(spark: SparkSession, arcs: str, path: str) -> DataFrame:
    """Converts the ARC files under ``arcs`` (plain or gzip) to WARC archives under ``path``.

    Returns a row for each ARC file: path, records, error. A damaged file gives the records before the damage and a
    message in ``error``; the others are converted all the same. Payloads are stored whole, nothing is a revisit.
    """

    def parsed(content: bytes) -> tuple[list[ArcRecord], str | None]:
        found: list[ArcRecord] = []
        try:
            for r in parse_arc(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content):
                found.append(r)
        except (ValueError, KeyError, IndexError, EOFError, OSError) as damage:
            return found, f"{type(damage).__name__}: {damage}"
        return found, None

    def convert(frames: Iterator[pd.DataFrame]) -> Iterator[list[bytes]]:
        for frame in frames:
            for content in frame["content"]:
                yield [to_warc(r, {"X-Payload-Length": str(len(r.payload()))}) for r in parsed(content)[0]]

    def report(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [parsed(content) for content in frame["content"]]
            yield pd.DataFrame({"path": frame["path"], "records": [len(f) for f, _ in found], "error": [e for _, e in found]})

    files = spark.read.format("binaryFile").load(arcs).select("path", "content")
    _write_archives(files.select("content").mapInPandas(lambda frames: _rolled(convert(frames)), "value binary"), path)
    return files.mapInPandas(report, "path string, records long, error string")


def _url(page_id: str | None, url: str | None) -> str:
    return quote(url, safe=":/?&=#%+,;@!$'()*~[]") if url else f"unknown:{page_id}"


def pages_to_warc(pages: DataFrame, path: str) -> None:
    """Writes every row of ``pages`` as an ARC record, converts those and writes WARC archives.

    Of rows with equal payloads of at least ``LEAST_REVISIT`` bytes, the one with the largest page_id is
    stored; the others become revisits of it. The groups are found on digests alone, with partial
    aggregation, and only groups of more than one row are joined back, so a payload that a third of
    all rows share is split like any other. Null html is empty, a null url becomes ``unknown:``, and
    a null page_id is less than any other. Repeated rows that have the stored one's page_id are stored too. Other columns
    aren't used, and an empty table writes no record.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", whole_text("html").alias("html"))
    rows = rows.withColumns({"digest": F.sha1("html"), "size": F.octet_length("html")})
    groups = rows.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(
        F.max(F.struct("page_id", "url")).alias("kept"), F.count("*").alias("n")
    )
    groups = materialise(groups.where("n > 1").select(F.col("digest").alias("group_digest"), "kept"), "revisit-groups")
    same = (F.col("digest") == F.col("group_digest")) & (F.col("size") >= LEAST_REVISIT)
    rows = rows.join(small(groups, 256), same, "left").drop("group_digest", "size", "digest")
    rows = rows.withColumns({"keeper": F.col("kept.page_id"), "keeper_url": F.col("kept.url"), "revisits": F.coalesce(F.col("kept.page_id") != F.coalesce(F.col("page_id"), F.lit(-(2**63))), F.lit(False))}).drop("kept")
    # ids go as text: a batch with a null would make them floating-point numbers
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "keeper")})

    def convert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, frame in enumerate(frames):
            version, made, data = "12"[k % 2], [], []
            for r in frame.itertuples(index=False):
                body = r.html.encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                made.append(ArcRecord(_url(r.page_id, r.url), "0.0.0.0", PAGE_DATE, "text/html", head + body))
            for r, record in zip(frame.itertuples(index=False), parse_arc(write_arc(made, version)), strict=True):
                payload, refers = record.payload(), None
                more = {"X-Payload-Length": str(len(payload)), "X-Arc-Version": version}
                if r.page_id is not None:
                    more["X-Page-Id"] = r.page_id
                if r.revisits:
                    sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    refers = record_id(_url(r.keeper, r.keeper_url), PAGE_DATE, sha, r.keeper)
                    more["X-Refers-To-Page-Id"] = r.keeper
                data.append(to_warc(record, more, refers))
            yield data

    _write_archives(rows.mapInPandas(lambda frames: _rolled(convert(frames)), "value binary"), path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, target_uri, block_ok.

    ``block_ok``: the stored block has the declared digest, and a stored payload that of the payload.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                out = []
                for f, block in parse_warc(content):
                    sha = base64.b32decode(f["WARC-Payload-Digest"][5:])
                    ok = base64.b32encode(hashlib.sha1(block).digest()).decode() == f["WARC-Block-Digest"][5:]
                    size = int(f["X-Payload-Length"])
                    if f["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        ok = ok and len(payload) == size and hashlib.sha1(payload).digest() == sha
                    page, other = f.get("X-Page-Id"), f.get("X-Refers-To-Page-Id")
                    out.append((page and int(page), size, sha.hex(), f["WARC-Type"], other and int(other), f["WARC-Record-ID"], f["WARC-Target-URI"], ok))
                made = pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri", "block_ok"])
                yield made.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, block_ok boolean")


def page_archives(pages: DataFrame) -> DataFrame:
    """Writes the archives in the shared folder and reads them back, one row per page."""
    path = fresh_path(pages.sparkSession, "warc")
    pages_to_warc(pages, path)
    return read_warc(pages.sparkSession, path)
