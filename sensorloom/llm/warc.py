"""Legacy archives: write ARC, convert ARC to WARC, read WARC.

ARC files (version 1 and 2) name their record fields in the version block; a record is one header
line, whose last field is the declared length, and so many bytes.  The
converter parses both versions by those fields and makes WARC records: ids from the
place in the archive, timestamps from the 14-digit date, types from the block (an
HTTP message or not) and repeats, SHA-1 digests from the payload.

Archives are written by Spark's text writer (a record per row, the record
separator as line separator, gzip), so they go through the session's file
systems and commit protocol, and are read by the ``binaryFile`` source.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_path

#: Record fields of the two ARC versions, as their version blocks name them (fixed values of the format).
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length",
          2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
ARC_END, WARC_END = "\n", "\r\n\r\n"
SPACE = uuid.UUID("5f6d2d6c-6c6f-5d6d-8a6b-617263776172")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_HEADER, REFERS_HEADER = "X-Page-Id", "X-Refers-To-Page-Id"


def _safe(url: str | None) -> str:
    """A URL as one header field: blanks and controls are percent-encoded; none is '-'."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "-"


def http_response(payload: str, extra: dict[str, str]) -> str:
    head = {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(payload.encode("utf-8", "surrogatepass"))), **extra}
    return "HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n" + payload


def _arc_rows(version: int, date: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = FIELDS[version]
        body = f"{version} 0 archive\n{names}\n"
        head = f"filedesc://pages.arc 0.0.0.0 {date} text/plain" + (" 200 - - 0 pages.arc" if version == 2 else "")
        first = f"{head} {len(body)}\n{body}"
        for df in frames:
            out = [first] if first else []
            first = None
            for page, url, html in zip(df.page_id, df.url, df.html):
                block = http_response(html or "", {} if pd.isna(page) else {ID_HEADER: str(int(page))})
                size = len(block.encode("utf-8"))
                fields = [_safe(url), "0.0.0.0", date, "text/html"]
                if version == 2:
                    fields += ["200", "-", "-", "0", "pages.arc"]
                out.append(f"{' '.join(fields)} {size}\n{block}")
            yield pd.DataFrame({"value": out})
        if first:
            yield pd.DataFrame({"value": [first]})
    return run


def write_arc(pages: DataFrame, path: str, *, version: int = 1, date: str = "20200101000000") -> None:
    """Write pages (page_id, url, html) as gzipped ARC files, one per partition, each with its version block.
    A null html is an empty payload, a null URL is '-'."""
    rows = pages.select(F.col("page_id").cast("string").cast("long").alias("page_id"), "url", "html")
    rows.mapInPandas(_arc_rows(version, date), "value string").write.option("lineSep", ARC_END).option("compression", "gzip").text(path)


class Stream:
    """Reads lines and byte counts from gzip or plain content, a bounded part inflated at a time."""

    def __init__(self, content: bytes, step: int = 1 << 18):
        self.raw, self.at, self.step = memoryview(content), 0, step
        self.gzip = content[:2] == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31) if self.gzip else None
        self.buf, self.pos = bytearray(), 0

    def _more(self) -> bool:
        if self.pos > self.step:
            del self.buf[:self.pos]
            self.pos = 0
        while True:
            if self.gzip and self.inflate.eof:  # the next member of the file
                rest = self.inflate.unused_data
                self.inflate = zlib.decompressobj(31)
                self.at -= len(rest)
            if self.at >= len(self.raw):
                return False
            chunk = bytes(self.raw[self.at:self.at + self.step])
            self.at += len(chunk)
            got = self.inflate.decompress(chunk) if self.gzip else chunk
            if got:
                self.buf += got
                return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the content."""
        look = self.pos
        while (i := self.buf.find(b"\n", look)) < 0:
            shift = self.pos
            look = len(self.buf)
            if not self._more():
                if self.pos >= len(self.buf):
                    return None
                i = len(self.buf)
                break
            look -= shift - self.pos
        out = bytes(self.buf[self.pos:i])
        self.pos = min(i + 1, len(self.buf))
        return out

    def read(self, n: int) -> bytes:
        while len(self.buf) - self.pos < n and self._more():
            pass
        out = bytes(self.buf[self.pos:self.pos + n])
        self.pos += len(out)
        return out


def arc_records(content: bytes) -> Iterator[dict]:
    """Records of an ARC file after its version block: the named fields, ``number`` and ``block``.

    The field names come from the version block, else from the version 1 list.  URLs with blanks are
    allowed: fields are split from the right.  A line that is no header is skipped."""
    s, names, number = Stream(content), FIELDS[1].split(), 0
    while (line := s.line()) is not None:
        text = line.decode("utf-8", "replace").rstrip("\r")
        if not text.strip():
            continue
        if text.startswith("filedesc://"):
            size = text.rsplit(" ", 1)[-1]
            body = s.read(int(size)).decode("utf-8", "replace").split("\n") if size.isdigit() else []
            if len(body) > 1 and body[1].startswith("URL "):
                names = body[1].split()
            continue
        fields = text.rsplit(" ", len(names) - 1)
        if len(fields) != len(names) or not fields[-1].isdigit():
            continue
        block = s.read(int(fields[-1]))
        yield dict(zip(names, fields), number=number, block=block)
        number += 1


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(head with its blank line, payload) of an HTTP message; no head if it is none."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    i = block.find(b"\r\n\r\n")
    j = block.find(b"\n\n")
    end = i + 4 if i >= 0 and (j < 0 or i < j) else j + 2 if j >= 0 else len(block)
    return block[:end], block[end:]


def header(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name).encode() + rb":[ \t]*(.*?)\r?$", head)
    return m[1].decode("utf-8", "replace") if m else None


def timestamp(date: str) -> str:
    """14-digit ARC date (shorter ones filled up) as a WARC date; the epoch if it is none."""
    d = re.sub(r"[^0-9]", "", date or "")[:14]
    d = d + "19700101000000"[len(d):] if len(d) >= 4 else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


PARSED = "record_id string, page_id long, uri string, ip string, date string, kind string, mime string, head string, payload binary, n_bytes long, sha1 string"


def _parse_arc(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in frames:
        for path, content in zip(df.path, df.content):
            rows, held = [], 0
            name = os.path.basename(path)
            for r in arc_records(content):
                head, payload = split_http(r["block"])
                page = header(head, ID_HEADER)
                rows.append((f"<urn:uuid:{uuid.uuid5(SPACE, name + ':' + str(r['number']))}>", int(page) if page and re.fullmatch(r"-?\d+", page) else None, r["URL"],
                             r["IP-address"], timestamp(r["Archive-date"]), "response" if head else "resource", r["Content-type"],
                             head.decode("latin-1"), payload, len(payload), hashlib.sha1(payload).hexdigest()))
                held += len(payload)
                if held > 8 << 20 or len(rows) >= 2000:
                    yield _frame(rows, PARSED)
                    rows, held = [], 0
            if rows:
                yield _frame(rows, PARSED)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    out = pd.DataFrame(rows, columns=names, dtype=object)
    for c in schema.split(", "):
        if c.endswith(" long"):
            out[c.split()[0]] = out[c.split()[0]].astype("Int64")
    return out


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Parsed records of the ARC files below ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_parse_arc, PARSED)


def _label(sha1: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()


def _warc_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in frames:
        out = []
        for r in df.itertuples(index=False):
            revisit = r.refers_to is not None and not pd.isna(r.refers_to)
            kind = "revisit" if revisit else r.kind
            head = r.head.encode("latin-1")
            block = head if revisit else head + bytes(r.payload)
            fields = [("WARC-Type", kind), ("WARC-Record-ID", r.record_id), ("WARC-Date", r.date), ("WARC-Target-URI", r.uri), ("WARC-IP-Address", r.ip),
                      ("WARC-Payload-Digest", _label(r.sha1)), ("WARC-Block-Digest", _label(hashlib.sha1(block).hexdigest())),
                      ("Content-Type", "application/http; msgtype=response" if head else r.mime)]
            if revisit:
                fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", r.refers_to), ("X-Payload-Length", str(r.n_bytes))]
                if not pd.isna(r.refers_to_page):
                    fields.append((REFERS_HEADER, str(int(r.refers_to_page))))
            fields.append(("Content-Length", str(len(block))))
            out.append(b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block)
        yield pd.DataFrame({"value": out})


def with_revisits(records: DataFrame, min_bytes: int = 1000, salt: int = 16) -> DataFrame:
    """Records with ``refers_to`` and ``refers_to_page``: of equal payloads of ``min_bytes`` or more, the record of
    the largest page id (then the largest record id) is the response, the others point to it.

    The groups are found on digests alone, with map-side maxima; the join back is salted, so that a
    payload that a third of all records share is spread over ``salt`` tasks."""
    big = records.where(F.col("n_bytes") >= min_bytes).groupBy("sha1", "n_bytes") \
        .agg(F.count("*").alias("n"), F.max(F.struct("page_id", "record_id")).alias("to")).where("n > 1")
    big = big.select("sha1", "n_bytes", F.col("to.record_id").alias("to_record"), F.col("to.page_id").alias("to_page"),
                     F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("salt"))
    own = records.withColumn("salt", F.pmod(F.crc32("record_id"), F.lit(salt)).cast("int"))
    out = own.join(big, ["sha1", "n_bytes", "salt"], "left")
    other = F.col("to_record").isNotNull() & (F.col("to_record") != F.col("record_id"))
    return out.withColumn("refers_to", F.when(other, F.col("to_record"))).withColumn("refers_to_page", F.when(other, F.col("to_page"))) \
        .drop("salt", "to_record", "to_page")


def convert(spark: SparkSession, arc_path: str, warc_path: str, *, min_bytes: int = 1000) -> None:
    """Convert the ARC files below ``arc_path`` to gzipped WARC files."""
    records = with_revisits(read_arc(spark, arc_path), min_bytes)
    rows = records.mapInPandas(_warc_rows, "value binary").select(F.col("value").cast("string"))  # the cast keeps the bytes
    rows.write.option("lineSep", WARC_END).option("compression", "gzip").text(warc_path)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields in lower case, block) of each record."""
    s = Stream(content)
    while (line := s.line()) is not None:
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, str] = {}
        while (line := s.line()) not in (None, b"", b"\r"):
            k, _, v = line.decode("utf-8", "replace").rstrip("\r").partition(":")
            fields[k.strip().lower()] = v.strip()
        yield fields, s.read(int(fields.get("content-length", "0") or 0))


READ = ("record_id string, record_type string, uri string, date string, page_id long, payload_bytes long, payload_digest string, refers_to long, "
        "refers_to_record string, digest_ok boolean, payload binary")


def _parse_warc(with_payload: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for content in df.content:
                rows, held = [], 0
                for fields, block in warc_records(content):
                    kind = fields.get("warc-type", "")
                    head, payload = split_http(block) if fields.get("content-type", "").startswith("application/http") else (b"", block)
                    page, to = header(head, ID_HEADER), fields.get(REFERS_HEADER.lower())
                    label = fields.get("warc-payload-digest", "")
                    declared = base64.b32decode(label[5:]).hex() if label.startswith("sha1:") else None
                    if kind == "revisit":
                        size, digest, ok = int(fields.get("x-payload-length", "0")), declared, None
                    else:
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        ok = digest == declared
                    rows.append((fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-date"),
                                 int(page) if page else None, size, digest, int(to) if to else None, fields.get("warc-refers-to"), ok,
                                 payload if with_payload and kind != "revisit" else None))
                    held += len(payload) * with_payload
                    if held > 8 << 20 or len(rows) >= 2000:
                        yield _frame(rows, READ)
                        rows, held = [], 0
                if rows:
                    yield _frame(rows, READ)
    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of the WARC files below ``path``; ``digest_ok`` says that the payload has the declared digest."""
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_parse_warc(with_payload), READ)


def archive_pages(pages: DataFrame, *, version: int = 1, min_bytes: int = 1000, with_payload: bool = False) -> DataFrame:
    """Pages (page_id, url, html) written as ARC, converted to WARC and read back: a row per page.

    A null html is an empty payload, a null URL '-', a null page id stays null; repeated rows are
    records of their own; an empty table gives no rows; other columns are ignored."""
    spark = pages.sparkSession
    arc, warc = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_arc(pages, arc, version=version)
    convert(spark, arc, warc, min_bytes=min_bytes)
    return read_warc(spark, warc, with_payload)
