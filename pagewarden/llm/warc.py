"""WARC archives: a writer and a sequential reader.

Every record is a gzip member of its own. An archive is a row of a table with
its bytes, so Spark's commit and store do the rest; files ending in .warc.gz read
by ``binaryFile`` have the same two columns. The reader walks an archive once: it
feeds bytes to zlib piece by piece, frames each record by its content length and
checks the payload's digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import scratch, written

ROLL = 4 << 20  # compressed bytes after which an archive is closed
PIECE = 64 << 10  # bytes fed to zlib at once
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE, NO_ID = "urn:page:", "<urn:no-page>"
DATE = "2024-01-01T00:00:00Z"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_RECORD = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, digest_ok boolean, payload binary, url string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page: str | None) -> str:
    """Record id of a page id, percent-encoded so that any string is one header value."""
    return NO_ID if page is None else f"<{PAGE}{quote(page, safe='')}>"


def record(page: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    """One gzip member: WARC header, HTTP header, and the payload unless it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {DATE}"]
    head.append(f"WARC-Record-ID: {_urn(page)}")
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return member.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + member.flush()


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for page, url, html, leader in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "html", "leader"))):
            held.append(record(page, url, (html or "").encode(), leader, leader is not None))
            size += len(held[-1])
            if size >= ROLL:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["content"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["content"])


class Reader:
    """Records of one archive, in order. Holds one record and one piece at a time."""

    def __init__(self, content: bytes):
        self.content, self.at = memoryview(content), 0

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while self.at < len(self.content):
            yield self._record()

    def _record(self) -> tuple[dict[str, str], bytes]:
        inflate = zlib.decompressobj(31)
        data, headers, end = bytearray(), None, None
        while not inflate.eof:
            if self.at >= len(self.content):
                raise ValueError("the archive ends inside a record")
            piece = self.content[self.at : self.at + PIECE]
            data += inflate.decompress(piece)
            self.at += len(piece) - len(inflate.unused_data)
            if headers is None and (split := data.find(b"\r\n\r\n")) >= 0:
                headers = parse(bytes(data[:split]))
                end = split + 4 + int(headers["content-length"])
        if headers is None or len(data) < end + 4 or data[end : end + 4] != b"\r\n\r\n":
            raise ValueError("a record does not fit its content length")
        return headers, bytes(data[end - int(headers["content-length"]) : end])


def parse(head: bytes) -> dict[str, str]:
    """Header fields by lower-cased name."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _page(value: str | None) -> str | None:
    """Page id of a record id; ids of other writers are given as they are, without brackets."""
    if not value or value == NO_ID:
        return None
    inner = value.removeprefix("<").removesuffix(">")
    return unquote(inner.removeprefix(PAGE)) if inner.startswith(PAGE) else inner


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _RECORD.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.binary(), pa.string()]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names)

    for batch in batches:
        for content in batch.column("content"):
            found, size = [], 0
            for headers, block in Reader(content.as_py()):
                if headers["warc-type"] not in ("response", "revisit"):
                    continue
                http, _, payload = block.partition(b"\r\n\r\n")
                fields = parse(http)
                stated = headers.get("warc-payload-digest", "").removeprefix("sha1:")
                revisit = headers["warc-type"] == "revisit"
                length = int(fields.get("content-length", len(payload)))
                found.append((
                    _page(headers.get("warc-record-id")), length, stated, headers["warc-type"], _page(headers.get("warc-refers-to")),
                    None if revisit else digest(payload) == stated and length == len(payload),
                    None if revisit else payload, headers.get("warc-target-uri"),
                ))
                size += len(payload)
                if size > ROLL:
                    yield rows(found)
                    found, size = [], 0
            yield rows(found)


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Archives (content) of all pages, written to ``folder``.

    Of pages with equal payloads of at least ``least`` bytes the one with the
    largest page_id is the response; the others revisit it and name it. A null
    html is an empty payload. Rows that repeat the largest page_id are responses
    too; null ids revisit, and are responses where no page of their payload has
    an id. Ids are any strings: blanks, line breaks and empty ones come back. A
    null url is left out; other columns are not written.
    """
    rows = pages.select(F.col("page_id").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("d", F.sha1(F.encode("html", "UTF-8")))
    sizes = F.octet_length("html") >= least
    leaders = (
        rows.filter(sizes).groupBy("d").agg(F.max("page_id").alias("leader"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and leader is not null").select("d", "leader")
    )
    leaders = written(leaders, folder, "leaders")  # so that a hot digest's pages can be split in the join
    led = rows.join(leaders, "d", "left")
    leader = F.when(F.col("page_id").eqNullSafe(F.col("leader")), None).otherwise(F.col("leader"))
    led = led.select(F.col("page_id").cast("string").alias("page"), "url", "html", leader.cast("string").alias("leader"))
    return written(led.mapInArrow(_write, "content binary"), folder, "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of archives (content): ids, payload size and digest, type, reference, payload.

    ``digest_ok`` tells if the payload fits its stated digest and length; it is
    null for revisits, which have no payload of their own. A broken archive raises.
    """
    return archives.select("content").mapInArrow(_read, _RECORD)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the archives of ``pages`` and read them back, ids in their own type."""
    kind = dict(pages.dtypes)["page_id"]
    back = read_archives(write_archives(pages, scratch(pages.sparkSession), least))
    return back.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
