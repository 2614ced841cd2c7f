"""Writing web pages to WARC archives, and a reader that salvages what it can from damaged ones.

Archives hold one gzip member per record. Spark's text sink writes them: a member of less than 16 MiB ends in a zero byte
(the highest of its length), so members without that byte, with a zero character as line separator, make up exactly the
bytes of an archive; a longer record is cut into several members. Pages of equal payload are stored once, as the response
with the largest page_id; the others become revisits that name it.

The reader takes each archive, of bounded size, as one binary row. A record counts if its member passes gzip's check, its
version line, headers and length agree, and its payload has the stated digest. After a failed check the reader looks for
the next place where a valid member or version line starts, goes on there, and reports the bytes between as a gap. Plain
(uncompressed) records are read likewise.

Defined results: a null html is an empty payload; a null url leaves out the target header; page_ids sort behind nothing
(null is the smallest), and of rows with equal payload and equal page_id one is the response; an empty table writes no
records; extra columns are ignored. Payloads of any length are stored whole; one record must fit in a task's memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .arrow import pieces
from .common import join_groups, numbered_rows, total_bytes, written

#: Payload bytes of an archive, about.
ARCHIVE_BYTES = 32 << 20
_MEMBER_BYTES = (16 << 20) - 1

RECORDS = (
    "archive string, start long, length long, problem string, record_id string, record_type string, url string, refers_to string,"
    " payload_digest string, payload_bytes long, payload binary"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id: int | None, url: str | None, payload: bytes, revisits: bool, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisits else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisits else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if revisits:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>")
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _members(record: bytes) -> bytes:
    out = []
    for start in range(0, len(record), _MEMBER_BYTES):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(packer.compress(record[start : start + _MEMBER_BYTES]) + packer.flush())
    return b"".join(out)


def _pack(batches):
    for batch in batches:
        for piece in pieces(batch, "html", 8 << 20):
            rows = zip(*(piece.column(name).to_pylist() for name in ("page_id", "url", "html", "revisits", "refers_to")), strict=True)
            packed = [_members(_record(page, url, (html or "").encode(), revisits, refers))[:-1] for page, url, html, revisits, refers in rows]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["member"])


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives of pages (page_id, url, html) in a new folder."""
    ship(pages.sparkSession)
    base = numbered_rows(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"))
    text = F.coalesce(F.col("html"), F.lit(""))
    keys = written(base.select("page_id", "row", F.unhex(F.sha2(text, 256)).alias("digest")), "payloads")
    groups = keys.groupBy("digest").agg(F.max(F.struct("page_id", "row")).alias("last"), F.count("*").alias("size"))
    groups = written(groups.filter("size > 1"), "payload-groups")
    several = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    repeats = join_groups(keys, groups, "digest", "size", several).filter(F.col("row") != F.col("last.row"))
    repeats = repeats.select("row", F.lit(True).alias("revisits"), F.col("last.page_id").alias("refers_to"))
    dealt = base.join(repeats, "row", "left")
    dealt = dealt.select("page_id", "url", "html", F.coalesce("revisits", F.lit(False)).alias("revisits"), "refers_to")
    members = dealt.mapInArrow(_pack, "member binary").select(F.col("member").cast("string"))
    # The mean size of a payload bounds the archives, whatever the partitions.
    records = max(1, archive_bytes * keys.count() // (1 + total_bytes(base, "html")))
    members.write.option("lineSep", "\0").option("maxRecordsPerFile", records).text(path)


class _Invalid(Exception):
    pass


_VERSION = re.compile(rb"WARC/1\.[01]\r\n")


def _parse(data: bytes, start: int) -> tuple[int, dict]:
    """End and content of the plain record at a place."""
    version = _VERSION.match(data, start)
    if not version:
        raise _Invalid("no version line")
    head = data.find(b"\r\n\r\n", start)
    if head < 0:
        raise _Invalid("headers don't end")
    headers = {}
    for line in data[version.end() : head].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise _Invalid("bad header line")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise _Invalid("bad length")
    block, end = head + 4, head + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise _Invalid("record doesn't end where its length says")
    payload, size = data[block:end], None
    if "http" in headers.get("content-type", ""):
        http = payload.find(b"\r\n\r\n")
        if http < 0:
            raise _Invalid("no HTTP headers")
        stated = re.search(rb"(?i)\r\ncontent-length: *(\d+)", payload[: http + 2])
        size = int(stated[1]) if stated else None
        payload = payload[http + 4 :]
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    revisit = headers.get("warc-type") == "revisit"
    if not revisit and digest and digest != base32_sha1(payload):
        raise _Invalid("payload digest differs")
    return end + 4, {
        "record_id": headers.get("warc-record-id"), "record_type": headers.get("warc-type"), "url": headers.get("warc-target-uri"),
        "refers_to": headers.get("warc-refers-to"), "payload_digest": digest or base32_sha1(payload),
        "payload_bytes": size if revisit else len(payload), "payload": None if revisit else payload,
    }


def _inflate(data: memoryview, start: int) -> tuple[int, bytes]:
    """End and content of the gzip member at a place."""
    unpack, out, place = zlib.decompressobj(31), [], start
    try:
        while not unpack.eof:
            if place >= len(data):
                raise _Invalid("member is cut off")
            part = data[place : place + 65536]
            out.append(unpack.decompress(part))
            place += len(part)
    except zlib.error as error:
        raise _Invalid(f"member: {error}") from None
    return place - len(unpack.unused_data), b"".join(out)


def _next_record(data: bytes, start: int) -> tuple[int, dict]:
    if data.startswith(b"\x1f\x8b", start):
        end, content = _inflate(memoryview(data), start)
        while True:
            try:
                stop, found = _parse(content, 0)
                break
            except _Invalid:  # a long record goes on in the next member, unless that starts one of its own
                if not data.startswith(b"\x1f\x8b", end) or len(content) % _MEMBER_BYTES:
                    raise
                end, more = _inflate(memoryview(data), end)
                content += more
        if stop != len(content):
            raise _Invalid("member holds more than its record")
        return end, found
    return _parse(data, start)


def salvage(data: bytes) -> Iterator[dict]:
    """The records of an archive in order, and gaps: rows with a problem instead of a record."""
    start, gap, problem = 0, None, None
    while start < len(data):
        try:
            end, found = _next_record(data, start)
        except _Invalid as error:
            if gap is None:
                gap, problem = start, str(error)
            places = [p for p in (data.find(b"\x1f\x8b\x08", start + 1), data.find(b"WARC/1.", start + 1)) if p >= 0]
            start = min(places, default=len(data))
            continue
        if gap is not None:
            yield {"start": gap, "length": start - gap, "problem": problem}
            gap = None
        yield {"start": start, "length": end - start, **found}
        start = end
    if gap is not None:
        yield {"start": gap, "length": len(data) - gap, "problem": problem}


def _read(batches):
    schema = pa.schema(
        [(name, pa.binary() if kind == "binary" else pa.int64() if kind == "long" else pa.string()) for name, kind in (c.split() for c in RECORDS.split(","))]
    )
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            rows, size = [], 0
            for row in salvage(content.as_py()):
                rows.append({"archive": path.as_py()} | row)
                size += len(row.get("payload") or b"")
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps (those with a problem) of all archives of a folder, see RECORDS."""
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read, RECORDS)
