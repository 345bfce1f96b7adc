"""WARC archives: a writer in DataFrame operations, and a reader that salvages what it can.

Writing: a record is a gzip member of its own (or plain), and Spark's text writer puts the records into
files, with the bytes that end each of them as line separator, so archives go to any file system that
Spark can write, a bounded number of records to a file. Equal payloads become one response and revisits that refer to it.

Reading: files come as (path, content), each of at most 2 GB, which is what a row can hold. The reader walks
the gzip members, or the plain bytes, record by record; members are unpacked piece by piece and their records
parsed as they come, so that one member may hold a whole archive. After a failed check (no version line, bad
headers, a block that the length does not fit, a missing record end, a payload that its digest does not fit,
a broken member) it looks for the next member's magic or version line at which a whole record parses, goes on
there, and logs the bytes between as a quarantined gap. Of a member that breaks, the records before the break
stay, the last of them only if its payload's digest vouches for it. Work is linear in the archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
RECORD_END = b"\r\n\r\n"
GZIP_MAGIC = b"\x1f\x8b\x08"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1, from 20 bits of the hex digest at a time."""
    digest, out = F.sha1(data), []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*out)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """One column, ``record``: each page's WARC record without the closing empty lines.

    Of pages with equal payloads of at least min_revisit_bytes bytes, that with the largest id is the
    response and the others are revisits; smaller payloads are responses all. A null payload is empty. A
    null id never is the largest; a group of null ids alone has responses only. Rows that repeat the
    largest id are responses too. Payloads are equal when SHA-1, length and a 64-bit hash agree. Line ends in a
    URL are percent-encoded; a null URL is left out. An empty table has no records; other columns of the input,
    whatever their names, are not looked at.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("_body"))
    rows = rows.withColumns({"_bytes": F.octet_length("_body"), "_sha": F.unhex(F.sha1("_body")), "_more": F.xxhash64("_body")})
    groups = (
        rows.filter(F.col("_bytes") >= min_revisit_bytes)
        .groupBy(F.col("_sha").alias("_gsha"), F.col("_bytes").alias("_gbytes"), F.col("_more").alias("_gmore"))
        .agg(F.max("_id").alias("_refers"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1 AND _refers IS NOT NULL")
    )
    both = rows.join(groups, (F.col("_sha") == F.col("_gsha")) & (F.col("_bytes") == F.col("_gbytes")) & (F.col("_more") == F.col("_gmore")), "left")
    revisit = F.col("_refers").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_refers"))
    name = lambda x: F.concat(F.lit("<urn:page:"), x.cast("string"), F.lit(">"))
    own = F.coalesce(name(F.col("_id")), F.concat(F.lit("<urn:page:null-"), F.hex("_sha"), F.lit(">")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, F.encode(http, "utf-8")).otherwise(F.concat(F.encode(http, "utf-8"), F.col("_body")))
    url = F.regexp_replace(F.regexp_replace("_url", "\r", "%0D"), "\n", "%0A")
    digest = base32_sha1(F.col("_body"))
    lines = [
        F.lit(VERSION.decode()),
        F.when(revisit, F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")),
        F.concat(F.lit("WARC-Record-ID: "), own),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("_bytes").cast("string")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("_refers")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    head = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2))
    return both.select(F.concat(F.encode(head, "utf-8"), block).cast("string").alias("record"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record as a gzip member without its last byte, which is 0: the top byte of the length, or that
    of an empty member put behind a record of 16 MiB or more."""
    for batch in batches:
        out = []
        for record in batch.column(0):
            data = record.as_buffer().to_pybytes() + RECORD_END
            parts = [data] if len(data) % (1 << 32) < 1 << 24 else [data, b""]
            packed = b""
            for part in parts:
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                packed += pack.compress(part) + pack.flush()
            out.append(packed[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def write(pages: DataFrame, path: str, records_per_file: int = 2000, compress: bool = True, **settings) -> None:
    """Writes archives of at most records_per_file records each under path, a gzip member to a record, or
    plain if compress is false. The text writer ends each record with the bytes that were left off."""
    rows, end = records(pages, **settings), RECORD_END.decode()
    if compress:
        rows, end = rows.select(F.col("record").cast("binary")).mapInArrow(_members, "member binary").select(F.col("member").cast("string")), "\0"
    rows.write.option("lineSep", end).option("maxRecordsPerFile", records_per_file).text(path)


@dataclass
class Record:
    """A record; ``checked``: its payload's digest was declared and fits."""

    start: int
    end: int
    headers: dict[str, str]
    payload: bytes
    checked: bool = False


@dataclass
class Gap:
    start: int
    end: int
    reason: str


class Broken(ValueError):
    """A check that failed."""


class Short(Broken):
    """A check that failed for want of bytes."""


_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_NEXT = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
VERSION_BYTES = 10
LONGEST_HEAD = 1 << 20
#: Bytes of a member that are read, and unpacked, at a time.
PIECE = 1 << 16


def parse(data: bytes | bytearray, at: int) -> Record:
    """The record that begins at ``at``, every check passed."""
    version = _VERSION_LINE.match(data, at)
    if not version:
        raise (Short if len(data) - at < VERSION_BYTES else Broken)("no version line")
    head_end = data.find(b"\r\n\r\n", version.end() - 2, version.end() + LONGEST_HEAD)
    if head_end < 0:
        raise (Short if len(data) < version.end() + LONGEST_HEAD else Broken)("headers do not end")
    headers = {}
    for line in data[version.end() : head_end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise Broken("bad header line")
        headers[name.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"[0-9]{1,15}", headers.get("content-length", "")):
        raise Broken("no content length")
    block_end = head_end + 4 + int(headers["content-length"])
    if data[block_end : block_end + 4] != RECORD_END:
        raise (Short if len(data) < block_end + 4 else Broken)("no record end where the length says")
    block = bytes(memoryview(data)[head_end + 4 : block_end])
    payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
    declared = headers.get("warc-payload-digest", "")
    checked = headers.get("warc-type") != "revisit" and declared.startswith("sha1:")
    if checked and declared[5:] != sha1(payload):
        raise Broken("payload digest")
    return Record(at, block_end + 4, headers, payload, checked)


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _unpacked(data: bytes, at: int) -> Iterator[tuple[bytes, int, bool]]:
    """The gzip member at ``at`` in pieces: unpacked bytes, where the bytes read for them end, and whether the
    member ends there."""
    view, unpack, fed = memoryview(data), zlib.decompressobj(31), at
    while not unpack.eof:
        piece = unpack.unconsumed_tail
        if not piece:
            piece = view[fed : fed + PIECE]
            fed += len(piece)
        try:
            out = unpack.decompress(piece, PIECE)
        except zlib.error as e:
            raise Broken("broken member") from e
        if not out and not len(piece) and not unpack.eof:
            raise Broken("member is cut off")
        yield out, fed - len(unpack.unused_data if unpack.eof else unpack.unconsumed_tail), unpack.eof  # at the end both hold the rest


def _member(data: bytes, at: int) -> Iterator[Record | Gap | int]:
    """Records and gaps of the member at ``at``, and in the end where it ends. Their offsets are those of the
    archive's bytes that had been read; they follow each other without a hole."""
    buffer, place, reached, last, reason = bytearray(), 0, at, None, ""
    try:
        for out, upto, ended in _unpacked(data, at):
            buffer += out
            while place < len(buffer):
                try:
                    record = parse(buffer, place)
                except Broken as e:
                    if isinstance(e, Short) and not ended:
                        break
                    if reached == at and last is None and not reason and not _VERSION_LINE.match(buffer):
                        raise Broken("member without a record") from e
                    reason = reason or str(e)
                    following = _VERSION_LINE.search(buffer, place + 1)
                    place = following.start() if following else max(place + 1, len(buffer) - VERSION_BYTES + 1)
                    if not following:
                        if ended:
                            place = len(buffer)
                        break
                    continue
                if last:
                    yield last
                    reached = last.end
                if reason:
                    yield Gap(reached, upto, f"in member: {reason}")
                    reached, reason = upto, ""
                last = Record(reached, upto, record.headers, record.payload, record.checked)
                place = record.end
            if place > PIECE:
                del buffer[:place]
                place = 0
    except Broken:
        if last and last.checked:
            yield last
        raise
    if last:
        last.end = last.end if reason else upto
        yield last
    if reason:
        yield Gap(last.end if last else reached, upto, f"in member: {reason}")
    yield upto


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records and gaps of an archive in order; offsets count its bytes, and together they cover every byte
    (but for members that hold nothing)."""
    at, bad, reason = 0, -1, ""
    while at < len(data):
        end = at
        try:
            for x in _member(data, at) if data.startswith(GZIP_MAGIC, at) else [parse(data, at)]:
                if bad >= 0:
                    yield Gap(bad, at, reason)
                bad = -1
                if isinstance(x, int):
                    end = x
                else:
                    yield x
                    end = x.end
        except Broken as e:
            if bad < 0:
                bad, reason = end, str(e)
            following = _NEXT.search(data, max(at + 1, end))
            at = following.start() if following else len(data)
            continue
        at = end
    if bad >= 0:
        yield Gap(bad, len(data), reason)


#: A record's row; a gap's has kind "gap", its bytes and the reason.
COLUMNS = "archive string, kind string, start bigint, end bigint, record_id string, target_uri string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, reason string"


def read(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """Rows of COLUMNS (and ``payload``) for files, rows of (path, content) as the binaryFile source has.

    Null or empty contents have no rows, an empty table none; rows that repeat a path are read each on their
    own; contents of up to 2 GB are read whole, long records too. Bytes and digest of a response are measured on its payload, those
    of a revisit are what its headers say of the full payload (null if they say nothing)."""
    names = [c.split()[0] for c in COLUMNS.split(", ")] + ["payload"] * with_payload

    def row(path: str, x: Record | Gap) -> tuple:
        if isinstance(x, Gap):
            return (path, "gap", x.start, x.end, None, None, None, None, None, None, x.reason, None)
        h, kind = x.headers, x.headers.get("warc-type")
        if kind == "revisit":
            declared, length = h.get("warc-payload-digest", ""), h.get("warc-payload-length", "")
            size, digest = int(length) if length.isdigit() else None, declared[5:] if declared.startswith("sha1:") else None
        else:
            size, digest = len(x.payload), sha1(x.payload)
        return (path, "record", x.start, x.end, h.get("warc-record-id"), h.get("warc-target-uri"), kind, h.get("warc-refers-to"), size, digest, None, x.payload)

    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows: list[tuple] = []
                for x in salvage(content.as_py() or b""):
                    rows.append(row(path.as_py(), x))
                    if len(rows) >= 1000:
                        yield packed(rows)
                        rows = []
                if rows:
                    yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))[: len(names)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names)

    return files.select("path", "content").mapInArrow(run, COLUMNS + ", payload binary" * with_payload)


def round_trip(pages: DataFrame, path: str, **settings) -> DataFrame:
    """Writes pages under path, reads the archives back: page_id, payload_bytes, payload_digest,
    record_type, refers_to of every record. Nulls, empty and long payloads, ties and repeated rows are as in
    records(); an empty table gives an empty result with the same columns."""
    write(pages, path, **settings)
    files = pages.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    number = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1), F.lit("")).cast("bigint")
    return (
        read(files)
        .filter("kind = 'record'")
        .select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "target_uri", "archive", "start", "end")
    )
