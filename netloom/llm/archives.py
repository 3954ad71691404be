"""Legacy archive conversion: ARC records become equivalent WARC records.

``parse_arc`` reads version 1 and 2 files: the version block names the
version, its definition line gives the fields of the header lines, and each
record's declared length, not its content, says where the next begins.
``warc_record`` synthesises the record's identifier, timestamp, type and
digests; of records with equal payloads of at least ``LEAST_BYTES`` one is the
response and the others are revisits.

``write_archives`` makes ARC files in memory, of both versions and some megabytes
of records each, and converts them; ``convert_arc_files`` converts stored ones.
Archives are written by Spark's text writer (the line separator is the blank
lines that end a WARC record), so they go to any file system Spark can write,
and are read back by the binary reader, file by file; a file gets as many records
as make ``FILE_BYTES`` on the average.  Payloads aren't shuffled: the winners of
equal payloads are broadcast while they are at most ``FEW``, more are joined.

Defined cases: a null payload counts as empty, a null address as "unknown:";
white space in addresses is percent-encoded; ids are cast to long, so one that
isn't a number is an error (or null, without ANSI mode); a null page id has no
number and never wins among equal payloads; rows that repeat a winner's page id
are responses too, and other repeated rows are records of their own; a payload
may be as long as Spark's rows; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import durable, map_arrow, shared_path

LEAST_BYTES = 1000
FILE_BYTES = 64 << 20
#: Bytes of an ARC file made in memory, and winners (a digest and a number) that may be broadcast.
ARC_BYTES = 4 << 20
FEW = 500_000
END = "\r\n\r\n"
#: The definition lines of the two versions.
DEFINITIONS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


# --- ARC -----------------------------------------------------------------------------------------------------


def arc_version_block(version: int, name: str, date: str = "20240101000000") -> bytes:
    body = f"{version} 0 netloom\n{DEFINITIONS[version]}\n".encode()
    fields = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(fields[f] for f in DEFINITIONS[version].split()).encode() + b"\n" + body


def arc_record(version: int, url: str, payload: bytes, offset: int, name: str, date: str = "20240101000000") -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    fields = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Checksum": hashlib.md5(payload).hexdigest(), "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(head) + len(payload))}
    return b"\n" + " ".join(fields[f] for f in DEFINITIONS[version].split()).encode() + b"\n" + head + payload


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header fields, HTTP head, payload) of each record; raises ValueError on a damaged file."""
    line, _, rest = data.partition(b"\n")
    version_line = rest.split(b"\n", 1)[0].split()
    if not line.startswith(b"filedesc://") or not version_line or version_line[0] not in (b"1", b"2"):
        raise ValueError("no ARC version block")
    definition = rest.split(b"\n", 2)[1].decode().split()
    length = int(line.split()[-1])
    at = len(line) + 1 + length
    while at < len(data):
        if data[at : at + 1] != b"\n":
            raise ValueError(f"no record border at byte {at}")
        end = data.index(b"\n", at + 1)
        values = data[at + 1 : end].decode().split(" ")
        if len(values) != len(definition):
            raise ValueError(f"{len(values)} header fields at byte {at}, {len(definition)} declared")
        fields = dict(zip(definition, values, strict=True))
        length = int(fields["Archive-length"])
        block = data[end + 1 : end + 1 + length]
        if len(block) != length:
            raise ValueError(f"record at byte {at} is cut off")
        head, found, payload = block.partition(b"\r\n\r\n")
        if not (block.startswith(b"HTTP/") and found):
            head, payload = b"", block
        yield fields, head, payload
        at = end + 1 + length


# --- WARC ----------------------------------------------------------------------------------------------------


def record_id(number: int | None, digest: str, revisit: bool = False) -> str:
    """A UUID (version 8) that holds the page's number, so that references can be followed without an index."""
    value = (number or 0) & ((1 << 64) - 1)
    salt = int(digest[:12], 16) ^ revisit if number is not None else (1 << 48) - 1
    bits = (salt << 80) | (8 << 76) | ((value >> 52) << 64) | (2 << 62) | ((value & ((1 << 52) - 1)) << 10) | (1 if number is not None else 0)
    return f"<urn:uuid:{uuid.UUID(int=bits)}>"


def number_of(record: str) -> int | None:
    bits = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    value = (((bits >> 64) & 0xFFF) << 52) | ((bits >> 10) & ((1 << 52) - 1))
    return None if not bits & 1 else value - (1 << 64) if value >> 63 else value


def sha1_header(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def warc_record(fields: dict[str, str], head: bytes, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """The WARC record of a parsed ARC record, without the blank lines that end it."""
    url, _, number = fields["URL"].rpartition("#page-")
    page = int(number) if number else None
    digest, date = hashlib.sha1(payload).hexdigest(), fields["Archive-date"]
    block = head + b"\r\n\r\n" + (b"" if revisit else payload)
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page, digest, revisit)}",
        f"WARC-Date: {date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z", f"WARC-Target-URI: {url}", f"WARC-IP-Address: {fields['IP-address']}",
        f"WARC-Payload-Digest: {sha1_header(digest)}", f"WARC-Block-Digest: {sha1_header(hashlib.sha1(block).hexdigest())}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Truncated-Payload-Length: {len(payload)}"]
    lines.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        start = end + 4
        stop = start + int(headers["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"no record end at byte {stop}")
        yield headers, data[start:stop]
        at = stop + 4


# --- Spark ---------------------------------------------------------------------------------------------------


def _arc_url(url: str | None, page: int | None) -> str:
    return urllib.parse.quote(url or "unknown:", safe=":/?#[]@!$&'()*+,;=%-._~") + f"#page-{'' if page is None else page}"


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, html, revisit, refers_to) become WARC records by way of ARC files of both versions."""
    k = 0
    for batch in batches:
        row = 0
        while row < batch.num_rows:
            version, name, marks = 1 + k % 2, f"pages-{k}.arc", []
            arc = bytearray(arc_version_block(version, name))
            while row < batch.num_rows and len(arc) < ARC_BYTES:
                page, url, html, revisit, refers = (c[row].as_py() for c in batch.columns)
                marks.append((refers, revisit))
                arc += arc_record(version, _arc_url(url, page), (html or "").encode(), len(arc), name)
                row += 1
            out = [warc_record(*parsed, *mark).decode() for parsed, mark in zip(parse_arc(bytes(arc)), marks, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
            k += 1


def _convert_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            data = batch.column(0)[row].as_py()
            for fields, head, payload in parse_arc(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                yield pa.RecordBatch.from_arrays([pa.array([warc_record(fields, head, payload).decode("utf-8", "replace")], pa.string())], names=["value"])


def convert_arc_files(spark, arc_path: str, warc_path: str, records_per_file: int = 5000) -> None:
    """WARC files of the records of all ARC files (plain or gzip) under a path; every record is a response, text in UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(arc_path).select("content")
    _write(map_arrow(files, _convert_files, "value string"), warc_path, records_per_file)


def _write(records: DataFrame, path: str, records_per_file: int) -> None:
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            data = batch.column(0)[row].as_py()
            rows = []
            for headers, block in parse_warc(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                payload = block.partition(b"\r\n\r\n")[2]
                revisit = headers["WARC-Type"] == "revisit"
                if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"digest of {headers['WARC-Record-ID']} differs from its payload")
                rows.append((number_of(headers["WARC-Record-ID"]), int(headers["WARC-Truncated-Payload-Length"]) if revisit else len(payload), digest, headers["WARC-Type"], number_of(headers["WARC-Refers-To"]) if revisit else None))
            kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """WARC files (gzip) of all pages."""
    html = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).alias("size"))
    # partial aggregation: a task sends one row for each digest, and pages' text stays where it is
    groups = durable(rows.groupBy("digest", (F.col("size") >= LEAST_BYTES).alias("long")).agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count(F.when(F.expr("long AND n > 1"), 1)).alias("winners")).first()
    winners = groups.filter("long AND n > 1").select(F.col("digest").alias("_digest"), "winner")
    winners = F.broadcast(winners) if total.winners <= FEW else winners
    marked = rows.join(winners, (F.col("digest") == F.col("_digest")) & (F.col("size") >= LEAST_BYTES), "left")
    revisit = F.col("_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    records = map_arrow(marked.select("page_id", "url", "html", revisit.alias("revisit"), "winner"), _convert, "value string")
    _write(records, path, max(1, int(FILE_BYTES // (1000 + (total.bytes or 0) / max(total.n or 0, 1)))))


def read_archives(spark, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return map_arrow(files.select("content"), _read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)

