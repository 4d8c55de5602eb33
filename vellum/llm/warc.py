"""WARC archives: writing pages as gzip members, and a splittable reader of them.

Each record is a gzip member of its own, so an archive can be read from any member on. The reader deals out byte
ranges, not files: a task scans its range for the gzip magic, takes a hit for a member only if what it inflates to
begins with a whole WARC header, and owns the records that start inside its range, reading on past the range's
end for the last of them. A hit inside another member's compressed bytes doesn't inflate to such a header.

Writing goes through Spark's own text writer, whose committer survives lost executors and knows every store: the
writer puts a row's bytes out as they are, followed by its separator. The separator is the zero byte in which each
row ends anyway (the top byte of the member's length field; where that isn't zero, an empty member follows).
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

from vellum.llm.common import join_bounded, new_path, staged

MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03" + b"\x00" * 9
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string, payload binary"


def gzip_member(data: bytes) -> bytes:
    coder = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = coder.compress(data) + coder.flush()
    return out if out[-1] == 0 else out + EMPTY_MEMBER


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit carries the HTTP head of the whole response, with its length, but no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    lines.append(f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>")
    if url is not None:
        # a line feed in a url would end the header
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def with_digest(pages: DataFrame) -> DataFrame:
    """page_id, url and payload, with its length and SHA-1."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    return pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")}
    )


def marked(pages: DataFrame, least: int) -> DataFrame:
    """Pages with first_id, the page whose record keeps an equal payload; null where the page keeps its own."""
    pages = with_digest(pages)
    keys = ["sha1", "payload_bytes"]
    kept = pages.where(F.col("payload_bytes") >= least).groupBy(*keys).agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
    # digests alone are shuffled; payloads stay where they are, unless very many digests repeat
    kept = staged(kept.where("n > 1").drop("n"), "digests")
    joined = join_bounded(pages, kept, keys, "left")
    return joined.withColumn("first_id", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")))


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """A WARC record per page below path.

    pages: page_id, url and html, all of which may be null (html: empty payload). Of records with equal payloads
    of at least ``least`` bytes, that with the largest page_id is a response, the others revisit it; rows that
    repeat the largest page_id are all responses, and so is everything if all of the page_ids are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            out = [gzip_member(record(i, url, payload, first, first is not None))[:-1] for i, url, payload, first in rows]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    members = marked(pages, least).select("page_id", "url", "payload", "first_id").mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def headers(block: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in block.split(b"\r\n")[1:])}


def inflate(read, at: int, until: bytes | None, chunk: int = 1 << 16) -> tuple[bytes, int] | None:
    """What the member at a place inflates to, and where it ends; with until, stop once that was seen. None: no member."""
    coder, out, place = zlib.decompressobj(31), [], at
    tail = bytearray()
    while not coder.eof:
        data = read(place, chunk)
        if not data:
            return None
        place += len(data)
        try:
            out.append(coder.decompress(data))
        except zlib.error:
            return None
        if until:
            fresh = max(0, len(tail) - len(until) + 1)
            tail += out.pop()
            if tail.find(until, fresh) >= 0:
                return bytes(tail), place
            if not tail.startswith(b"WARC/"[: len(tail)]):
                return None
    return bytes(tail) if until else b"".join(out), place - len(coder.unused_data)


def page_of(value: str | None) -> int | None:
    """The page of a record id that was written here; other ids name no page."""
    own = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(own[1]) if own else None


def number(value: bytes | None) -> int | None:
    return int(value) if value and value.isdigit() else None


def parse(data: bytes) -> tuple | None:
    """A row of RECORDS, of whichever kind; None if this is no whole WARC record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        return None
    fields = headers(head)
    size = number(fields.get(b"content-length"))
    if size is None or size > len(rest):
        return None
    text = {k: v.decode(errors="replace") for k, v in fields.items()}
    kind, own = text.get(b"warc-type", "").lower(), text.get(b"warc-record-id")
    http, payload = b"", rest[:size]
    if text.get(b"content-type", "").startswith("application/http") or payload.startswith(b"HTTP/"):
        http, _, payload = payload.partition(b"\r\n\r\n")
    url = text.get(b"warc-target-uri")
    if url is not None and re.match("<urn:page:", own or ""):
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    revisit = kind == "revisit"
    digest = text.get(b"warc-payload-digest")
    if digest is None and not revisit:
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    n = number(headers(http).get(b"content-length")) if revisit else len(payload)
    first = text.get(b"warc-refers-to") if revisit else None
    return page_of(own), url, n, digest and digest.removeprefix("sha1:"), kind, page_of(first), own, first, None if revisit else payload


def records_from(read, start: int, end: int, window: int = 1 << 20) -> Iterator[tuple]:
    """Records whose members start in [start, end); read(at, n) gives up to n bytes of the archive."""
    at = start
    while at < end:
        data = read(at, min(window, end - at) + len(MAGIC) - 1)
        hit = data.find(MAGIC)
        if hit < 0:
            at += window
            continue
        if at + hit >= end:
            return
        at += hit
        whole = inflate(read, at, b"\r\n\r\n") and inflate(read, at, None)
        row = parse(whole[0]) if whole else None
        if row:
            if row[4] in ("response", "revisit"):
                yield row
            at = whole[1]
        else:
            at += 1


def read(spark: SparkSession, path: str, split_bytes: int = 8 << 20) -> DataFrame:
    """The response and revisit records of the archives below path, one row each; payload is null for revisits.

    Archives may be others' too: their records' ids stand in record_id and refers_to_id, page_id and refers_to are null
    unless written here, a missing digest of a response is computed, a revisit without an HTTP length has null
    payload_bytes, and records of other types (warcinfo, request, metadata, ...) are passed over.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long")))
    splits = files.where("length > 0").select("path", "length", starts.alias("start"))
    # ranges are dealt evenly, several a task, so that a long archive is read by many
    splits = splits.repartitionByRange(max(1, spark.sparkContext.defaultParallelism * 2), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path_, length, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, place = fs.FileSystem.from_uri(path_.replace("file:///", "file:/").replace("file:/", "file:///"))
                with store.open_input_file(place) as file:
                    rows: list[tuple] = []
                    held = 0
                    for row in records_from(lambda at, n, f=file: f.read_at(n, at), start, min(start + split_bytes, length)):
                        rows.append(row)
                        held += len(row[-1] or b"")
                        if held > 8 << 20:
                            yield as_batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in RECORDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return splits.mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages written as an archive in the shared folder, and what the reader finds there."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, least)
    return read(pages.sparkSession, path).drop("url", "payload", "record_id", "refers_to_id")


#: Base 32 of SHA-1: each five hex digits are twenty bits, four characters.
ORACLE_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h FROM p
), k AS (
  SELECT h, payload_bytes, max(page_id) AS last_id FROM d GROUP BY ALL
), c AS (
  SELECT page_id, d.payload_bytes, d.h, last_id,
    list_transform(range(0, 8), lambda i: ('0x' || substr(d.h, CAST(1 + 5 * i AS INTEGER), 5))::INTEGER) AS v
  FROM d JOIN k ON d.h = k.h AND d.payload_bytes = k.payload_bytes
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(v, lambda x:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (x >> 15) % 32, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (x >> 10) % 32, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (x >> 5) % 32, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + x % 32, 1)), '') AS payload_digest,
  CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last_id THEN last_id END AS refers_to
FROM c
"""
