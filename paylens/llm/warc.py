"""WARC archives: writing pages as response and revisit records, and reading archives back.

Spark's text writer puts the records into gzip files in a folder that Spark can write to, so the archives
follow its commit protocol and any file system will do. A record whose block is longer than a segment is
cut into a response record and continuation records; the reader groups those by the identifier of the
record they continue, orders them by segment number, checks the total length and only then decodes the
chunked transfer framing.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, utf8_values

# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def cut(data: bytes, size: int) -> list[bytes]:
    """Pieces of at most size bytes, each whole UTF-8."""
    out, at = [], 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:end])
        at = end
    return out


def chunked(payload: bytes, size: int) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in cut(payload, size)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is not followed by a line end")
        out.append(body[at : at + size])
        at += size + 2


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return VERSION + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def records(identifier: str, url: str, payload: bytes, digest: str, page_id: str, refers_to: str | None, date: str, chunk_bytes: int, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page: a revisit without payload, or a response and its continuations."""
    own = [("WARC-Record-ID", f"<urn:page:{identifier}>"), ("WARC-Date", date), ("WARC-Target-URI", re.sub(r"[\r\n]", "%0A", url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", page_id)]
    if refers_to is not None:
        head = HTTP_HEAD.replace(b"Transfer-Encoding: chunked", b"Content-Length: %d" % len(payload))
        yield record("revisit", [*own, ("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page", refers_to)], head)
        return
    parts = cut(block := HTTP_HEAD + chunked(payload, chunk_bytes), segment_bytes)
    if len(parts) == 1:
        yield record("response", own, block)
        return
    yield record("response", [*own, ("WARC-Segment-Number", "1")], parts[0])
    for n, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(parts) else []
        yield record("continuation", [("WARC-Record-ID", f"<urn:page:{identifier}/{n}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", f"<urn:page:{identifier}>"), ("WARC-Segment-Number", str(n)), *last], part)


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 1000, chunk_bytes: int = 1024, segment_bytes: int = 4096, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 64_000_000, scratch: Scratch | None = None) -> None:
    """Write one WARC record (or a segmented one) per row of pages(page_id, url, html) to gzip files in path.

    Blocks beyond segment_bytes are cut into segments, so no record is much longer than that, and files end at
    as many records as make about file_bytes before compression.
    Of the rows with equal payloads of at least min_revisit_bytes, those with the largest page_id become
    response, the others revisit it; a null html is an empty payload, and rows that share the largest id are
    all response. A row without page_id is response if its payload is not found under an id. Which payloads
    occur twice is found on digests alone; the pages themselves are shuffled once, by page_id, only to learn
    which of them are revisits. A payload that thousands of pages share spreads by page_id, not by payload.
    """
    keyed = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    keyed = keyed.withColumn("digest", F.sha1("html"))
    sizes = keyed.filter(F.octet_length("html") >= min_revisit_bytes).select("page_id", "digest")
    shared = sizes.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null")
    # Written, so that both sides of the join have a plain shuffle and Spark can split a digest that many pages share.
    shared = (scratch or Scratch(pages.sparkSession)).table(shared.select("digest", "refers_to"), "shared")
    revisits = sizes.join(shared, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("revisit_id"), F.col("digest").alias("revisit_digest"), "refers_to").distinct()
    rows = keyed.join(revisits, F.col("page_id").eqNullSafe(F.col("revisit_id")) & (F.col("digest") == F.col("revisit_digest")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for page_id, url, html, digest, refers_to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8_values(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                n += 1
                out += records(f"{task}-{n}", url, html, digest, "" if page_id is None else str(page_id), None if refers_to is None else str(refers_to), date, chunk_bytes, segment_bytes)
            # The writer adds the last line feed.
            yield pa.RecordBatch.from_arrays([pa.array([x[:-1] for x in out], pa.binary()).cast(pa.string())], ["value"])

    rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "value string").write.option("maxRecordsPerFile", max(1, file_bytes // segment_bytes)).option("lineSep", "\n").option("compression", "gzip").text(path)


def inflate(content: bytes, size: int = 1 << 15) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, or of a plain file.

    A member may be one record: what the last piece holds beyond its end is read again for the next one, a
    piece at most.
    """
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    whole, at = memoryview(content), 0
    while at < len(whole):
        z = zlib.decompressobj(31)
        while not z.eof and at < len(whole):
            yield z.decompress(whole[at : at + size])
            at = min(at + size, len(whole))
        at -= len(z.unused_data)


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive: their fields (names in lower case) and blocks. Content-Length alone ends a block."""
    buffer, at, ended = b"", 0, False

    def more() -> bool:
        nonlocal buffer, at, ended
        got = next(pieces, None)
        if got is None:
            ended = True
            return False
        buffer, at = buffer[at:] + got, 0
        return True

    while True:
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if buffer[at:].strip():
                    raise ValueError("an archive ends inside a record")
                return
        head = buffer[at:end]
        if not head.startswith(b"WARC/"):
            raise ValueError("a record does not begin with its version")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
        length, at = int(fields["content-length"]), end + 4
        while len(buffer) - at < length + 4:
            if not more():
                raise ValueError("an archive ends inside a block")
        if buffer[at + length : at + length + 4] != b"\r\n\r\n":
            raise ValueError("a block is not followed by two line ends")
        yield fields, buffer[at : at + length]
        at += length + 4


def payload_of(block: bytes) -> bytes:
    """The HTTP body in a response block, freed from chunked framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


RECORD_SCHEMA = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary, origin string, segment int, total long, block binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Per page of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to and payload.

    Whole records are decoded where they are read. Segments alone are shuffled, by the identifier of the
    record they belong to; a record is put together once all its numbers from 1 on are there and their
    length is the total that the last one states, otherwise the job fails with the identifier. Files are read
    whole, one a task at a time, so their size (file_bytes) bounds the memory. payloads=False leaves
    the payload null, for callers that need digests only. Empty folders give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                size = 0
                for fields, block in parse(inflate(content)):
                    row = read_record(fields, block, path, payloads)
                    size += len(row[5] or b"") + len(row[9] or b"") + 200
                    rows.append(row)
                    if size > 8_000_000:
                        yield as_batch(rows)
                        rows, size = [], 0
                yield as_batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    found = files.mapInArrow(run, RECORD_SCHEMA)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    whole = found.filter("origin is null").select(*columns)
    parts = found.filter("origin is not null").groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("segment", "block", "page_id", "total"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for origin, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload = reassembled(origin, [(p["segment"], p["block"], p["total"]) for p in parts])
                rows.append((parts[0]["page_id"], len(payload), hashlib.sha1(payload).hexdigest(), "response", None, payload if payloads else None, None, None, None, None))
            yield as_batch(rows)

    return whole.unionByName(parts.mapInArrow(join, RECORD_SCHEMA).select(*columns))


def reassembled(origin: str, parts: list[tuple[int, bytes, int | None]]) -> bytes:
    """The payload of a segmented record from (number, block, total), in the order of the numbers."""
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)):
        raise ValueError(f"segments of {origin} are missing or doubled")
    block = b"".join(p[1] for p in parts)
    if parts[-1][2] != len(block):
        raise ValueError(f"segments of {origin} have {len(block)} bytes, not {parts[-1][2]}")
    return payload_of(block)


def read_record(fields: dict[str, str], block: bytes, path: str, payloads: bool) -> tuple:
    kind, page_id = fields["warc-type"], fields.get("x-page-id") or None
    if kind == "revisit":
        length = int(re.search(rb"(?i)content-length: *(\d+)", block)[1])
        return page_id, length, fields["warc-payload-digest"].removeprefix("sha1:"), kind, fields["x-refers-to-page"], None, None, None, None, None
    if kind == "response" and "warc-segment-number" not in fields:
        payload = payload_of(block)
        return page_id, len(payload), hashlib.sha1(payload).hexdigest(), kind, None, payload if payloads else None, None, None, None, None
    origin = fields["warc-record-id"] if kind == "response" else fields["warc-segment-origin-id"]
    total = fields.get("warc-segment-total-length")
    return page_id, None, None, kind, None, None, origin, int(fields["warc-segment-number"]), None if total is None else int(total), block


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def warc_round_trip(pages: DataFrame, path: str | None = None, payloads: bool = False, scratch: Scratch | None = None, **options) -> DataFrame:
    """Write pages to archives in path and read them back; options as in write_archives.

    By default the archives are scratch, in a new folder of the shared ones, which the caller's scratch
    discards once the result is written. page_id and refers_to come back in the type of pages.page_id. See
    write_archives and read_archives for nulls, ties and repeated rows; very long pages are cut into segments,
    an empty table gives an empty one, and columns other than page_id, url and html are not read.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    path = path or scratch.path("warc")
    kind = pages.schema["page_id"].dataType
    write_archives(pages, path, scratch=scratch, **options)
    back = read_archives(pages.sparkSession, path, payloads)
    return back.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
