"""WARC archives: deduplicating writer with segmented records, and a reader that reassembles them.

The writer puts each page into an HTTP response with chunked transfer framing, in a WARC ``response``
record; a page whose payload an earlier-chosen page already carries becomes a ``revisit``. Blocks longer than
``segment_bytes`` go into further ``continuation`` records. Archives are written by Spark's text writer, whose
line separator is the two line ends that close a WARC record, so they reach any store that Spark reaches.

The reader parses the archives record by record, groups continuations by the id of the record they
continue, orders them by segment number, verifies the total length, and decodes the chunked framing.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_columns, marked, scratch_root, skew_join, written

SEGMENT_BYTES = 32 * 1024
DEDUP_FROM = 1000
RECORDS_PER_FILE = 1000
CHUNK_BYTES = 4096
END = "\r\n\r\n"
_NAMESPACE = uuid.UUID("7d3c2f0a-52f1-4a86-9c59-0e4f8e0d6b11")
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def with_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", dedup_from: int = DEDUP_FROM) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, referred) for each row.

    Of rows with equal payloads of at least ``dedup_from`` bytes the one with the largest id is a response and the
    others revisit it. Null payloads are empty ones. Rows that tie on the largest id are all responses; a row
    with a null id revisits the largest id, or is a response where no id is known. ``referred``: the payload has one
    response that others revisit, whose record id follows from page and payload.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    url = F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    long = F.octet_length("payload") >= dedup_from
    rows = rows.withColumn("place", F.when(long, F.xxhash64("payload")))
    # One entry for each payload that repeats. Only pages that may have such a payload shuffle, found by a hash of it.
    each = rows.where(long).groupBy(F.sha1("payload").alias("payload_digest"), "page_id").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    carried = each.groupBy("payload_digest").agg(F.max("page_id").alias("carrier"), F.max_by("n", "page_id").alias("ties"), F.sum("n").alias("n"), F.min("place").alias("place")).where("n > 1")
    carried = written(carried.select("payload_digest", "carrier", "ties", "place"), "carried")
    every = marked(rows, carried.select("place"), "place")
    told = every.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    joined = skew_join(told.where("_maybe"), carried.drop("place"), ["payload_digest"], "left")
    revisits = F.col("carrier").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("carrier"))
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest"]
    repeated = joined.select(
        *columns, F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("carrier")).alias("refers_to"),
        (F.col("ties") == 1).alias("referred"),
    )
    single = told.where("NOT _maybe").select(*columns, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("boolean").alias("referred"))
    return single.unionByName(repeated)


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are passed over, a cut one is an error."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0].strip(), 16)
        if not size:
            return b"".join(out)
        part = body[line + 2 : line + 2 + size]
        if len(part) != size or body[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("cut chunk")
        out.append(part)
        at = line + 4 + size


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def _one_line(value) -> str | None:
    return None if value is None else "".join(str(value).split("\r")).replace("\n", "")


def record_id(page_id, digest: str) -> str:
    """The id of the record that revisits refer to."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {digest}')}>"


def records_of(page_id, url, payload: bytes, digest: str, record_type: str, refers_to, segment_bytes: int, referred: bool = False) -> list[bytes]:
    """The record of one page, and its continuations. ``referred``: revisits name the response by ``record_id``."""
    own = record_id(page_id, digest) if referred and record_type == "response" else f"<urn:uuid:{uuid.uuid4()}>"
    block = _HEAD + (chunked(payload) if record_type == "response" else b"")
    segments = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    common = [("WARC-Target-URI", _one_line(url)), ("WARC-Date", "2024-01-01T00:00:00Z")]
    first = [
        ("WARC-Type", record_type), ("WARC-Record-ID", own), *common, ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Vellum-Payload-Length", len(payload)),
        ("Vellum-Page-ID", page_id), ("Vellum-Refers-To-Page-ID", refers_to),
        ("WARC-Refers-To", record_id(refers_to, digest) if referred and refers_to is not None else None),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if record_type == "revisit" else None),
    ]
    if len(segments) == 1:
        return [_record(first, block)]
    out = [_record([*first, ("WARC-Segment-Number", 1)], segments[0])]
    for i, part in enumerate(segments[1:], 2):
        total = len(block) if i == len(segments) else None
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), *common, ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", i), ("WARC-Segment-Total-Length", total)], part))
    return out


def write_archives(rows: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write ``rows`` of ``with_revisits`` as gzipped WARC files under ``path``.

    A record holds at most ``segment_bytes`` of content and a file at most ``records_per_file`` records, which bounds
    what a reading task holds however long a page is. Spark's text writer makes one gzip member of a file.
    """

    def build(parts):
        for part in parts:
            records = []
            for row in zip(*(part[c] for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to", "referred"))):
                page_id, url, payload, digest, record_type, refers_to, referred = row
                records += records_of(page_id, url, payload, digest, record_type, refers_to, segment_bytes, bool(referred))
                if len(records) >= 500:
                    yield {"record": records}
                    records = []
            yield {"record": records}

    columns = rows.select("page_id", "url", "payload", "payload_digest", "record_type", "refers_to", "referred")
    records = map_columns(columns, build, {"record": pa.binary()}).select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path, compression="gzip")


def _inflated(data: bytes) -> tuple[bytes, bool]:
    """(content of all gzip members that can be read, whether that is all)."""
    plain = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            plain.append(member.decompress(data) + member.flush())
        except zlib.error:
            return b"".join(plain), False
        if not member.eof:
            return b"".join(plain), False
        data = member.unused_data
    return b"".join(plain), not data.strip(b"\0")


def _head(lines: list[str]) -> dict[str, str]:
    fields, name = {}, None
    for line in lines:
        if line[:1] in (" ", "\t") and name:  # a folded field
            fields[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


def parse_records(data: bytes):
    """(header fields in lower case, block, problem) of each record; gzip members are inflated one by one.

    Where a record can't be read (its head is no WARC head, or its block is cut short) there is a row
    with empty fields and the problem, and reading goes on at the next place where a record begins after two line ends.
    """
    whole = True
    if data[:2] == b"\x1f\x8b":
        data, whole = _inflated(data)
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        try:
            version, *lines = data[at:end].decode("utf-8").split("\r\n") if end >= 0 else [""]
            fields = _head(lines)
            size = int(fields["content-length"]) if version.startswith("WARC/") else -1
            int(fields.get("warc-segment-number", 1))
            good = 0 <= size <= len(data) - end - 4 and "warc-type" in fields
        except (KeyError, ValueError):
            good = False
        if good:
            yield fields, data[end + 4 : end + 4 + size], None
            at = end + 4 + size
        else:
            yield {}, b"", "damaged record"
            following = data.find(b"\r\n\r\nWARC/", at)
            at = len(data) if following < 0 else following + 4
    if not whole:
        yield {}, b"", "damaged archive"


_PAGE = {
    "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64(),
    "payload_digest": pa.string(), "segments": pa.int32(), "problem": pa.string(),
}
_SEGMENT = {"origin": pa.string(), "number": pa.int64(), "fields": pa.string(), "block": pa.binary()}


def _number(fields: dict, name: str) -> int | None:
    stated = fields.get(name, "")
    return int(stated) if stated.lstrip("-").isdecimal() else None


def _page(fields: dict, block: bytes, segments: int, problem: str | None) -> dict:
    """A page from its first record's fields and its whole block; ``problem`` says what didn't verify."""
    stated = fields.get("warc-payload-digest", "")
    digest = base64.b32decode(stated[5:]).hex() if re.fullmatch("sha1:[A-Z2-7]{32}", stated) else None
    payload, size = None, _number(fields, "vellum-payload-length")
    if fields.get("warc-type") in ("response", "resource") and problem is None:
        head, _, body = block.partition(b"\r\n\r\n") if fields["warc-type"] == "response" else (b"", b"", block)
        try:
            payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
        except ValueError:
            problem = "chunks"
        else:
            own, size = hashlib.sha1(payload).hexdigest(), len(payload)
            problem = "digest" if digest not in (None, own) else None
            digest = own
    return {"page_id": _number(fields, "vellum-page-id"), "url": fields.get("warc-target-uri"), "record_type": fields.get("warc-type"), "refers_to": _number(fields, "vellum-refers-to-page-id"),
            "payload": payload, "payload_bytes": size, "payload_digest": digest, "segments": segments, "problem": problem}


def _parsed(parts):
    """Rows of whole pages, and rows of segments (those with an origin), of each archive."""
    names = [*_PAGE, *_SEGMENT]
    for part in parts:
        for data in part["content"]:
            rows = []
            for fields, block, problem in parse_records(data):
                if "warc-segment-number" in fields:
                    origin = fields.get("warc-segment-origin-id", fields.get("warc-record-id"))
                    rows.append({"origin": origin, "number": int(fields["warc-segment-number"]), "fields": json.dumps(fields), "block": block})
                elif problem or fields["warc-type"] in ("response", "revisit", "resource"):
                    rows.append(_page(fields, block, 1, problem))
                if len(rows) >= 500:
                    yield {c: [r.get(c) for r in rows] for c in names}
                    rows = []
            yield {c: [r.get(c) for r in rows] for c in names}


def _reassembled(segments: pa.Table) -> pa.Table:
    """The page of one origin from its segments in the order of their numbers; a repeated number counts once."""
    rows = {}
    for row in segments.to_pylist():
        rows.setdefault(row["number"], row)
    numbers = sorted(rows)
    heads, block = [json.loads(rows[n]["fields"]) for n in numbers], b"".join(rows[n]["block"] for n in numbers)
    problem = None if numbers == list(range(1, len(numbers) + 1)) else "missing segment"
    if problem is None and heads[-1].get("warc-segment-total-length") != str(len(block)):
        problem = "total length"
    # Without the first segment nothing names the page.
    page = _page(heads[0] if numbers[0] == 1 else {}, block, len(numbers), problem)
    return pa.table({c: pa.array([page[c]], t) for c, t in _PAGE.items()})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each page in the archives under ``path``: its fields, payload (null for a revisit) and ``problem``.

    Every file is read, whatever its name, once: whole pages and segments are written to the shared folder. Segments are grouped
    by origin id, so a task holds the segments of one page at a time; records that are whole never shuffle.
    ``problem`` is null, or names what failed: missing segment, total length, chunks, digest, damaged record
    (which names no page) or damaged archive (the rest of a file can't be inflated). An empty folder gives an
    empty result. A file is held in memory whole.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    every = written(map_columns(files, _parsed, _PAGE | _SEGMENT), "records")
    segments, whole = every.where("origin IS NOT NULL").select(*_SEGMENT), every.where("origin IS NULL").select(*_PAGE)
    return whole.unionByName(segments.groupBy("origin").applyInArrow(_reassembled, whole.schema))


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = path or f"{scratch_root(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(with_revisits(pages), path)
    return read_archives(spark, path)
