"""WARC archives: written with segmentation and chunked framing, read back by reassembly.

A page becomes one HTTP response whose body is framed in chunks. A block longer than
`segment_bytes` is cut: the first part is a response record with WARC-Segment-Number 1, the
others are continuation records that name the first by WARC-Segment-Origin-ID; the last one
carries WARC-Segment-Total-Length. Of pages with equal payloads of at least `least` bytes,
the one with the smallest page_id is a response and the others are revisit records without
a payload. Archives are gzip files of whole records, written by Spark next to each other.

Reading parses records by their lengths, groups the parts of cut records by origin, orders
them by segment number, verifies the total length, takes the chunk framing off and verifies
the payload digest. A record that fails is an error, not a missing row. Revisits find their
payload's length through the page they refer to.

Null html is an empty payload. A null page_id never is the smallest while another exists; a
group without any page_id consists of responses. Repeated rows are records of their own, and
all rows that share the smallest page_id are responses.
"""
from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import stage_folder

LEAST = 100
CHUNK = 8192
EOL = b"\r\n"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[i:i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    parts, at = [], 0
    while True:
        end = body.index(EOL, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        parts.append(body[at:at + size])
        if len(parts[-1]) != size or body[at + size:at + size + 2] != EOL:
            raise ValueError("broken chunk framing")
        at += size + 2


def http_block(payload: bytes) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    return head + chunked(payload)


def http_payload(block: bytes) -> bytes:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("HTTP head without an end")
    fields = dict(line.lower().split(b":", 1) for line in head.split(EOL)[1:])
    return unchunked(body) if fields.get(b"transfer-encoding", b"").strip() == b"chunked" else body


def record(fields: dict[str, object], block: bytes) -> bytes:
    """A record without the two line ends behind it."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def records(archive: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of an open archive."""
    while True:
        line = archive.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no record where one should begin")
        fields = {}
        while (line := archive.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = archive.read(size)
        if len(block) != size:
            raise ValueError("record cut short")
        yield fields, block


def _clean(url: str | None) -> str:
    return "".join(c for c in url or "" if c > " ") or "about:blank"


def kinds(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, digest and refers_to (null for responses) of every page."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html"))
    first = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("m"))
    first = first.where("m > 1 and first is not null").select("digest", "first")
    rows = rows.join(first, "digest", "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    refers = F.when(other, F.col("first"))
    return rows.select("page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "digest", refers.alias("refers_to"))


def write(pages: DataFrame, path: str, least: int = LEAST, segment_bytes: int = 32 << 10, records_per_file: int = 5000) -> None:
    """Write the archives of `pages` (page_id, url, html) to the folder `path`."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            size = 0
            for page, url, html, digest, refers in zip(*(batch.column(n).to_pylist() for n in ("page_id", "url", "html", "digest", "refers_to"))):
                own = {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "1970-01-01T00:00:00Z"}
                page_fields = {"WARC-Target-URI": _clean(url), "X-Page-ID": page, "WARC-Payload-Digest": f"sha256:{digest}"}
                if refers is not None:
                    out.append(record({"WARC-Type": "revisit", **own, **page_fields, "X-Refers-To-Page-ID": refers,
                                       "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}, b""))
                    continue
                block = http_block(html.encode())
                parts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
                for i, part in enumerate(parts, 1):
                    if i == 1:
                        fields = {"WARC-Type": "response", **own, **page_fields, "WARC-Segment-Number": 1 if len(parts) > 1 else None}
                    else:
                        fields = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": own["WARC-Date"],
                                  "WARC-Target-URI": _clean(url), "WARC-Segment-Origin-ID": own["WARC-Record-ID"], "WARC-Segment-Number": i,
                                  "WARC-Segment-Total-Length": len(block) if i == len(parts) else None}
                    out.append(record({"Content-Type": "application/http; msgtype=response", **fields}, part))
                    size += len(out[-1])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    # The text writer writes a string's bytes as they are; a record ends with two line ends.
    rows = kinds(pages, least).mapInArrow(make, "record binary").select(F.col("record").cast("string"))
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


_WHOLE = pa.schema([("page_id", pa.int64()), ("digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
_PART = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()), ("digest", pa.string()), ("block", pa.binary())])
_DDL = "page_id long, digest string, refers_to long, payload binary"


def _checked(block: bytes, digest: str) -> bytes:
    payload = http_payload(block)
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("payload digest differs")
    return payload


def _number(text: str | None) -> int | None:
    return None if text in (None, "None") else int(text)


def _parse(archives: DataFrame, cut: bool) -> DataFrame:
    """Whole records, or the parts of cut ones."""
    schema = _PART if cut else _WHOLE

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for f, block in records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())))):
                    number, digest = f.get("warc-segment-number"), f.get("warc-payload-digest", "").removeprefix("sha256:")
                    page, refers = _number(f.get("x-page-id")), _number(f.get("x-refers-to-page-id"))
                    if cut != (number is not None):
                        continue
                    if cut:
                        rows.append((f.get("warc-segment-origin-id", f["warc-record-id"]), int(number), _number(f.get("warc-segment-total-length")), page, digest or None, block))
                    elif f["warc-type"] == "revisit":
                        rows.append((page, digest, refers, None))
                    elif f["warc-type"] == "response":
                        rows.append((page, digest, None, _checked(block, digest)))
                    size += len(block)
                    if size > 8 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    ddl = "origin string, number int, total long, page_id long, digest string, block binary" if cut else _DDL
    return archives.mapInArrow(parse, ddl)


def read(spark, path: str) -> DataFrame:
    """page_id, digest, refers_to and payload (null for revisits) of every page in the archives under `path`."""
    archives = spark.read.format("binaryFile").load(path).select("content")
    parts = _parse(archives, True).groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"),
        F.max("page_id").alias("page_id"), F.max("digest").alias("digest"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, total, page, digest in zip(batch.column("parts"), *(batch.column(n).to_pylist() for n in ("total", "page_id", "digest"))):
                own = own.as_py()
                block = b"".join(p["block"] for p in own)
                if [p["number"] for p in own] != list(range(1, len(own) + 1)) or len(block) != total:
                    raise ValueError("segments missing or of another total length")
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((page, digest, None, _checked(block, digest)), _WHOLE.types)], schema=_WHOLE)

    return _parse(archives, False).union(parts.mapInArrow(join, _DDL))


def round_trip(pages: DataFrame, path: str | None = None, **how) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read back from the archives."""
    spark = pages.sparkSession
    path = path or f"{stage_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, **how)
    rows = read(spark, path).select("page_id", "digest", "refers_to", F.octet_length("payload").cast("long").alias("size"))
    sizes = rows.where("refers_to is null").select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), F.col("size").alias("_n")).distinct()
    meet = (F.col("refers_to") == F.col("_p")) & (F.col("digest") == F.col("_d"))
    return rows.join(sizes, meet, "left").select(
        "page_id", F.coalesce("size", "_n").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit")).alias("record_type"), "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 100 OR page_id IS NOT DISTINCT FROM first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 100 OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM m
"""
