"""WARC archives: writing with revisits and segments, and reassembly on reading.

Writing: equal payloads of at least ``min_revisit`` bytes are found by digest;
the row with the smallest id is the response, the others revisit it.  Each
record's HTTP block has its body in chunked transfer framing; a block longer
than ``segment_bytes`` is cut into a first record and continuations.  Records
go out through Spark's text writer (gzip), whose line separator is the blank
line that ends a record, so any store that Spark writes to will do; a file
holds ``records_per_file`` records of bounded size.

Reading: files are parsed record by record; a gzip file may have any number of
members, as those with one for each record.  Segments meet by origin id, are
put in order of segment number, checked for gaps and against the total length,
and joined; the chunked framing is then decoded and the digest compared.

Defined results: null html is an empty payload.  A null id counts as larger
than any; rows of equal id and payload are responses alike if the id is the
smallest; equal payloads whose ids are all null are responses.  ``status`` is ok,
gap, length, framing, digest, or header where a record's own numbers make no
sense, which costs that record only.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.blocks import shared_dir

CRLF = b"\r\n"
CHUNK = 1 << 14


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    parts = []
    for at in range(0, len(body), size):
        piece = body[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, CRLF]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(raw: bytes) -> bytes | None:
    """The body within chunked framing; None if the framing is broken."""
    parts, at = [], 0
    while True:
        end = raw.find(CRLF, at)
        if end < 0:
            return None
        try:
            size = int(raw[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if not size:
            return b"".join(parts) if raw[end + 2 : end + 4] == CRLF else None
        at = end + 2
        if raw[at + size : at + size + 2] != CRLF:
            return None
        parts.append(raw[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block


def records_of(name: str, page: int | None, body: bytes, digest: str, first: int | None, revisit: bool, segment: int) -> Iterator[bytes]:
    """The records of one page, without the blank lines that end them."""
    head = [("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Page-ID", "" if page is None else str(page)), ("WARC-Payload-Length", str(len(body)))]
    if revisit:
        yield _record([("WARC-Type", "revisit"), *head, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page-ID", str(first))], b"")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(body)
    if len(block) <= segment:
        yield _record([("WARC-Type", "response"), *head], block)
        return
    cuts = range(0, len(block), segment)
    for k, at in enumerate(cuts, 1):
        own = [("WARC-Type", "response"), *head] if k == 1 else [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{name}.{k}>"), ("WARC-Segment-Origin-ID", f"<urn:uuid:{name}>")]
        own.append(("WARC-Segment-Number", str(k)))
        if k == len(cuts):
            own.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record(own, block[at : at + segment])


def write_archives(pages: DataFrame, path: str, key: str = "page_id", text: str = "html", min_revisit: int = 100, segment_bytes: int = 1 << 16, records_per_file: int = 512) -> None:
    rows = pages.select(F.col(key).cast("long").alias("page"), F.coalesce(F.encode(text, "UTF-8"), F.lit(b"")).alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256))
    # digests meet without bodies; bodies meet the revisits by page, so no frequent payload is a key of theirs
    small = rows.where(F.octet_length("body") >= min_revisit).select("page", "digest")
    firsts = small.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    again = small.join(firsts, "digest").where(~F.col("page").eqNullSafe(F.col("first"))).select(F.col("page").alias("__page"), F.col("digest").alias("__digest"), "first").distinct()
    marked = rows.join(again, F.col("page").eqNullSafe(F.col("__page")) & (F.col("digest") == F.col("__digest")), "left")
    marked = marked.select("page", "body", "digest", "first", F.col("first").isNotNull().alias("revisit"), F.monotonically_increasing_id().alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = uuid.uuid4().hex[:12]
        for batch in batches:
            out, held = [], 0
            cols = [batch.column(i) for i in range(6)]
            for i in range(batch.num_rows):
                page, body, digest, first, again, row = (c[i].as_py() for c in cols)
                for x in records_of(f"{salt}-{row:016x}", page, body, digest, first, again, segment_bytes):
                    out.append(x)
                    held += len(x)
                if held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = marked.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _whole(text: str | None) -> int | None:
    """A number that is not below zero; None for anything else."""
    return int(text) if text and text.isascii() and text.isdigit() and len(text) < 19 else None


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and block of each record; no block where the headers do not tell its length, and then the next record is looked for."""
    at = 0
    while at < len(raw):
        end = raw.find(CRLF + CRLF, at)
        if end < 0:
            return
        lines = raw[at:end].decode("utf-8", "replace").split("\r\n")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = _whole(head.get("Content-Length"))
        if size is None:
            yield head, None
            after = raw.find(CRLF + CRLF + b"WARC/", end)
            at = after + 4 if after >= 0 else len(raw)
            continue
        yield head, raw[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _decoded(block: bytes, want: str) -> tuple[bytes | None, str]:
    head, _, body = block.partition(CRLF + CRLF)
    body = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if body is None:
        return None, "framing"
    return body, "ok" if hashlib.sha256(body).hexdigest() == want else "digest"


def _segment(head: dict[str, str], block: bytes | None) -> bool:
    """Whether a record is part of a segmented one."""
    return block is not None and _whole(head.get("WARC-Segment-Number")) is not None and ("WARC-Segment-Total-Length" not in head or _whole(head["WARC-Segment-Total-Length"]) is not None)


OUT = "page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, status string"


def _row(head: dict[str, str], block: bytes | None, status: str, payloads: bool) -> tuple:
    want = head.get("WARC-Payload-Digest", "").removeprefix("sha256:")
    name = head.get("WARC-Page-ID", "")
    page = (-1 if name[:1] == "-" else 1) * _whole(name.lstrip("-")) if _whole(name.lstrip("-")) is not None else None
    if block is None or name and page is None:
        status = "header"
    elif status == "ok" and head.get("Content-Length") and len(block) < (_whole(head["Content-Length"]) or 0) and "WARC-Segment-Number" not in head:
        status = "length"
    if head.get("WARC-Type") == "revisit":
        refers = head.get("WARC-Refers-To-Page-ID", "")
        number = _whole(refers.lstrip("-"))
        return page, None, _whole(head.get("WARC-Payload-Length")), want, "revisit", None if number is None else -number if refers[:1] == "-" else number, status
    body, status = _decoded(block, want) if status == "ok" else (None, status)
    if body is None:
        return page, None, None, None, "response", None, status
    return page, body if payloads else None, len(body), hashlib.sha256(body).hexdigest() if status != "ok" else want, "response", None, status


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])


def read_archives(spark, path: str, payloads: bool = True) -> DataFrame:
    """A row for each response and revisit of the archives at path; payloads only where asked for."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                rows = [_row(head, block, "ok" if "WARC-Segment-Number" not in head else "header", payloads) for head, block in parse(raw) if not _segment(head, block)]
                yield _batch(rows)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                rows = [
                    (head.get("WARC-Segment-Origin-ID") or head.get("WARC-Record-ID", ""), int(head["WARC-Segment-Number"]), int(head.get("WARC-Segment-Total-Length", -1)), "\n".join(f"{k}\t{v}" for k, v in head.items()) if head["WARC-Segment-Number"] == "1" else None, block)
                    for head, block in parse(raw)
                    if _segment(head, block)
                ]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["origin", "number", "total", "head", "block"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                parts = batch.column(0)[i].as_py()
                head = dict(x.split("\t", 1) for x in (parts[0]["head"] or "").split("\n") if x)
                block, total = b"".join(p["block"] for p in parts), max(p["total"] for p in parts)
                status = "gap" if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or total < 0 else "length" if total != len(block) else "ok"
                yield _batch([_row(head, block, status, payloads)])

    # one record's segments make up a group
    cut = files.mapInArrow(pieces, "origin string, number long, total long, head string, block binary")
    joined = cut.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("number", "total", "head", "block"))).alias("parts")).select("parts")
    return files.mapInArrow(whole, OUT).unionByName(joined.mapInArrow(join, OUT))


def op10_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status")


SQL10 = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to, 'ok' AS status FROM f
"""
