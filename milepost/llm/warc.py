"""WARC archives: write pages as records, read them back.

Writing: pages whose payloads are equal share one ``response`` record (the
smallest page id); the others become ``revisit`` records that refer to it.  A
payload travels in chunked transfer framing, and a block longer than
``segment_bytes`` is cut into a first record and ``continuation`` records.
The records are written with Spark's text writer, whose line separator is the
record separator of the format (CR LF CR LF), so any file system that Spark
knows will do.

The files are gzipped as a whole.

Reading: files (plain, or gzipped as a whole or record by record) are parsed
record by record by their Content-Length.  Segments
are grouped by origin identifier, ordered by segment number, checked against
the total length, joined, and the chunked framing is decoded.  A revisit takes
its payload's length from the response of the same digest.

Defined results: a null payload is empty; a null url is an empty target; page
ids may be null or repeat (of equal rows one is the response); a payload may
be of any length and hold any text, record separators included; an empty table
gives no rows; other columns are ignored.  A record whose segments are missing,
out of number or of another total length raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import scratch_path, shared_table

SEP = b"\r\n"
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def cut(data: bytes, size: int) -> list[bytes]:
    """Slices of about ``size`` bytes that never split a UTF-8 character."""
    parts, at = [], 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        parts.append(data[at:end])
        at = end
    return parts


def chunked(data: bytes, size: int) -> bytes:
    """Chunked transfer framing: hexadecimal length, CR LF, data, CR LF ... 0."""
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in cut(data, size)) + b"0\r\n\r\n"


def dechunk(body: bytes) -> bytes:
    """The data in chunked framing; chunk extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        end = body.find(SEP, at)
        if end < 0:
            raise ValueError("chunked framing: no end of a chunk's length")
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(parts)
        parts.append(body[at : at + n])
        if len(parts[-1]) != n or body[at + n : at + n + 2] != SEP:
            raise ValueError("chunked framing: a chunk is shorter than its length")
        at += n + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(SEP + SEP)
    return dechunk(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


def _record(headers: list[tuple[str, object]], block: bytes) -> str:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines) + block.decode()


def page_records(page: str, head: str, is_head: bool, url: str, payload: bytes, segment_bytes: int, chunk_bytes: int) -> Iterator[str]:
    """The records of one page, each without its closing separator."""
    digest = f"sha1:{base32_sha1(payload)}"
    named: list[tuple[str, object]] = [("WARC-Record-ID", f"<urn:page:{page}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url)]
    http = "application/http;msgtype=response"
    if not is_head:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        refers = [("WARC-Payload-Digest", digest), ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{head}>"), ("Content-Type", http)]
        yield _record([("WARC-Type", "revisit"), *named, *refers], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    parts = cut(block, segment_bytes)
    number = ("WARC-Segment-Number", 1 if len(parts) > 1 else None)
    yield _record([("WARC-Type", "response"), *named, ("WARC-Payload-Digest", digest), ("Content-Type", http), number], parts[0])
    for k, part in enumerate(parts[1:], 2):
        total = ("WARC-Segment-Total-Length", len(block) if k == len(parts) else None)
        own = [("WARC-Record-ID", f"<urn:page:{page}:segment:{k}>"), ("WARC-Segment-Origin-ID", f"<urn:page:{page}>"), ("WARC-Segment-Number", k)]
        yield _record([("WARC-Type", "continuation"), *own, ("WARC-Date", DATE), ("WARC-Target-URI", url), total], part)


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_revisit_bytes: int = 0,
    segment_bytes: int = 1 << 15,
    chunk_bytes: int = 1 << 12,
    records_per_file: int = 2000,
) -> None:
    """Write one record (or a segmented one) per page below ``path``.

    The pages are numbered in a written table, so that every later read, by
    whatever executor, sees the same numbers.  Equal payloads are found by
    SHA-256 and length, aggregated before the shuffle; the join back is a plain
    equi-join, whose hot keys Spark splits.  A block has ``segment_bytes`` at
    most, so a file has about a gibibyte at most, whatever the pages' sizes.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("string").alias("page"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("sha"), F.octet_length(payload).alias("n"),
    )
    rows = shared_table(rows, "pages", codec="zstd")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row"))
    groups = rows.groupBy("sha", "n").agg(first.alias("head"), F.count(F.lit(1)).alias("c"))
    repeated = groups.where(f"c > 1 AND n >= {int(min_revisit_bytes)}").select("sha", "n", "head")
    name = lambda page, row: F.concat_ws(":", F.coalesce(page, F.lit("")), row.cast("string"))
    marked = rows.join(repeated, ["sha", "n"], "left").select(
        name(F.col("page"), F.col("row")).alias("page"),
        name(F.col("head.id").cast("string"), F.col("head.row")).alias("head"),
        (F.col("head").isNull() | (F.col("head.row") == F.col("row"))).alias("is_head"),
        "url", "payload",
    )

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, head, is_head, url = (batch.column(k).to_pylist() for k in range(4))
            for at in range(0, batch.num_rows, 256):
                out: list[str] = []
                for k in range(at, min(at + 256, batch.num_rows)):
                    data = batch.column(4)[k].as_buffer().to_pybytes()
                    # a line break in a header value would end the header
                    target = re.sub(r"[\r\n]+", " ", url[k])
                    out += page_records(page[k], head[k], is_head[k], target, data, segment_bytes, chunk_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    out = marked.mapInArrow(records, "value string")
    most = max(1, min(records_per_file, (1 << 30) // segment_bytes))
    out.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", most).option("compression", "gzip").text(path)


def unzipped(data: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """The content of a plain or gzipped file (of any number of members), in
    pieces of about ``step`` bytes."""
    if not data.startswith(b"\x1f\x8b"):
        yield from (data[at : at + step] for at in range(0, len(data), step))
        return
    while data:
        member = zlib.decompressobj(31)
        at = 0
        while not member.eof:
            piece = member.unconsumed_tail or data[at : at + step]
            if not member.unconsumed_tail:
                at += len(piece)
            if not piece:
                raise ValueError("the gzip stream is cut off")
            yield member.decompress(piece, step)
        data = member.unused_data + data[at:]


def parse_records(parts: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of one file, read
    piece by piece: only the record at hand is held."""
    held, gone, source = bytearray(), 0, iter(parts)

    def reaches(end: int) -> bool:
        while len(held) < end:
            if (part := next(source, None)) is None:
                return False
            held.extend(part)
        return True

    while reaches(1):
        end, seen = -1, 0
        while (end := held.find(SEP + SEP, max(seen - 3, 0))) < 0:
            seen = len(held)
            if not reaches(seen + 1):
                break
        if end < 0 or not held.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {gone}")
        lines = held[:end].decode().split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        stop = end + 4 + int(headers["content-length"])
        if not reaches(stop + 4) or held[stop : stop + 4] != SEP + SEP:
            raise ValueError(f"the record at byte {gone} is cut off")
        yield headers, bytes(held[end + 4 : stop])
        del held[: stop + 4]
        gone += stop + 4


_RECORD = "kind string, record_id string, origin string, segment int, total long, url string, digest string, refers_to string, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``, segments apart."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _RECORD.split(", ")]
        kinds = [pa.string()] * 3 + [pa.int32(), pa.int64()] + [pa.string()] * 3 + [pa.binary()]
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                size = 0
                for h, block in parse_records(unzipped(content.as_buffer().to_pybytes())):
                    rid = h["warc-record-id"].strip("<>")
                    segment = number(h.get("warc-segment-number"))
                    origin = h.get("warc-segment-origin-id", rid).strip("<>") if segment else None
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    refers = h.get("warc-refers-to", "").strip("<>") or None
                    rows.append((h["warc-type"], rid, origin, segment, number(h.get("warc-segment-total-length")), h.get("warc-target-uri"), digest, refers, block))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select("content").mapInArrow(parse, _RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """Segmented records by origin, their blocks in order of segment number; the
    others pass through.  What takes ``blocks`` joins them, once."""
    whole = records.where("origin IS NULL").select("kind", "record_id", "url", "digest", "refers_to", F.array("block").alias("blocks"))
    part = F.struct("segment", "kind", "url", "digest", "refers_to", "total", "block")
    parts = records.where("origin IS NOT NULL").groupBy("origin").agg(F.sort_array(F.collect_list(part)).alias("p"))
    first, last = F.col("p")[0], F.element_at("p", -1)
    blocks = F.transform("p", lambda x: x["block"])
    length = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["block"]))
    sound = F.transform("p", lambda x: x["segment"]).eqNullSafe(F.sequence(F.lit(1), F.size("p"))) & last["total"].eqNullSafe(length)
    checked = F.when(sound, blocks).otherwise(
        F.raise_error(F.concat(F.lit("segments missing or of another total length: "), F.col("origin"))).cast("array<binary>")
    )
    segmented = parts.select(
        first["kind"].alias("kind"), F.col("origin").alias("record_id"), first["url"].alias("url"),
        first["digest"].alias("digest"), first["refers_to"].alias("refers_to"), checked.alias("blocks"),
    )
    return whole.unionByName(segmented)


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per page record: record_id, kind, url, refers_to, payload_bytes,
    payload_digest, and the payload itself where asked for (null for revisits).

    A response's digest is computed from its decoded payload and must equal
    the one in its header.
    """
    schema = "kind string, record_id string, url string, refers_to string, payload_digest string, own_bytes long" + ", payload binary" * with_payload

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rid, url, digest, refers = (batch.column(k).to_pylist() for k in range(5))
            sizes, payloads = [], []
            for k in range(batch.num_rows):
                data = http_payload(b"".join(batch.column(5)[k].as_py())) if kind[k] == "response" else None
                if data is not None and base32_sha1(data) != digest[k]:
                    raise ValueError(f"{rid[k]}: the payload does not match its digest")
                sizes.append(None if data is None else len(data))
                payloads.append(data if with_payload else None)
            arrays = [pa.array(x, pa.string()) for x in (kind, rid, url, refers, digest)] + [pa.array(sizes, pa.int64())]
            names = ["kind", "record_id", "url", "refers_to", "payload_digest", "own_bytes"]
            if with_payload:
                arrays, names = [*arrays, pa.array(payloads, pa.binary())], [*names, "payload"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = reassemble(read_records(spark, path)).mapInArrow(decode, schema)
    if not with_payload:
        rows = shared_table(rows, "records")  # parsed once, read three times
    response = F.col("kind") == "response"
    sizes = rows.where("kind = 'response'").groupBy("payload_digest").agg(F.max("own_bytes").alias("of_digest"))
    revisits = rows.where(~response).join(sizes, "payload_digest", "left").withColumn("payload_bytes", F.col("of_digest")).drop("of_digest")
    return rows.where(response).withColumn("payload_bytes", F.col("own_bytes")).unionByName(revisits).drop("own_bytes")


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", min_revisit_bytes: int = 0) -> DataFrame:
    """Write the pages as archives, read them back: one row per page."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path, id_col, min_revisit_bytes=min_revisit_bytes)
    kind = pages.schema[id_col].dataType
    page = lambda c: F.regexp_extract(c, "^urn:page:(.*):[0-9]+$", 1)
    as_id = lambda c: F.when(page(c) != "", page(c)).cast(kind)
    return read_warc(spark, path).select(
        as_id(F.col("record_id")).alias(id_col),
        "payload_bytes",
        "payload_digest",
        F.col("kind").alias("record_type"),
        as_id(F.col("refers_to")).alias("refers_to"),
        "url",
    )
