"""WARC archives: writing with revisits and segments, and reading with reassembly.

Writing: a payload that equals another page's is stored once; the record with the largest
page id is the response, the others are revisits. Responses carry an HTTP block in chunked
transfer framing; a block longer than ``segment_bytes`` goes on in continuation records.
Reading: every archive is walked by Content-Length; segments are grouped by the origin
identifier, put in order by segment number, checked for gaps and against the total length,
and only then is the chunked framing undone.

Archives are written and read by Spark's own sources, so any store that Spark reaches will
do. An archive is bounded by ``archive_records`` records of about ``segment_bytes``.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicpulse.session import new_folder, saved, ship_package

SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
ARCHIVE_RECORDS = 4000
_SLICE = 4 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The body in HTTP's chunked transfer framing."""
    parts = []
    for at in range(0, len(body), size):
        piece = body[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """Undo chunked framing; extensions and trailers are passed over, damage raises ValueError."""
    parts, at = [], 0
    while True:
        line_end = framed.find(b"\r\n", at)
        if line_end < 0:
            raise ValueError("chunk size missing")
        size = int(framed[at:line_end].split(b";")[0], 16)
        at = line_end + 2
        if size == 0:
            return b"".join(parts)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        parts.append(framed[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """Body of an HTTP response block."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("HTTP headers do not end")
    framed = any(
        line.lower().startswith(b"transfer-encoding:") and b"chunked" in line.lower() for line in head.split(b"\r\n")
    )
    return unchunked(body) if framed else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the last line end, which the text writer adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n"


def _line(value: str | None) -> str | None:
    return None if value is None else value.replace("\r", "%0D").replace("\n", "%0A")


def page_records(
    page_id: int | None, url: str | None, payload: bytes, keeper: int | None, segment_bytes: int
) -> Iterator[bytes]:
    """The records of a page: a revisit, or a response with its continuations."""
    digest = "sha1:" + base32_sha1(payload)
    me = f"<urn:uuid:{uuid.uuid4()}>"
    common = [("WARC-Record-ID", me), ("WARC-Date", _DATE), ("WARC-Target-URI", _line(url)), ("WARC-Page-Id", page_id)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    kind = ("Content-Type", "application/http; msgtype=response")
    if keeper is not None:
        refers = [("WARC-Profile", _PROFILE), ("WARC-Payload-Digest", digest), ("WARC-Refers-To-Page-Id", keeper)]
        yield _record([("WARC-Type", "revisit"), *common, *refers, kind], http)
        return
    block = http + chunked(payload)
    first = [("WARC-Type", "response"), *common, ("WARC-Payload-Digest", digest), kind]
    if len(block) <= segment_bytes:
        yield _record(first, block)
        return
    yield _record([*first, ("WARC-Segment-Number", 1)], block[:segment_bytes])
    for number, at in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
        piece = block[at : at + segment_bytes]
        total = len(block) if at + segment_bytes >= len(block) else None
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", _DATE)]
        origin = [("WARC-Segment-Origin-ID", me), ("WARC-Segment-Number", number)]
        yield _record([*own, *origin, ("WARC-Segment-Total-Length", total)], piece)


def write_archives(
    pages: DataFrame,
    folder: str,
    segment_bytes: int = SEGMENT_BYTES,
    archive_records: int = ARCHIVE_RECORDS,
    compression: str = "gzip",
) -> None:
    """Write ``page_id, url, html`` as WARC archives into ``folder``.

    A null html is an empty payload; a null url leaves its field out. Payloads of no bytes
    count as equal to each other. Of rows that repeat both the largest id and the payload,
    each is a response. A row without id is a revisit if a row with one has its payload, else
    a response. An empty table writes no record.
    """
    ship_package(pages.sparkSession)
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    keepers = pages.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    repeats = keepers.filter("n > 1").select("digest", "keeper")
    refers = F.when(~F.col("keeper").eqNullSafe(F.col("page_id")), F.col("keeper"))
    marked = pages.join(repeats, "digest", "left").select("page_id", "url", "payload", refers.alias("keeper"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row in zip(*(batch.column(k) for k in range(4)), strict=True):
                for record in page_records(*(x.as_py() for x in row), segment_bytes):
                    out.append(record)
                    size += len(record)
                if size > _SLICE:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    lines = marked.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
    out = lines.write.option("lineSep", "\r\n").option("maxRecordsPerFile", archive_records)
    out.option("compression", compression).text(folder)


def walk(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive, plain or gzipped (one member or many): fields by lower-case name, block."""
    if archive[:2] == b"\x1f\x8b":
        parts = []
        while archive:
            member = zlib.decompressobj(31)
            parts.append(member.decompress(archive))
            archive = member.unused_data
        archive = b"".join(parts)
    at = 0
    while at < len(archive):
        head_end = archive.find(b"\r\n\r\n", at)
        lines = archive[at:head_end].decode("utf-8", "replace").split("\r\n") if head_end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        first = head_end + 4
        last = first + int(fields["content-length"])
        if archive[last : last + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} has another length")
        yield fields, archive[first:last]
        at = last + 4


_RECORD = (
    "record_id string, origin_id string, segment int, total_length long, record_type string, page_id long, "
    "url string, digest string, refers_to long, block binary"
)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each WARC record of the archives in a folder; ``block`` is as stored."""
    ship_package(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("record_id", pa.string()), ("origin_id", pa.string()), ("segment", pa.int32()), ("total_length", pa.int64()),
             ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()),
             ("refers_to", pa.int64()), ("block", pa.binary())]
        )

        def number(text: str | None) -> int | None:
            return None if text is None else int(text)

        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for f, block in walk(content.as_py()):
                    me = f.get("warc-record-id")
                    rows.append(
                        (me, f.get("warc-segment-origin-id", me), number(f.get("warc-segment-number")),
                         number(f.get("warc-segment-total-length")), f.get("warc-type"), number(f.get("warc-page-id")),
                         f.get("warc-target-uri"), f.get("warc-payload-digest"), number(f.get("warc-refers-to-page-id")),
                         block)
                    )
                    size += len(block)
                    if size > _SLICE:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(parse, _RECORD)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Whole captures: record_type, page_id, url, digest, refers_to, payload, problem.

    Records that stand alone never move. Segments meet by their origin; what lacks a segment,
    the last one's total length, or agrees with neither that nor its payload digest keeps its
    row with the reason in ``problem`` and no payload. A revisit has no payload of its own.
    """
    records = read_records(spark, folder)
    alone = records.filter("segment IS NULL")
    segments = records.filter("segment IS NOT NULL")
    # A group is one capture: as large as its block, whatever the table holds.
    pieces = F.sort_array(F.collect_list(F.struct("segment", "block")))
    joined = segments.groupBy("origin_id").agg(
        *(F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("page_id", "url", "digest", "refers_to")),
        F.max(F.when(F.col("segment") == 1, F.col("record_type"))).alias("record_type"),
        F.max("total_length").alias("total_length"),
        pieces.alias("pieces"),
    )
    block = F.aggregate("pieces", F.lit(b""), lambda a, p: F.concat(a, p["block"]))
    in_order = F.expr("transform(pieces, p -> p.segment) = sequence(1, size(pieces))")
    whole = in_order & (F.length(block) == F.col("total_length"))
    common = ["record_type", "page_id", "url", "digest", "refers_to"]
    joined = joined.select(*common, F.when(whole, block).alias("block"))
    captures = alone.select(*common, "block").unionByName(joined)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, problems = [], []
            for kind, digest, block in zip(*(batch.column(c) for c in ("record_type", "digest", "block")), strict=True):
                payload, problem = None, None
                if block.as_py() is None:
                    problem = "segments missing or of another length"
                elif kind.as_py() == "response":
                    try:
                        payload = payload_of(block.as_py())
                        if digest.as_py() not in (None, "sha1:" + base32_sha1(payload)):
                            payload, problem = None, "payload digest differs"
                    except ValueError as e:
                        problem = str(e)
                payloads.append(payload)
                problems.append(problem)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in common), pa.array(payloads, pa.binary()), pa.array(problems, pa.string())],
                names=[*common, "payload", "problem"],
            )

    schema = "record_type string, page_id long, url string, digest string, refers_to long, payload binary, problem string"
    return captures.filter("record_type IS NULL OR record_type IN ('response', 'revisit')").mapInArrow(decode, schema)


def capture_digests(captures: DataFrame) -> DataFrame:
    """By page: size and digest of the full payload (a revisit's from its response) and the reference."""
    measured = saved(
        captures.select(
            "page_id", "record_type", "refers_to", "problem",
            F.expr("substring(digest, 6)").alias("payload_digest"),
            F.length("payload").cast("long").alias("payload_bytes"),
        ),
        "captures",
    )
    responses = measured.filter("record_type = 'response'")
    known = responses.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(
        F.max("payload_bytes").alias("payload_bytes")
    )
    revisits = measured.filter("record_type = 'revisit'").drop("payload_bytes").join(known, ["refers_to", "payload_digest"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"]
    return responses.select(*columns).unionByName(revisits.select(*columns))


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = new_folder(spark, "warc")
    write_archives(spark.read.parquet(f"{folder}/pages.parquet"), archives)
    return capture_digests(read_archives(spark, archives)).drop("problem")


_ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), k AS (SELECT h, max(page_id) AS keeper FROM p GROUP BY h),
b AS (
  SELECT h, keeper, array_to_string(list_transform(range(1, 41), lambda i:
    lpad(bin(instr('0123456789abcdef', substr(h, i, 1)) - 1), 4, '0')), '') AS bits FROM k
), d AS (
  SELECT h, keeper, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + list_sum(list_transform(range(1, 6), lambda j: substr(bits, i * 5 + j, 1)::INTEGER * (1 << (5 - j))))::INTEGER, 1)
  ), '') AS digest FROM b
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM p JOIN d USING (h)
"""

QUERIES = {"op4_warc": op4_warc}
ORACLE_SQL = {"op4_warc": _ORACLE}
