"""Web archives with segmented records: writing, reading, reassembly and transfer decoding."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citesieve.llm.common import stage

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
#: Records of at most SEGMENT_BYTES and their headers go into one file, so a file stays below about 20 MB before compression.
RECORDS_PER_FILE = 1_000
REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, type string, origin string, segment int, total long, uri string, refers_to string, payload_digest string, block binary"
PAYLOAD = "record_id string, type string, uri string, refers_to string, payload_digest string, payload binary, status string"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at:at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload inside chunked framing; None when the framing is broken. Chunk extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if size < 0 or at + size + 2 > len(body) or body[at + size:at + size + 2] != b"\r\n":
            return None
        parts.append(body[at:at + size])
        at += size + 2


def decode_http(block: bytes) -> tuple[bytes | None, str]:
    """Payload of an HTTP response block, and ``ok`` or what is wrong with it."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        return None, "no http head"
    fields = dict((k.strip().lower(), v.strip().lower()) for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:]))
    if b"chunked" not in fields.get(b"transfer-encoding", b""):
        return body, "ok"
    payload = unchunked(body)
    return (payload, "ok") if payload is not None else (None, "broken chunk framing")


def reassemble(segments: list[tuple[int, int | None, bytes]]) -> tuple[bytes | None, int, str]:
    """The block of one record from its (segment number, total length, block) parts, how often it was written, and ``ok`` or the fault.

    Parts are ordered by number. The numbers must run from 1 without a gap, the last part must give
    the total length, and the lengths must add up to it. A record written twice has each part twice.
    """
    parts: dict[int, bytes] = {}
    times: dict[int, int] = {}
    total = None
    for number, length, block in segments:
        if number in parts and parts[number] != block:
            return None, 1, "segments differ"
        parts[number] = block
        times[number] = times.get(number, 0) + 1
        total = length if length is not None else total
    if sorted(parts) != list(range(1, len(parts) + 1)):
        return None, 1, "segment missing"
    if len(set(times.values())) > 1:
        return None, 1, "segments repeat unevenly"
    if total is None or total != sum(map(len, parts.values())):
        return None, times[1], "total length differs"
    return b"".join(parts[i] for i in range(1, len(parts) + 1)), times[1], "ok"


def _head(fields: list[tuple[str, str | None]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode() + b"\r\n"


def records_of(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None,
               segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The archive records of one capture: a revisit without payload, one response, or a response cut into segments."""
    clean = " ".join((uri or "").split()) or None
    common = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", clean)]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        yield _head([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to),
                     ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"),
                     ("Content-Length", str(len(block)))]) + block
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    parts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    for number, part in enumerate(parts, 1):
        fields = [("WARC-Type", "response" if number == 1 else "continuation"),
                  ("WARC-Record-ID", record_id if number == 1 else f"{record_id[:-1]}:{number}>"), *common]
        if number == 1:
            fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
        if len(parts) > 1:
            fields.append(("WARC-Segment-Number", str(number)))
            if number > 1:
                fields.append(("WARC-Segment-Origin-ID", record_id))
            if number == len(parts):
                fields.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _head([*fields, ("Content-Length", str(len(part)))]) + part


def write_archive(captures: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES,
                  records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write captures (record_id, uri, payload binary, payload_digest, refers_to) as compressed archive files under ``path``.

    Spark's own text writer puts out the records with the two line breaks that end a record as its
    separator, so files commit and retry as any Spark output and ``path`` may be any file system.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                rows = batch.slice(low, 500).to_pylist()
                out = [record for r in rows for record in records_of(
                    r["record_id"], r["uri"], r["payload"] or b"", r["payload_digest"], r["refers_to"], segment_bytes, chunk_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = captures.select("record_id", "uri", "payload", "payload_digest", "refers_to").mapInArrow(run, "record binary")
    (records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def _inflate(content: bytes) -> bytes:
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content) + member.flush())
        content = member.unused_data
    return b"".join(out)


def parse_records(data: bytes) -> Iterator[dict]:
    """Records of one archive file, by their content lengths; a cut record ends the file."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        fields = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            key, _, value = line.partition(b":")
            fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        length = int(fields.get("content-length", "0"))
        block = data[end + 4:end + 4 + length]
        at = end + 4 + length
        if len(block) < length:
            return
        segment, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
        digest = fields.get("warc-payload-digest")
        yield {"record_id": fields.get("warc-record-id"), "type": fields.get("warc-type"),
               "origin": fields.get("warc-segment-origin-id", fields.get("warc-record-id")), "segment": segment and int(segment),
               "total": total and int(total), "uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"),
               "payload_digest": digest and digest.rpartition(":")[2].lower(), "block": block}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archive files under ``path``, one row each, blocks as stored."""
    schema = _arrow_schema(spark, RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for record in parse_records(_inflate(content.as_py() or b"")):
                    rows.append(record)
                    held += len(record["block"])
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(part.split()[0], kinds[part.split()[1]]) for part in ddl.split(", ")])


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Captures of an archive: record_id, type, uri, refers_to, payload_digest, payload, status.

    Continuation records are grouped by the record they continue, ordered by segment number and
    checked against the total length; then chunked framing is taken off. A record with a fault has a
    null payload and the fault as its status; revisits have no payload and status ``ok``. Unsegmented
    records are not shuffled; a group holds the segments of one record only.
    """
    records = read_records(spark, path)
    single = records.where("segment is null").select(
        "record_id", "type", "uri", "refers_to", "payload_digest", F.array(F.struct(F.lit(1).alias("segment"), F.length("block").cast("long").alias("total"), "block")).alias("parts"))
    first = F.col("segment") == 1
    grouped = records.where("segment is not null").groupBy("origin").agg(
        *[F.max(F.when(first, F.col(c))).alias(c) for c in ("type", "uri", "refers_to", "payload_digest")],
        F.collect_list(F.struct("segment", "total", "block")).alias("parts")).withColumnRenamed("origin", "record_id")
    joined = single.unionByName(grouped.select(*single.columns))
    schema = _arrow_schema(spark, PAYLOAD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                out = []
                for r in batch.slice(low, 500).to_pylist():
                    parts = [(p["segment"], p["total"], p["block"]) for p in r.pop("parts")]
                    block, times, status = reassemble(parts)
                    payload = None
                    if block is not None and r["type"] != "revisit":
                        payload, status = decode_http(block)
                    out += [r | {"payload": payload, "status": status}] * times
                yield pa.RecordBatch.from_pylist(out, schema)

    return joined.mapInArrow(run, PAYLOAD)


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures of pages (page_id, url, html): equal payloads of at least 100 bytes refer to the one with the smallest page_id.

    Null html is an empty payload; a null page_id is never referred to unless all of its group are
    null. Rows repeated with the smallest page_id of their payload are all responses.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    firsts = stage(rows.where(F.length("payload") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first")), "warc-firsts")
    joined = rows.join(firsts, "payload_digest", "left")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    return joined.select(record_name(F.col("page_id")).alias("record_id"), F.col("url").alias("uri"), "payload", "payload_digest",
                         F.when(again, record_name(F.col("first"))).alias("refers_to"))


def record_name(page_id):
    """The name of a capture: page and digest, so rows that repeat a page with another payload do not share a name."""
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), F.col("payload_digest"), F.lit(">"))


def page_of(record_id):
    return F.regexp_extract(record_id, r"^<urn:x-page:(-?\d+):", 1).try_cast("long")


def archive_pages(pages: DataFrame, path: str) -> DataFrame:
    """Write ``pages`` as archives under ``path``, read them back and return the contract's rows.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, status. Size and digest
    are computed from what was read; those of a revisit come from the response it refers to, and
    its status tells when that response is missing. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    write_archive(page_captures(pages), path)
    read_back = stage(read_payloads(spark, path).select(
        page_of(F.col("record_id")).alias("page_id"), F.col("type").alias("record_type"), page_of(F.col("refers_to")).alias("refers_to"),
        F.col("payload_digest").alias("named"), F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
        "status"), "warc-read")
    responses = read_back.where("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
        F.when((F.col("status") == "ok") & (F.col("payload_digest") != F.col("named")), "digest differs").otherwise(F.col("status")).alias("status"))
    known = stage(responses.where("status = 'ok'").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("named"))
                  .agg(F.max("payload_bytes").alias("payload_bytes")), "warc-known")
    revisits = read_back.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(known, ["refers_to", "named"], "left").select(
        "page_id", "payload_bytes", F.when(F.col("payload_bytes").isNotNull(), F.col("named")).alias("payload_digest"), "record_type", "refers_to",
        F.when(F.col("payload_bytes").isNull(), "response missing").otherwise(F.col("status")).alias("status"))
    return responses.union(revisits)
