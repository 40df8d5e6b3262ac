"""WARC archives written and read by Spark as a table of record chunks.

A payload is cut into segments of at most CHUNK bytes at character ends: rows of record id and
segment number, each one WARC record (`response` first, then `continuation`), with an incremental
SHA-1 carried from segment to segment. Archives are text files whose records end in two line ends;
they are read back a segment at a time by splitting before the next record's version line. No block
spells that split: a segment is cut inside a version line that follows two line ends, also where
these are the end of its record's own head. No step after the scan holds more of a payload than a
segment, but for the scanned row itself: segments leave the writer one after another.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import work_folder, written

VERSION = "WARC/1.1\r\n"
ENDS = "\r\n\r\n"
BOUNDARY = (ENDS + VERSION).encode()
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNK = 1 << 13
#: records that leave the writer together hold about so many bytes
SLICE = 1 << 20


def base32_sha1(state: hashlib._Hash) -> str:
    return base64.b32encode(state.digest()).decode()


def segments(payload: memoryview | bytes, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of at most `size` bytes that end at UTF-8 character ends; none spells a boundary after its head."""
    n, start = len(payload), 0
    while True:
        end = min(n, start + max(size, 16))
        while start < end < n and payload[end] & 0xC0 == 0x80:
            end -= 1
        # every head ends in two line ends, so a segment may not begin with a version line either
        seam = ENDS.encode() + bytes(payload[start:end])
        inside = seam.find(BOUNDARY)
        if inside >= 0:
            end = start + inside + 4  # after "WARC" of the version line
        yield start, end
        start = end
        if start >= n:
            return


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a string column: eight digits for each forty bits."""
    hexed = F.sha1(payload)
    fives = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*fives)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _one_line(text: str) -> str:
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in text or "\n" in text else text


def _record_texts(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in _slices(text for i in range(batch.num_rows) for text in _records_of(batch.slice(i, 1), date)):
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])

    return run


def _slices(texts: Iterator[str]) -> Iterator[list[str]]:
    """Lists of texts of about SLICE characters."""
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text)
        if size >= SLICE:
            yield some
            some, size = [], 0
    if some:
        yield some


def _records_of(row: pa.RecordBatch, date: str) -> Iterator[str]:
    """The WARC records of one page, a segment at a time."""
    record, page_id, url, refers, digest, size = (row.column(i)[0].as_py() for i in range(6))
    name = f"<urn:record:{record}:{{}}>"
    head = [f"WARC-Date: {date}", f"WARC-Target-URI: {_one_line(url or f'urn:page:{page_id}')}", f"Page-ID: {'' if page_id is None else page_id}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {size}"]
    if refers is not None:
        own = [f"WARC-Type: revisit\r\nWARC-Record-ID: {name.format(1)}", *head, f"WARC-Refers-To: <urn:page:{refers}>", "Content-Length: 0"]
        yield VERSION + "\r\n".join(own) + ENDS
        return
    value = row.column(6)[0]
    payload = memoryview(value.as_buffer() or b"") if value.is_valid else memoryview(b"")
    count = sum(1 for _ in segments(payload))
    state = hashlib.sha1()
    for k, (a, b) in enumerate(segments(payload), 1):
        state.update(payload[a:b])
        if k == count and base32_sha1(state) != digest:
            raise ValueError(f"page {page_id}: the chunks differ from the payload")
        block = (HTTP_HEAD if k == 1 else b"") + bytes(payload[a:b])
        own = [f"WARC-Type: {'response' if k == 1 else 'continuation'}\r\nWARC-Record-ID: {name.format(k)}", *head]
        own += [f"WARC-Segment-Number: {k}", f"Segment-Count: {count}", f"WARC-Segment-Origin-ID: {name.format(1)}", f"Content-Length: {len(block)}"]
        yield VERSION + "\r\n".join(own) + ENDS + block.decode()


def write_archives(pages: DataFrame, path: str, *, least_bytes: int = 0, compression: str = "gzip", date: str = "1970-01-01T00:00:00Z") -> None:
    """One record per row of pages(page_id, url, html) under `path`, as WARC text files.

    Of records with equal payloads of at least `least_bytes` bytes, that with the least page_id is
    a response and the others are revisits of it; smaller payloads are all responses. Rows that
    repeat a page_id and a payload are a record each, of one kind.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    whole = F.coalesce("html", F.lit(""))
    rows = rows.withColumns({"payload_digest": payload_digest(whole), "payload_bytes": F.octet_length(whole).cast("long")})
    seen = written(rows.select("page_id", "payload_digest", "payload_bytes"))
    first = seen.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first"))
    kinds = seen.join(first, ["payload_digest", "payload_bytes"], "left").select(
        "page_id", "payload_digest", "payload_bytes", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to")
    )
    # repeated rows are one here; the join below brings each its kind
    kinds = kinds.groupBy("page_id", "payload_digest", "payload_bytes").agg(F.min("refers_to").alias("refers_to"))
    rows = rows.withColumn("record_id", F.monotonically_increasing_id())
    on = rows["page_id"].eqNullSafe(kinds["page_id"]) & (rows["payload_digest"] == kinds["payload_digest"])
    told = rows.join(kinds, on).select("record_id", rows["page_id"], "url", "refers_to", rows["payload_digest"], rows["payload_bytes"], "html")
    told.mapInArrow(_record_texts(date), "value string").write.option("lineSep", ENDS).option("compression", compression).text(path)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Headers of each segment; a whole payload is digested at once, others keep their data."""
    names = ["record", "page_id", "record_type", "refers_to", "told_digest", "told_bytes", "segment", "segments", "payload_bytes", "payload_digest", "data"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        rows = []
        for value in batch.column(0):
            head, _, body = value.as_py().removeprefix(VERSION).partition(ENDS)
            fields = dict(line.split(": ", 1) for line in head.split("\r\n"))
            block = body.encode()[: int(fields["Content-Length"])]
            if len(block) < int(fields["Content-Length"]):
                raise ValueError(f"record {fields['WARC-Record-ID']} is cut short")
            kind = fields["WARC-Type"]
            origin = fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"])
            digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["Payload-Length"])
            page = int(fields["Page-ID"]) if fields["Page-ID"] else None
            refers = int(fields["WARC-Refers-To"].split(":")[-1].rstrip(">")) if "WARC-Refers-To" in fields else None
            k, n = int(fields.get("WARC-Segment-Number", 1)), int(fields.get("Segment-Count", 1))
            if kind == "response":
                block = block.partition(ENDS.encode())[2]
            own = (None, None, block) if n > 1 else (size, digest, None) if kind == "revisit" else (len(block), base32_sha1(hashlib.sha1(block)), None)
            rows.append((origin, page, "response" if kind == "continuation" else kind, refers, digest, size, k, n, *own))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of records whose segments come in order, carried across batches."""
    state, size, due = hashlib.sha1(), 0, 1
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        done = []
        for record, page, kind, digest, told, k, n, data in zip(*columns):
            if k == 1:
                state, size, due = hashlib.sha1(), 0, 1
            if k != due:
                raise ValueError(f"segment {due} of {record} is missing")
            state.update(data)
            size, due = size + len(data), due + 1
            if k == n:
                done.append((page, kind, None, digest, told, size, base32_sha1(state)))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = ["page_id", "record_type", "refers_to", "told_digest", "told_bytes", "payload_bytes", "payload_digest"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * 7, kinds)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record under `path`.

    Digests and lengths of responses are those of the payloads as read; a difference from what the
    record tells, or a missing segment, is an error.
    """
    lines = spark.read.option("lineSep", BOUNDARY.decode()).text(path).where("value <> ''")
    shape = "record string, page_id long, record_type string, refers_to long, told_digest string, told_bytes long, segment int, segments int, payload_bytes long, payload_digest string, data binary"
    parsed = written(lines.mapInArrow(_parsed, shape))
    cut = parsed.where("segments > 1").select("record", "page_id", "record_type", "told_digest", "told_bytes", "segment", "segments", "data")
    shape = "page_id long, record_type string, refers_to long, told_digest string, told_bytes long, payload_bytes long, payload_digest string"
    long = cut.repartition("record").sortWithinPartitions("record", "segment").mapInArrow(_joined, shape)
    every = parsed.where("segments = 1").select(long.columns).unionByName(long)
    sound = (F.col("told_digest") == F.col("payload_digest")) & (F.col("told_bytes") == F.col("payload_bytes"))
    checked = F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its record: "), F.col("told_digest"))))
    return every.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


def archived(pages: DataFrame, **options: object) -> DataFrame:
    """Write pages(page_id, url, html) to archives in the shared folder and read them back.

    Null and empty payloads are empty records; an empty table gives no records. Extra columns are
    ignored.
    """
    spark = pages.sparkSession
    path = work_folder(spark)
    write_archives(pages, path, **options)
    return read_archives(spark, path)
