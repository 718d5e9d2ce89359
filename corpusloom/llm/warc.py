"""WARC archives: writing, reading, and resolving equal payloads to revisit records.

Every row is written once with its header fields and a number of its own. Headers (never payloads) are then shuffled by payload digest;
the record that stays a response is found with a partially aggregated maximum of (page_id, number), so that a digest shared by a third
of all records costs no more than any other, and of several equal rows one is the response. Payloads move once, joined by their own
record's number while the archives are written with fresh headers.

Defined cases: a null payload is an empty one; a null id or target URI is an absent header and comes back as null, and null ids come
before all others; every row gives a record with a record id of its own, and exact repeats revisit one of them; payloads below
``min_payload_bytes`` are always responses; an empty input gives an archive set without records. Extra columns are ignored.
Archives are gzip files of one member each, of about ``FILE_BYTES`` of records (by their mean size). A reader task holds one compressed
file at a time and unpacks it record by record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.scratch import Scratch

_CRLF = "\r\n"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Bytes of records in a file, before compression.
FILE_BYTES = 64 << 20
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "page_id bigint, url string, record_id string, record_type string, payload_bytes bigint, payload_digest string, refers_to_record string"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of a string or binary column, in the JVM: four groups of 40 bits, eight digits each."""
    digest = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*digits), _HEX32, _BASE32)


def _record_id(digest: Column, page: Column, number: Column) -> Column:
    name = F.md5(F.concat_ws("/", digest, F.coalesce(page.cast("string"), F.lit("-")), number.cast("string")))
    cut = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def with_headers(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, number`` of every row, as a written table: payloads are read and hashed
    once, and numbers stay what they are."""
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    base = base.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.encode("payload", "UTF-8")), "number": F.monotonically_increasing_id()})
    return scratch.table(base, "records")


def resolve(records: DataFrame, scratch: Scratch, min_payload_bytes: int = 0) -> DataFrame:
    """``records`` with ``is_response``, ``refers_to`` and ``refers_to_number``: of equal payloads, the one with the largest page_id is
    the response.

    Headers are joined to the responses by digest; both sides are plain exchanges, so adaptive execution splits a hot digest.
    """
    headers = records.where(F.col("payload_bytes") >= min_payload_bytes).select("page_id", "payload_digest", "number")
    originals = headers.groupBy("payload_digest").agg(F.max(F.struct("page_id", "number")).alias("original"), F.count("*").alias("copies")).where("copies > 1")
    originals = scratch.table(originals.select("payload_digest", "original"), "originals")
    joined = headers.join(originals, "payload_digest").where(F.col("number") != F.col("original.number"))
    revisits = scratch.table(joined.select("number", F.col("original.page_id").alias("refers_to"), F.col("original.number").alias("refers_to_number")), "revisits")
    return records.join(revisits, "number", "left").withColumn("is_response", F.col("refers_to_number").isNull())


def record_text(date: str = "2024-01-01T00:00:00Z") -> Column:
    """One WARC/1.1 record, without its last line end, from the columns of ``resolve``."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))
    maybe = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    uri = F.regexp_replace("url", r"[\r\n]", " ")
    refers = F.when(~F.col("is_response"), _record_id(F.col("payload_digest"), F.col("refers_to"), F.col("refers_to_number")))
    head = F.concat(
        F.lit("WARC/1.1" + _CRLF),
        line("WARC-Type", F.when(F.col("is_response"), "response").otherwise("revisit")),
        line("WARC-Record-ID", _record_id(F.col("payload_digest"), F.col("page_id"), F.col("number"))),
        line("WARC-Date", F.lit(date)),
        maybe("WARC-Target-URI", uri),
        maybe("X-Page-ID", F.col("page_id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        maybe("WARC-Profile", F.when(~F.col("is_response"), F.lit(_REVISIT))),
        maybe("WARC-Refers-To", refers),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(F.col("is_response"), F.col("payload_bytes")).otherwise(0).cast("string")),
    )
    return F.concat(head, F.lit(_CRLF), F.when(F.col("is_response"), F.col("payload")).otherwise(""), F.lit(_CRLF))


def write_archives(resolved: DataFrame, path: str, records_per_file: int) -> None:
    """Writes the records as gzip archives, in the JVM, to any file system that Spark writes to."""
    resolved.select(record_text().alias("value")).write.option("lineSep", _CRLF).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _parse(data: bytes) -> Iterator[tuple]:
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data), 1 << 20)
    while line := stream.readline():
        if not line.strip():
            continue
        if not re.fullmatch(rb"WARC/1\.[01]\r?\n", line):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            head[name.lower()] = value.strip()
        left, sha, size = int(head["content-length"]), hashlib.sha1(), 0
        while left:
            part = stream.read(min(left, 1 << 20))
            if not part:
                raise ValueError("the archive ends within a record")
            sha.update(part)
            size, left = size + len(part), left - len(part)
        response = head["warc-type"] == "response"
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
        if response and digest != base64.b32encode(sha.digest()).decode():
            raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
        page = head.get("x-page-id")
        yield page and int(page), head.get("warc-target-uri"), head["warc-record-id"], head["warc-type"], size if response else None, digest, head.get("warc-refers-to")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Header fields of all records; payloads of responses are read and held against their digests."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in _RECORD.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for row in _parse(content.as_py()):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(parse, _RECORD)


def resolve_read(records: DataFrame, scratch: Scratch) -> DataFrame:
    """Records of an archive set with the payload length and page of each revisit's original, joined by record id."""
    records = scratch.table(records, "read")
    asked = records.where("refers_to_record is not null").select(F.col("refers_to_record").alias("record_id")).distinct()
    originals = records.where("record_type = 'response'").join(asked, "record_id", "left_semi")
    originals = scratch.table(originals.select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("original_bytes")), "responses")
    out = records.join(originals, "refers_to_record", "left")
    return out.select("page_id", F.coalesce("payload_bytes", "original_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url", "record_id")


def deduplicated_archives(spark: SparkSession, pages: DataFrame, min_payload_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` as deduplicated archives and returns what reading them back gives."""
    with Scratch(spark) as scratch:
        path = scratch.path("archives")
        records = with_headers(pages, scratch)
        size = records.agg(F.avg("payload_bytes")).first()[0] or 0  # one row
        write_archives(resolve(records, scratch, min_payload_bytes), path, max(1, int(FILE_BYTES / (size + 500))))
        return scratch.keep(resolve_read(read_archives(spark, path), scratch))
