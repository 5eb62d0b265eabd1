"""Operator 7: WARC archives that store equal payloads once.

Payloads are grouped by SHA-256 and compared byte by byte; the page with the
smallest id is a response record, the others revisit it. So the archives are
the store of payloads, each once, named by its digest; the exact headers of all
records are also a table of their own, and a join of both by digest gives back
every record. Archives are written by Spark's text writer: a record is text in
UTF-8, and the two line ends that close it are the writer's line separator. A
reader takes records by their content lengths and verifies their digests.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import group_copies, sha256
from .scratch import Scratch
from .tokens import per_batch

#: Bytes of records from which on an archive is closed; a larger record has one of its own.
ARCHIVE_BYTES = 8_000_000
DATE = "2024-01-01T00:00:00Z"

_RECORD = "archive string, page_id bigint, record_type string, refers_to bigint, digest string, headers string, payload binary"


def _record_id(page_id: Column, row: Column | None = None) -> Column:
    """A response is named by its payload's digest and its page, which no other response shares; a revisit also by its row."""
    parts = [F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), F.col("digest")]
    return F.concat(*parts, *([F.lit(":"), row.cast("string")] if row is not None else []), F.lit(">"))


def _headers() -> Column:
    """The headers of a record with the line that ends them."""
    revisit = F.col("record_type") == "revisit"
    url = F.col("url")
    for mark, code in (("\r", "%0D"), ("\n", "%0A")):
        url = F.replace(url, F.lit(mark), F.lit(code))
    head = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: "), F.when(revisit, _record_id(F.col("page_id"), F.col("row"))).otherwise(_record_id(F.col("page_id")))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit(""))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "sha1"),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _record_id(F.col("keep_id")))),
        F.concat(F.lit("X-Payload-SHA256: "), "digest"),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length("body").cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *head), F.lit("\r\n\r\n"))


def write_archives(pages: DataFrame, path: str, scratch: Scratch) -> None:
    """Write a record for each row of ``pages(page_id, url, html)``: archives to ``path``/records, exact headers to ``path``/headers.

    A null html counts as empty. Of rows that agree in id and payload one is
    the response. Line ends in a url are percent-encoded. A null ``page_id``
    gives a record without a page; it is a response only where all of its group
    lack one. Other columns are not read; an empty table gives no records.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    groups = group_copies(rows.select(F.col("page_id").alias("id"), F.col("html").cast("binary").alias("payload")), keep="min", scratch=scratch)
    copies = scratch.write(groups.where("n > 1").groupBy("digest", "id", "keep_id").agg(F.count(F.lit(1)).alias("_times")), "copies")

    keyed = rows.withColumn("digest", sha256(F.col("html").cast("binary"))).withColumn("row", F.monotonically_increasing_id())
    of_group = copies.select(F.col("digest").alias("_d"), F.col("id").alias("_id"), "keep_id", "_times")
    typed = keyed.join(of_group, (F.col("digest") == F.col("_d")) & F.col("page_id").eqNullSafe(F.col("_id")), "left")
    first = F.col("_times").isNull() | F.col("page_id").eqNullSafe(F.col("keep_id"))
    typed = typed.withColumn("record_type", F.when(first, "response").otherwise("revisit"))
    repeated = copies.where("id <=> keep_id AND _times > 1")
    if not repeated.isEmpty():  # rows that agree in id and payload: the first of them is the response
        typed = scratch.write(typed, "typed")
        lead = typed.where("record_type = 'response' AND _times > 1").groupBy("digest").agg(F.min("row").alias("_lead"))
        typed = typed.join(lead.withColumnRenamed("digest", "_l"), F.col("digest") == F.col("_l"), "left")
        typed = typed.withColumn("record_type", F.when(F.col("_lead").isNotNull() & (F.col("row") != F.col("_lead")), "revisit").otherwise(F.col("record_type")))
    body = F.when(F.col("record_type") == "response", F.col("html")).otherwise("")
    typed = typed.withColumn("sha1", F.col("html"))

    def base32(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests = [base64.b32encode(hashlib.sha1(x or b"").digest()).decode() for x in batch.column("sha1").cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(digests)], names=batch.schema.names)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for x in batch.column("record").to_pylist():
                if held and size + len(x) > ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_pydict({"value": ["\r\n\r\n".join(held)]})
                    held, size = [], 0
                held.append(x)
                size += len(x)
        if held:
            yield pa.RecordBatch.from_pydict({"value": ["\r\n\r\n".join(held)]})

    typed = typed.select("page_id", "row", "record_type", "keep_id", "digest", "url", body.alias("body"), "sha1")
    typed = typed.mapInArrow(per_batch(base32), typed.schema)
    records = scratch.write(typed.select("digest", _headers().alias("headers"), "body"), "records")
    records.select("digest", "headers").write.option("compression", "zstd").parquet(f"{path}/headers")
    bundled = records.select(F.concat("headers", "body").alias("record")).mapInArrow(bundle, "value string")
    bundled.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", 1).option("compression", "gzip").text(f"{path}/records")
    scratch.drop("records")


def parse_archive(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Headers and payload of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        headers = data[at:end]
        length = int(headers.rpartition(b"\r\nContent-Length: ")[2])
        yield headers, data[end + 4 : end + 4 + length]
        at = end + 8 + length


def _fields(headers: str) -> dict[str, str]:
    return dict(x.partition(": ")[::2] for x in headers.split("\r\n"))


def _page(record_id: str) -> int | None:
    page = record_id.removeprefix("<urn:page:").partition(":")[0]
    return int(page) if page else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``archive, page_id, record_type, refers_to, digest, headers, payload``: a row for each record, a revisit's payload null.

    A payload that doesn't have the digests its headers name raises an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                columns: list[list] = [[] for _ in range(7)]
                for headers, payload in parse_archive(gzip.decompress(content)):
                    fields = _fields(headers.decode())
                    revisit = fields["WARC-Type"] == "revisit"
                    digest = fields["X-Payload-SHA256"]
                    if not revisit and (hashlib.sha256(payload).hexdigest() != digest or base64.b32encode(hashlib.sha1(payload).digest()).decode() != fields["WARC-Payload-Digest"][5:]):
                        raise ValueError(f"a payload in {name} is not the one that was stored: {fields['WARC-Record-ID']}")
                    to = _page(fields["WARC-Refers-To"]) if revisit else None
                    for column, x in zip(columns, (name, _page(fields["WARC-Record-ID"]), fields["WARC-Type"], to, digest, headers.decode(), None if revisit else payload), strict=True):
                        column.append(x)
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["archive", "page_id", "record_type", "refers_to", "digest", "headers", "payload"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(f"{path}/records").select("path", "content").mapInArrow(run, _RECORD)


def restore(spark: SparkSession, path: str) -> DataFrame:
    """``headers, payload`` of every record: the table of headers joined with the stored payloads by digest."""
    stored = read_archives(spark, path).where("record_type = 'response'").select("digest", "payload")
    headers = spark.read.schema("digest string, headers string").parquet(f"{path}/headers")
    return headers.join(stored, "digest").select("headers", "payload")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op7")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch.path("archives"), scratch)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        payloads = batch.column("payload").to_pylist()
        digests = [None if x is None else base64.b32encode(hashlib.sha1(x).digest()).decode() for x in payloads]
        arrays = [*(batch.column(x) for x in ("page_id", "record_type", "refers_to", "digest")), pa.array([None if x is None else len(x) for x in payloads], pa.int64()), pa.array(digests, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["page_id", "record_type", "refers_to", "digest", "n", "sha1"])

    found = read_archives(spark, scratch.path("archives")).mapInArrow(per_batch(measure), "page_id bigint, record_type string, refers_to bigint, digest string, n bigint, sha1 string")
    found = scratch.write(found, "found")
    # Only digests that are revisited go through the join.
    revisits = found.where("record_type = 'revisit'")
    stored = found.where("record_type = 'response'").select("digest", F.col("n").alias("_n"), F.col("sha1").alias("_sha1"))
    of_group = revisits.select("page_id", "record_type", "refers_to", "digest").join(stored, "digest").select("page_id", F.col("_n").alias("n"), F.col("_sha1").alias("sha1"), "record_type", "refers_to")
    out = found.where("record_type = 'response'").select("page_id", "n", "sha1", "record_type", "refers_to").unionByName(of_group)
    return out.select("page_id", F.col("n").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to")
