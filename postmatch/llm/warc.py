"""WARC archives: writing, reading back, and revisit resolution by payload digest.

Archives are text files in UTF-8 whose records end with an empty line pair, which is the WARC record
separator, so Spark's own text writer (with its commit protocol) produces them on any file system.
Reading goes by Content-Length, so payloads may hold any line breaks.

Defined cases: a null payload is empty; a null id is kept, stands after all ids and is never the record
others refer to; of repeated rows with the smallest id of a payload each is a response; a null address
becomes the record's own urn; columns other than the three named are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmatch.llm.common import shared_folder

END = "\r\n"
CAPTURED = "2026-01-01T00:00:00Z"
MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 32 << 20

HEADERS = "page_id long, url string, payload_bytes long, payload_digest string"
RECORD = "page_id long, record_type string, refers_to long, url string, payload_digest string, payload_bytes long, intact boolean, payload string"


def headers_of(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page with the size and SHA-256 of its UTF-8 payload, and the payload itself."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    return pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload.cast("binary"), 256).alias("payload_digest"),
        payload.alias("payload"),
    )


def resolve_revisits(records: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Adds record_type and refers_to.

    Only (digest, smallest id) of payloads that occur more than once travels as the lookup side; it is
    aggregated before its shuffle. AQE splits a digest that holds a large share of the records.
    """
    own = records.filter(F.col("payload_bytes") >= least).groupBy("payload_digest")
    owners = own.agg(F.min("page_id").alias("_owner"), F.count(F.lit(1)).alias("_n"))
    owners = owners.filter((F.col("_n") > 1) & F.col("_owner").isNotNull()).drop("_n")
    again = F.coalesce(F.col("page_id") > F.col("_owner"), F.col("_owner").isNotNull())
    again = again & (F.col("payload_bytes") >= least)
    return records.join(owners, "payload_digest", "left").select(
        *records.columns,
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(again, F.col("_owner")).alias("refers_to"),
    )


def _urn(page_id):
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_archives(records: DataFrame, path: str, records_per_archive: int = 0) -> None:
    """One WARC/1.1 record per row; a revisit carries headers only. A task begins a new archive after so many records."""
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(END * 2),
    )
    own = _urn(F.col("page_id"))
    target = F.regexp_replace(F.coalesce("url", F.regexp_replace(own, "[<>]", "")), r"[\x00-\x20\x7f]+", "%20")
    head = F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: "), F.col("record_type"),
        F.lit(f"{END}WARC-Record-ID: "), own,
        F.lit(f"{END}WARC-Date: {CAPTURED}{END}WARC-Target-URI: "), target,
        F.lit(f"{END}WARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.when(revisit, F.concat(
            F.lit(f"{END}WARC-Refers-To: "), _urn(F.col("refers_to")),
            F.lit(f"{END}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        )).otherwise(F.lit("")),
        F.lit(f"{END}Content-Type: application/http; msgtype=response{END}Content-Length: "),
        (F.octet_length(http) + F.octet_length(body)).cast("string"),
        F.lit(END * 2),
    )
    text = records.select(F.concat(head, http, body).alias("value"))
    text.write.option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_archive).text(path)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split(END)
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _page(urn: str) -> int | None:
    digits = urn.rpartition(":")[2].rstrip(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def parse_archive(data: memoryview | bytes) -> Iterator[tuple]:
    """Records of one archive in RECORD's order; `intact` tells whether the stored payload has its digest."""
    data, at, gap = bytes(data), 0, (END * 2).encode()
    while at < len(data):
        cut = data.index(gap, at)
        fields = _fields(data[at:cut])
        start = cut + len(gap)
        end = start + int(fields["content-length"])
        block_cut = data.index(gap, start)
        http = _fields(data[start:block_cut])
        payload = data[block_cut + len(gap) : end]
        kind = fields["warc-type"]
        digest = fields["warc-payload-digest"].removeprefix("sha256:")
        if kind == "response":
            size, good = len(payload), hashlib.sha256(payload).hexdigest() == digest
        else:
            size, good = int(http["content-length"]), True
        yield (
            _page(fields["warc-record-id"]), kind, _page(fields.get("warc-refers-to", "")), fields["warc-target-uri"],
            digest, size, good, payload.decode("utf-8") if kind == "response" else None,
        )
        at = end + len(gap)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Rows of RECORD from all archives below a path. A folder without archives gives no rows."""
    import zlib

    schema = RECORD if with_payload else RECORD.removesuffix(", payload string")
    names = [part.split()[0] for part in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    kinds = [types[part.split()[1]] for part in schema.split(", ")]

    def batches(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in files:
            for content in batch.column("content"):
                raw = zlib.decompress(content.as_buffer(), 47)
                rows, size = [], 0
                for row in parse_archive(raw):
                    rows.append(row[: len(names)])
                    size += row[5]
                    if size > 8 << 20 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("content")
    return files.mapInArrow(batches, schema)


def expand_revisits(records: DataFrame) -> DataFrame:
    """Revisits joined to the responses they refer to: size of the full payload and whether it is stored intact."""
    originals = records.filter(F.col("record_type") == "response").groupBy(
        F.col("page_id").alias("refers_to"), "payload_digest"
    ).agg(F.max("payload_bytes").alias("_bytes"), F.min("intact").alias("_intact"))
    joined = records.join(originals, ["refers_to", "payload_digest"], "left")
    return joined.select(
        "page_id", F.coalesce("_bytes", "payload_bytes").alias("payload_bytes"), "payload_digest", "record_type",
        "refers_to", F.coalesce("_intact", (F.col("record_type") == "response") & F.col("intact")).alias("intact"),
    )


def archive_round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Deduplicated archives of all pages, written to the shared folder and read back."""
    spark = pages.sparkSession
    records = resolve_revisits(headers_of(pages))
    size = pages.select(F.avg(F.octet_length(F.col("html").cast("string")) + 600).alias("n")).first()["n"] or archive_bytes
    path = shared_folder(spark)
    write_archives(records, path, max(1, math.ceil(archive_bytes / size)))
    return expand_revisits(read_archives(spark, path, with_payload=False))
