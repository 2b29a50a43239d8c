"""Archives: exact round trip and revisit resolution."""

import gzip
import hashlib

from postmatch.llm import warc
from postmatch.llm.common import shared_folder

SCHEMA = "page_id long, url string, html string"


def test_round_trip_of_odd_payloads(spark, tmp_path):
    long = "x" * 100
    rows = [
        (1, "http://a/ b", "plain"), (2, None, None), (3, "u", ""), (4, "u", long), (5, "u\r\nX: y", long), (None, "u", long),
        (6, "u", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n" * 20), (7, "u", "é" * 50 + "\r\n\r\n"), (8, "u", "plain"), (4, "v", long),
        (9, "u", "y" * 300_000), (10, "u", "y" * 300_000),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'c' as payload", "'c' as record_type", "'c' as _owner")
    records = warc.resolve_revisits(warc.headers_of(df))
    path = shared_folder(spark)
    warc.write_archives(records, path, 3)
    back = warc.read_archives(spark, path)
    stored = {(r["page_id"], r["payload"]) for r in back.collect() if r["record_type"] == "response"}
    assert (7, "é" * 50 + "\r\n\r\n") in stored and (6, rows[6][2]) in stored and (2, "") in stored
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], r["intact"]) for r in warc.archive_round_trip(df).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    revisits = {(5, 4), (None, 4), (10, 9)}
    want = {
        (p, "revisit" if (p, r) in revisits else "response", r if (p, r) in revisits else None, len((h or "").encode()), sha(h), True)
        for p, _, h in rows for r in [4 if h == long else 9 if p == 10 else None]
    }
    assert got == want


def test_archives_are_plain_warc(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/", "z" * 120), (2, "http://b/", "z" * 120)], SCHEMA)
    path = shared_folder(spark)
    warc.write_archives(warc.resolve_revisits(warc.headers_of(df)).coalesce(1), path)
    names = [r["path"].removeprefix("file:") for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path").collect()]
    text = b"".join(gzip.open(n).read() for n in names)
    assert text.count(b"WARC/1.1\r\n") == 2 and text.endswith(b"\r\n\r\n") and text.count(b"z" * 120) == 1
    assert b"WARC-Refers-To: <urn:page:1>" in text


def test_empty_table(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
