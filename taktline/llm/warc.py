"""WARC archives of page captures: written by Spark, read back, assembled by concurrent-to identifiers.

A capture is three records: request, response (or revisit) and metadata. The text writer puts each record on its own
"line" whose separator is the end mark of a WARC record, so that archives go through Spark's own file commit to any
store; each file is one gzip stream with a bounded number of records. Reading follows Content-Length and never looks for
a mark inside a payload. Assembly groups the records of one capture by the identifier they are concurrent to and gives
one nested row.

Of payloads of at least ``MIN_REVISIT`` bytes that are equal (SHA-1), the capture with the largest page_id is the
response; the others are revisits without payload. The response of a revisit is found by its payload digest.

Defined cases: a null html is an empty payload; a null page_id or url stays null (both travel in the metadata record,
so that any characters survive) and a null page_id is never a revisit's response unless all are null; equal rows are
captures of their own, and all rows with the largest page_id are responses; an empty table gives archives without
records and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taktline.llm import chunks as C
from taktline.workspace import Workspace

MIN_REVISIT = 1000
RECORDS_PER_FILE = 3000
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
RECORDS = "record_id string, concurrent_to string, kind string, target string, page_id long, url string, payload_bytes long, payload_digest string, payload binary"


def _urn(kind: str, key: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat(F.lit(kind), key)), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: Column | str, urn: Column, to: Column | None, content: str, block: Column, *more: Column) -> Column:
    lines = [F.lit("WARC/1.1\r\nWARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit("\r\nWARC-Record-ID: "), urn, F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.col("_target")]
    if to is not None:
        lines += [F.lit("\r\nWARC-Concurrent-To: "), to]
    return F.concat(*lines, *more, F.lit(f"\r\nContent-Type: {content}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def write_archives(pages: DataFrame, path: str) -> None:
    """Three records per row of (page_id, url, html) below ``path``."""
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    page = page.withColumns({"_digest": F.sha1("html"), "_bytes": F.octet_length("html")})
    several = (
        page.filter(F.col("_bytes") >= MIN_REVISIT).select("_digest", "page_id")
        .groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"), F.max("page_id").alias("_keeper")).filter("_n > 1").drop("_n"))
    page = page.join(several, "_digest", "left").withColumn("_again", (F.col("_bytes") >= MIN_REVISIT) & F.col("_keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_keeper")))
    page = page.withColumn("_key", F.concat_ws("/", F.monotonically_increasing_id().cast("string"), F.col("page_id").cast("string")))
    page = page.withColumn("_target", F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7f]+", "%20"))
    urn = _urn("capture", F.col("_key"))
    digest = F.concat(F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("_digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit(END))
    profile = F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    main = F.when(F.col("_again"), _record("revisit", urn, None, "application/http;msgtype=response", http, digest, profile)).otherwise(
        _record("response", urn, None, "application/http;msgtype=response", F.concat(http, F.col("html")), digest))
    get = F.concat(F.lit("GET "), F.col("_target"), F.lit(" HTTP/1.1" + END))
    about = F.to_json(F.struct("page_id", "url", F.col("_bytes").alias("payload_bytes")))
    records = F.array(
        _record("request", _urn("request", F.col("_key")), urn, "application/http;msgtype=request", get), main,
        _record("metadata", _urn("metadata", F.col("_key")), urn, "application/json", about))
    (page.select(F.explode(records).alias("value")).write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one uncompressed archive; a broken archive is an error."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        stop = end + 4 + int(headers["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where it says")
        yield headers, data[end + 4 : stop]
        at = stop + 4


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record. Sizes and digests of responses are taken from the payload that was read."""
    schema = C.arrow_schema(RECORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for headers, block in parse(zlib.decompress(content.as_buffer(), 47)):
                    row = {"record_id": headers["WARC-Record-ID"], "concurrent_to": headers.get("WARC-Concurrent-To"), "kind": headers["WARC-Type"], "target": headers.get("WARC-Target-URI")}
                    if row["kind"] == "metadata":
                        told = json.loads(block)
                        row |= {"page_id": told.get("page_id"), "url": told.get("url"), "payload_bytes": told["payload_bytes"]}
                    elif row["kind"] == "revisit":
                        row["payload_digest"] = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    elif row["kind"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        row |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "payload": payload if payloads else None}
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: main record, request, metadata; any but the main one may be missing."""
    part = F.struct("kind", "record_id", "target", "page_id", "url", "payload_bytes", "payload_digest", "payload")
    one = lambda *kinds: F.first(F.when(F.col("kind").isin(*kinds), part), ignorenulls=True)
    return (
        records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture"))
        .agg(one("response", "revisit").alias("main"), one("request").alias("request"), one("metadata").alias("metadata"))
        .filter("main IS NOT NULL"))


def resolved(found: DataFrame) -> DataFrame:
    """Captures with the page that each revisit refers to."""
    row = found.select(
        F.col("metadata.page_id").alias("page_id"), F.coalesce("main.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"),
        F.col("main.payload_digest").alias("payload_digest"), F.col("main.kind").alias("record_type"))
    wanted = row.filter("record_type = 'revisit'").select("payload_digest").distinct()
    full = (
        row.filter((F.col("record_type") == "response") & (F.col("payload_bytes") >= MIN_REVISIT)).join(wanted, "payload_digest", "left_semi")
        .groupBy("payload_digest").agg(F.max("page_id").alias("_response")))
    out = row.join(full, "payload_digest", "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", F.col("_response")).alias("refers_to"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through archives and back."""
    pages = C.table(spark, sf_dir, "pages")
    store = Workspace(spark)
    path = f"{store.folder}/archives"
    write_archives(pages, path)
    found = captures(read_records(spark, path, payloads=False))
    return resolved(store.keep(found, "captures"))


SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p),
j AS (SELECT *, payload_bytes >= {MIN_REVISIT} AND top IS DISTINCT FROM page_id AS again FROM k)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN top END AS refers_to
FROM j
"""

QUERIES = {"op9_warc": op9_warc}
ORACLES = {"op9_warc": SQL}
