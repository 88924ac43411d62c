"""Content-addressed web archive: payload bytes once by digest, exact record headers apart, records by join."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.llm.common import materialize, new_path, tidy

DATE = "2024-01-01T00:00:00Z"
MIN_REVISIT = 0
#: Digests a task remembers, so as to deflate a payload once; what it forgets is dropped behind the shuffle.
HELD = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The base32 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32(sha1_hex: str):
    """Base32 of a SHA-1 in hex: five hex digits are four characters."""
    chars = []
    for g in range(8):
        v = F.conv(F.substring(sha1_hex, 5 * g + 1, 5), 16, 10).cast("int")
        chars += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*chars)


def write_archive(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, date: str = DATE) -> None:
    """Writes one WARC record per row of ``pages(page_id, url, html)`` as two tables under ``path``.

    ``headers``: page_id, sha256 of the payload, whether it is a revisit, and the exact WARC and HTTP header bytes. ``payloads``: sha256 and the
    payload, deflated, once per digest. The record with the smallest page_id of equal payloads of at least ``min_revisit``
    bytes is a response, others revisit it. Null html is an empty payload. Rows that repeat a page_id with the same payload
    are alike; a null page_id is written as empty and is response only where no equal payload has an id. Control characters
    in urls are percent-encoded, a null url gives no target header. An empty table
    gives an archive without records. Extra columns are ignored.
    """
    html = F.coalesce("html", F.lit(""))
    known = pages.select("page_id", "url", html.alias("html")).withColumn("sha256", F.sha2("html", 256))
    narrow = known.select("page_id", "url", "sha256", F.sha1("html").alias("sha1"), F.octet_length("html").cast("long").alias("n"))
    first = narrow.groupBy("sha256").agg(F.min("page_id").alias("first_id"))
    placed = narrow.join(first, "sha256").withColumn("revisit", (F.col("n") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("first_id")))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    lines = [
        F.lit("WARC/1.1"),
        F.when(F.col("revisit"), "WARC-Type: revisit").otherwise("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: "), urn("page_id")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), _base32("sha1")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), urn("first_id"))),
        F.when(F.col("revisit"), F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.when(F.col("revisit"), F.octet_length("http")).otherwise(F.octet_length("http") + F.col("n")).cast("string")),
    ]
    headers = placed.withColumn("http", http).select("page_id", "sha256", "revisit", F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), F.col("http")).alias("header"))
    headers.write.parquet(f"{path}/headers")

    def deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in batches:
            digests, packed = [], []
            for digest, body in zip(b.column(0).to_pylist(), b.column(1)):
                if digest not in seen:
                    if len(seen) == HELD:
                        seen.clear()
                    seen.add(digest)
                    digests.append(digest), packed.append(zlib.compress(body.as_py().encode(), 6))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(packed, pa.binary())], names=["sha256", "payload"])

    # equal digests are equal bytes, so any copy will do: a task sends a payload once, however often it holds it
    packed = known.select("sha256", "html").mapInArrow(tidy(deflate), "sha256 string, payload binary")
    packed.dropDuplicates(["sha256"]).write.option("compression", "none").parquet(f"{path}/payloads")


def records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, sha256, revisit, header, payload (deflated): the archive's records, each with the body it holds itself.

    Headers of responses are joined with the payload of their digest, null where the archive lacks it; a revisit has an
    empty body, so a payload travels to its response alone, however many records revisit it.
    """
    headers = spark.read.parquet(f"{path}/headers")
    responses = headers.where("not revisit").join(spark.read.parquet(f"{path}/payloads"), "sha256", "left")
    revisits = headers.where("revisit").withColumn("payload", F.lit(zlib.compress(b"")))
    return responses.unionByName(revisits).select("page_id", "sha256", "revisit", "header", "payload")


def record_bytes(header: str, payload: bytes) -> bytes:
    """The record as it stands in a WARC file: a revisit has headers only."""
    body = b"" if "\r\nWARC-Type: revisit\r\n" in header else payload
    return header.encode() + body + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """WARC header fields and the record's block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record length differs from its header")
    return fields, rest[:n]


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: each record rebuilt, parsed and verified.

    Responses are rebuilt with their payload, which gives its verified length and SHA-1, one narrow row a digest; revisits
    are joined with that row. Raises if a payload is missing or its SHA-256 differs from its address, a SHA-1 from a header,
    or a length from its record. An empty archive gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page_id, digest, header, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if not packed.is_valid:
                    raise ValueError(f"the archive lacks payload {digest} of page {page_id}")
                body = zlib.decompress(packed.as_py())
                fields, block = parse_record(record_bytes(header, body))
                kind, stated = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                _, _, payload = block.partition(b"\r\n\r\n")
                if payload != body:
                    raise ValueError(f"record of page {page_id} differs from its payload")
                if kind == "response":
                    if hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"payload differs from its digest {digest}")
                    if stated != base64.b32encode(hashlib.sha1(body).digest()).decode():
                        raise ValueError(f"record of page {page_id} states another digest than its payload's")
                refers = re.fullmatch(r"<urn:x-page:(.*)>", fields.get("WARC-Refers-To", ""))
                out.append((digest, len(body), stated, kind, refers[1] if refers else None))
            cols = list(zip(*out)) or [[]] * 5
            strings = [pa.array(c, pa.string()) for c in (cols[0], *cols[2:])]
            yield pa.RecordBatch.from_arrays([b.column(0), strings[0], pa.array(cols[1], pa.int64()), *strings[1:]], names=["page_id", "sha256", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    rows = records(spark, path).select("page_id", "sha256", "header", "payload")
    kind = rows.schema["page_id"].dataType.simpleString()
    parsed = materialize(rows.mapInArrow(tidy(run), f"page_id {kind}, sha256 string, payload_bytes long, payload_digest string, record_type string, refers_to string"), "records")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")]
    verified = parsed.where("record_type = 'response'").select("sha256", F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("sha1")).distinct()
    checked = F.when(F.col("sha1").isNull() | (F.col("sha1") != F.col("payload_digest")), F.raise_error(F.concat(F.lit("a revisit differs from the payload "), "sha256"))).otherwise(F.col("n"))
    revisits = parsed.where("record_type = 'revisit'").join(verified, "sha256", "left").withColumn("payload_bytes", checked)
    return parsed.where("record_type = 'response'").select(*out).unionByName(revisits.select(*out))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archive")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archive(spark, path)


WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', ((('0x' || substr(h, (i // 4 * 5 + 1)::INTEGER, 5))::BIGINT >> ((3 - i % 4) * 5)::INTEGER) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = min(page_id) OVER (PARTITION BY html) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> min(page_id) OVER (PARTITION BY html) THEN min(page_id) OVER (PARTITION BY html) END AS refers_to FROM p
"""
