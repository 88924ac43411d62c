import base64
import hashlib

import pytest

from ragmill.llm.common import new_path
from ragmill.llm.warc import parse_record, read_archive, record_bytes, records, write_archive

SCHEMA = "page_id long, url string, html string, sha256 string, header string"


def rows():
    body = ["<p>é</p>", "", None, "b" * 300_000, "<p>\r\n\r\nWARC/1.1</p>"]
    out = [(i, f"http://x/{i}", body[i % 5] if i % 3 else f"only {i}", "", "") for i in range(60)]
    return out + [(3, "http://x/3", "only 3", "", ""), (100, None, "u", "", ""), (101, "a\r\nb", "u", "", ""), (None, "n", "lonely", "", "")]


def want(data):
    first = {}
    for i, _, h, *_ in data:
        h = h or ""
        if i is not None or h not in first:
            first[h] = i if first.get(h) is None else min(i, first[h])
    out = []
    for i, _, h, *_ in data:
        b = (h or "").encode()
        f = first[h or ""]
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == f else "revisit", None if i == f else f))
    return sorted(out, key=str)


def test_round_trip(spark):
    data, path = rows(), new_path(spark, "archive")
    write_archive(spark.createDataFrame(data, SCHEMA), path)
    got = [tuple(r) for r in read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == want(data)
    distinct = len({h or "" for _, _, h, *_ in data})
    assert spark.read.parquet(f"{path}/payloads").count() == distinct
    import zlib

    for r in records(spark, path).collect():
        fields, block = parse_record(record_bytes(r.header, zlib.decompress(r.payload)))
        assert len(block) == int(fields["Content-Length"]) and fields["WARC-Record-ID"].startswith("<urn:x-page:")


def test_small_payloads_can_be_exempt(spark):
    path = new_path(spark, "archive")
    write_archive(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long one"), (4, "u", "long one")], "page_id long, url string, html string"), path, min_revisit=5)
    assert sorted((r.page_id, r.record_type) for r in read_archive(spark, path).collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_empty_and_damaged(spark):
    path = new_path(spark, "archive")
    write_archive(spark.createDataFrame([], SCHEMA), path)
    assert read_archive(spark, path).count() == 0
    path = new_path(spark, "archive")
    write_archive(spark.createDataFrame([(1, "u", "ab", "", "")], SCHEMA), path)
    bad = spark.read.parquet(f"{path}/payloads").selectExpr("sha256", "unhex(hex('junk')) payload")
    bad = bad.collect()
    spark.createDataFrame(bad, "sha256 string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception):
        read_archive(spark, path).collect()


def test_hot_payload_travels_once(spark):
    path, body = new_path(spark, "archive"), "x" * 50_000
    rows = [(i, f"http://x/{i}", body if i % 3 else f"own {i}", "", "") for i in range(900)]
    write_archive(spark.createDataFrame(rows, SCHEMA).repartition(6), path)
    assert spark.read.parquet(f"{path}/payloads").count() == 301
    held = {r.page_id: len(r.payload) for r in records(spark, path).collect() if r.revisit}
    assert len(held) == 599 and max(held.values()) < 16
    got = [tuple(r) for r in read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == want(rows)


def test_lost_payload_and_lost_response(spark):
    path = new_path(spark, "archive")
    write_archive(spark.createDataFrame([(1, "u", "ab", "", ""), (2, "u", "ab", "", ""), (3, "u", "cd", "", "")], SCHEMA), path)
    headers, payloads = (spark.read.parquet(f"{path}/{t}").collect() for t in ("headers", "payloads"))
    for lost, table in ((1, "headers"), (3, "payloads")):
        broken = new_path(spark, "archive")
        digest = next(r.sha256 for r in headers if r.page_id == lost)
        keep = [r for r in headers if table != "headers" or r.page_id != lost]
        spark.createDataFrame(keep, "page_id long, sha256 string, revisit boolean, header string").write.parquet(f"{broken}/headers")
        rest = [r for r in payloads if table != "payloads" or r.sha256 != digest]
        spark.createDataFrame(rest, "sha256 string, payload binary").write.parquet(f"{broken}/payloads")
        with pytest.raises(Exception):
            read_archive(spark, broken).collect()
