import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ragmill.operators import memory as M
from ragmill.operators.ingest import auxiliary_chunks, sections
from ragmill.sources import readers as S
from ragmill.streaming import jobs as X


def test_manifest(spark, tmp_path):
    for n in ("b.pdf", "a.pdf", "x.txt"):
        (tmp_path / n).write_bytes(n.encode())
    got = S.manifest(spark, str(tmp_path)).collect()
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["a.pdf", "b.pdf"] and len(got[0].sha256) == 64
    assert S.manifest(spark, str(tmp_path), most=1).count() == 1
    with pytest.raises(FileNotFoundError):
        S.manifest(spark, str(tmp_path), "*.doc")


PAGES = [
    [{"type": "title", "text_level": 1, "title_content": [{"type": "text", "text": "1 Intro"}]}, {"type": "text", "text": "body one"}, {"type": "header", "text": "noise"}],
    [{"type": "title", "text_level": 2, "text": "1.1 Data"}, {"type": "paragraph", "paragraph_content": [{"type": "text", "content": "a"}, {"type": "text", "content": "b"}]}, {"type": "table", "table_caption": [{"type": "text", "text": "T1"}], "table_body": "<table><tr><td>参数</td><td>值</td></tr><tr><td>温度</td><td>600</td></tr></table>"}, {"type": "image", "image_caption": [{"type": "text", "text": "图 1 装置"}]}],
]


def test_layout(spark):
    flat = [{**b, "page_idx": i} for i, p in enumerate(PAGES) for b in p]
    middle = {"pdf_info": [{"page_idx": i, "para_blocks": p} for i, p in enumerate(PAGES)]}
    docs = spark.createDataFrame([("a", "pages", json.dumps(PAGES)), ("a", "flat", "[]"), ("b", "flat", json.dumps(flat)), ("c", "middle", json.dumps(middle))], "doc_id string, variant string, json string")
    text, tables, captions = S.route_blocks(S.layout_blocks(docs))
    for d in "abc":
        lines = [(r.page_number, r.line, r.level) for r in text.where(F.col("doc_id") == d).orderBy("page_number", "pos").collect()]
        assert lines == [(1, "1 Intro", 1), (1, "body one", None), (2, "1.1 Data", 2), (2, "a b", None)]
    assert {r.title for r in tables.collect()} == {"T1"} and tables.first().rows == [["参数", "值"], ["温度", "600"]] and captions.count() == 3
    s = sections(text.where("doc_id = 'a'"), F.col("level")).orderBy("section_no").collect()
    assert [(r.path, r.text) for r in s] == [(["1 Intro"], "body one"), (["1 Intro", "1.1 Data"], "a b")]
    aux = auxiliary_chunks(tables, captions)
    assert sorted(r.chunk_type for r in aux.where("doc_id = 'a'").collect()) == ["figure_caption", "table"]
    assert S.layout_blocks(docs, 1).where("page_number > 1").count() == 0


def test_layout_of_any_depth(spark):
    deep = {"type": "text", "text": "end"}
    for _ in range(30):
        deep = {"type": "text", "content": [deep, 7, None, {"other": "x"}]}
    pages = [[{"type": "paragraph", "paragraph_content": [{"content": [deep, "<b>bold</b> text"]}]}, {"type": "image", "text": "", "chart_caption": [[{"caption": [{"text": "图 2"}]}]]}, {"block_type": "Title", "level": 9, "title_content": [], "text": "T"}, {"type": "table", "table_body": None, "html": "<table><tr><td>a</td></tr></table>"}, {"type": "text", "text": [], "content": None}]]
    rows = [("a", "pages", json.dumps(pages)), ("b", "pages", "{oops"), ("c", "flat", "{}"), ("d", "middle", None), ("e", "pages", '[[1, "x"], 5]')]
    text, tables, captions = S.route_blocks(S.layout_blocks(spark.createDataFrame(rows, "doc_id string, variant string, json string")))
    assert [(r.line, r.level) for r in text.where("doc_id = 'a'").orderBy("pos").collect()] == [("end" + " 7" * 30 + " bold text", None), ("T", 6)]
    assert [r.rows for r in tables.collect()] == [[["a"]]] and [r.caption for r in captions.collect()] == ["图 2"]
    assert text.where("doc_id <> 'a'").count() == 0


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"case_id": "a", "n": 1}\n\n# note\n{"case_id": "b"}\n')
    df = S.read_jsonl(spark, str(tmp_path / "x.jsonl"), "case_id string, n int")
    assert sorted(r.case_id for r in df.collect()) == ["a", "b"]
    S.write_jsonl(df, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"case_id":"a","n":1}', '{"case_id":"b"}']
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception):
        S.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "case_id string").collect()


def test_web_results_and_chunks(spark, tmp_path):
    body = {"query": "q", "answer": "ans", "results": [{"title": "t", "url": "u", "content": "c", "score": 0.5, "lang": "en"}, {"url": "v", "raw_content": "raw", "content": "c"}]}
    r = S.web_results(spark.createDataFrame([(1, json.dumps(body)), (2, '{"results": []}')], "query_id int, json string")).orderBy("query_id", "result_no").collect()
    assert (r[0].text, r[0].score, r[0].extra) == ("c", 0.5, {"lang": "en"}) and (r[1].text, r[1].score) == ("raw", 0.0) and r[2].result_no is None
    S.write_chunks(spark.createDataFrame([("1", None), ("2", "deleted")], "chunk_id string, status string"), str(tmp_path / "c"))
    assert {(r.chunk_id, r.status, r.content_hash) for r in spark.read.parquet(str(tmp_path / "c")).collect()} == {("1", "active", ""), ("2", "deleted", "")}
    p = spark.createDataFrame([("a", "x", ["1", "2"])], "case_id string, answer string, contexts array<string>")
    s = spark.createDataFrame([("a", 0.5)], "case_id string, overall double")
    c = spark.createDataFrame([("a", ["k", "l"], {}), ("b", [], {})], "case_id string, keywords array<string>, metadata map<string,string>")
    got = {r.case_id: r for r in S.review_table(c, p, s).collect()}
    assert got["a"].contexts == "1\n---\n2" and got["a"].keywords == "k；l" and got["b"].answer is None


def test_traces(spark, tmp_path):
    d = tmp_path / "2024-05-01"
    d.mkdir()
    (d / "t1.json").write_text(json.dumps({"trace_id": "t1", "start_time": "2024-05-01T00:00:00", "steps": [{"step_id": 1, "step_type": "a", "status": "success", "latency_ms": 3}]}, indent=1))
    r = S.read_traces(spark, str(tmp_path)).first()
    assert (r.trace_id, r.date, r.steps[0].latency_ms) == ("t1", "2024-05-01", 3)


def test_ingest_stream(spark, tmp_path):
    schema = "chunk_id string, doc_id string, content_hash string, text string"
    src, table = str(tmp_path / "in"), f"file://{tmp_path}/table"
    steps = [[("1", "a", "h1", "x"), ("2", "b", "k1", "y")], [("1", "a", "h1", "again"), ("3", "b", "k2", "new"), ("4", "c", "q", "z")]]
    for batch in steps:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        q = X.ingest_stream(spark.readStream.schema(schema).parquet(src), table, str(tmp_path / "cp"))
        q.awaitTermination()
    now = X.read_version(spark, table, 9)
    assert {(r.chunk_id, r.text, r.status) for r in now.collect()} == {("1", "x", "active"), ("2", "y", "deleted"), ("3", "new", "active"), ("4", "z", "active")}


def test_ingest_stream_writes_changes_only(spark, tmp_path):
    schema = "chunk_id string, doc_id string, content_hash string, text string"
    src, table = str(tmp_path / "in"), f"file://{tmp_path}/table"
    assert X.read_version(spark, table, 3) is None
    for batch in ([(str(i), str(i), "h", "x") for i in range(50)], [("7", "7", "h", "x"), ("60", "7", "k", "y"), ("8", "8", "h", "again")], [("61", "7", "k", "y")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        X.ingest_stream(spark.readStream.schema(schema).parquet(src), table, str(tmp_path / "cp")).awaitTermination()
    written = {r.version: r.n for r in spark.read.parquet(table).groupBy("version").agg(F.count("*").alias("n")).collect()}
    assert written == {0: 50, 1: 2}
    assert {(r.chunk_id, r.status) for r in X.read_version(spark, table, 2).where("doc_id = '7'").collect()} == {("7", "deleted"), ("7", "active"), ("60", "active")}


def test_memory_job(spark, tmp_path):
    df, stream = stream_messages(spark, tmp_path)
    table = f"file://{tmp_path}/memories"
    X.memory_job(stream, table, str(tmp_path / "cp3")).awaitTermination()
    got = [(r.user_id, r.content) for r in spark.read.parquet(table).collect()]
    assert len(got) == len(set(got)) and ("u", "用户偏好：以后默认用中文回答") in got
    df.coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
    X.memory_job(stream, table, str(tmp_path / "cp3")).awaitTermination()
    assert sorted((r.user_id, r.content) for r in spark.read.parquet(table).collect()) == sorted(got)


def test_report_outputs(spark, tmp_path):
    from ragmill.operators import catalog as C
    from ragmill.operators.index import preview

    audit = spark.createDataFrame([("a", 1), (None, 2)], "doc_id string, n int")
    C.write_audit(audit, str(tmp_path / "audit"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "audit" / "markdown")).collect()]
    assert lines == ["| doc_id | n |", "|---|---|", "|  | 2 |", "| a | 1 |"]
    assert spark.read.json(str(tmp_path / "audit" / "json")).count() == 2
    assert spark.range(1).select(preview(F.lit("a\x00b\tc\x85d")).alias("p")).first().p == "ab\tcd"


def stream_messages(spark, tmp_path):
    t = lambda i: dt.datetime(2024, 1, 1, 0, i)
    rows = [("s", 0, "user", "请修改代码 不要删除文件", t(0), "u"), ("s", 1, "assistant", "好", t(1), "u"), ("s", 2, "user", "以后默认用中文回答。不要删除文件", t(2), "u"), ("t", 3, "user", "以后默认用中文回答", t(3), "u"), ("t", 4, "user", "部署它", t(4), "u")]
    df = spark.createDataFrame(rows, "session_id string, message_id int, role string, content string, created_at timestamp, user_id string")
    df.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "m"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "m"))


def test_session_stream_equals_batch(spark, tmp_path):
    batch, stream = stream_messages(spark, tmp_path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = X.session_stream(stream).writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    got = {r.session_id: (r.current_goal, r.current_step, r.constraints) for r in spark.table("states").collect()}
    want = {r.session_id: (r.current_goal, r.current_step, r.constraints) for r in M.session_state(batch).collect()}
    assert got == want


def test_memory_stream(spark, tmp_path):
    _, stream = stream_messages(spark, tmp_path)
    q = X.memory_stream(stream).writeStream.format("memory").queryName("mem").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination()
    got = sorted(r.content for r in spark.table("mem").collect())
    assert got.count("用户偏好：以后默认用中文回答") == 1 and "约束：不要删除文件" in got
