"""Whole session state and arriving files as streams, against their batch twins."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ragmill.operators import memory as M
from ragmill.streaming.documents import DocumentTable, document_stream, file_stream
from ragmill.streaming.sessions import EVENT, whole_state_stream


def events():
    rng = random.Random(3)
    t = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)
    texts = ["请修改代码 不要删除文件", "以后默认用中文回答。不要删除文件", "部署它", "生成 报告", "必须 用表格", "看 看"]
    rows = [(f"s{rng.randrange(4)}", f"e{i:03}", "message", rng.choice(["user", "user", "assistant"]), rng.choice(texts) + f" {i % 9}", t(i)) for i in range(90)]
    rows += [(f"s{rng.randrange(4)}", f"r{i:03}", "result", None, f"result {i}", t(i)) for i in range(60)]
    rows += [("s1", "u1", "update", None, "new goal", t(200)), ("s1", "u0", "update", None, "older goal", t(150)), ("nobody", "u2", "update", None, "lost", t(3)), ("table", "r900", "result", None, "late table", t(1)), ("table", "u5", "update", None, "table goal", t(9))]
    return rows


def run(spark, tmp_path, parts, name, sessions=None, **params):
    src = str(tmp_path / f"in-{name}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = []
    for n, part in enumerate(parts):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(src)
        stream = whole_state_stream(spark.readStream.schema(EVENT).parquet(src), sessions, "10 days", **params)
        q = stream.writeStream.foreachBatch(lambda b, i: out.extend((n, i, r) for r in b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
        q.awaitTermination()
    return out


def test_whole_state_equals_batch(spark, tmp_path):
    rows = events()
    rng = random.Random(4)
    mixed = rows + rng.sample(rows, 40)  # repeated rows
    rng.shuffle(mixed)
    known = spark.createDataFrame([("table", "first goal", dt.datetime(2023, 12, 31)), ("quiet", "x", dt.datetime(2023, 12, 31))], "session_id string, current_goal string, updated_at timestamp")
    out = run(spark, tmp_path, [mixed[:70], mixed[70:120], mixed[120:]], "a", known)
    last = {r.session_id: r for _, _, r in out if r.status == "active"}
    assert {(r.session_id, r.rejected_id) for _, _, r in out if r.status == "rejected"} == {("nobody", "u2")}
    df = spark.createDataFrame([r for r in rows if r[2] == "message"], EVENT)
    batch = {r.session_id: r for r in M.session_state(df, order="event_id").collect()}
    for s in ("s0", "s1", "s2", "s3"):
        assert last[s].current_step == batch[s].current_step and last[s].constraints == batch[s].constraints
        assert last[s].current_goal == ("new goal" if s == "s1" else batch[s].current_goal)
        results = spark.createDataFrame([(1,)], "i int").select(F.array().cast("array<string>").alias("x"))
        for r in sorted((r for r in rows if r[0] == s and r[2] == "result"), key=lambda r: (r[5], r[1]))[-9:]:
            results = results.select(M.append_bounded(F.col("x"), F.lit(r[4])).alias("x"))
        assert last[s].results == results.first().x
    assert last["table"].current_goal == "table goal" and last["table"].results == ["late table"]


def test_sessions_end(spark, tmp_path):
    t = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    row = lambda s, i, d: (s, i, "message", "user", f"q {i}", t(d))
    out = run(spark, tmp_path, [[row("a", "1", 0), row("b", "2", 30)], [row("b", "3", 60)], [row("b", "4", 61)]], "b", ttl_ms=5 * 86_400_000)
    ended = [(r.session_id, r.current_goal) for _, _, r in out if r.status == "expired"]
    assert ("a", "q 1") in ended and [x for x in ended if x[0] == "a"] == [("a", "q 1")]


def lines(docs):
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).where("text <> ''").select("doc_id", F.concat_ws("-", "doc_id", "i").alias("chunk_id"), "text")


def test_arriving_files(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    root = f"file://{tmp_path}/table"
    steps = [{"a": "one\ntwo", "b": "x"}, {"c": "y\n\nz"}, {"skip": ""}]
    for n, step in enumerate(steps):
        for name, text in step.items():
            (folder / f"{name}.txt").write_text(text)
        (folder / f"{n}.bin").write_bytes(b"no text")
        document_stream(file_stream(spark, str(folder)), root, str(tmp_path / "cp"), lines, buckets=2).awaitTermination()
    got = {(r.doc_id, r.chunk_id, r.text) for r in DocumentTable(spark, root, buckets=2).chunks().collect()}
    assert got == {("a", "a-0", "one"), ("a", "a-1", "two"), ("b", "b-0", "x"), ("c", "c-0", "y"), ("c", "c-2", "z")}


def test_document_table(spark, tmp_path):
    rng = random.Random(1)
    table = DocumentTable(spark, f"file://{tmp_path}/t", buckets=4, most=2)
    state, kept = {}, {}
    for n in range(8):
        batch = {f"d{rng.randrange(12)}": rng.choice(["", f"line {n}\nmore", "same"]) for _ in range(4)}
        state |= batch
        table.apply(spark.createDataFrame([(k, str(hash(v)), v) for k, v in batch.items()], "doc_id string, content_hash string, text string"), lines, n)
        table.apply(spark.createDataFrame([("d1", "zz", "again")], "doc_id string, content_hash string, text string"), lines, n)
        kept[table.store.version] = {(k, x) for k, v in state.items() for x in v.split("\n") if x}
        assert max(map(len, table.store.buckets("chunks").values()), default=0) <= 2
    for version, want in kept.items():
        old = DocumentTable(spark, f"file://{tmp_path}/t", buckets=4, version=version)
        assert {(r.doc_id, r.text) for r in old.chunks().collect()} == want
