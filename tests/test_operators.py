"""Small hand-made tables with exact expectations, one for each family of operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ragmill.functions.text import compress, key_hash, pick, terms, tokenize
from ragmill.operators import catalog as C
from ragmill.operators import detect as D
from ragmill.operators import evaluate as V
from ragmill.operators import evidence as E
from ragmill.operators import index as I
from ragmill.operators import ingest as N
from ragmill.operators import memory as M
from ragmill.operators import retrieve as R
from ragmill.operators import route as T
from ragmill.operators import traces as O


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, tokenize(F.col("t")), t="Hello, 火灾烟 C++ 疏。散 x1") == ["hello", "火", "灾", "烟", "c++", "疏", "散", "x1", "火灾", "灾烟", "疏散"]
    assert one(spark, tokenize(F.col("t")), t="") == []
    assert sorted(one(spark, terms(F.col("t")), t="火灾烟气 ab a 风")) == ["ab", "火灾", "火灾烟气", "灾烟", "烟气"]
    import hashlib

    assert one(spark, key_hash(F.lit("d"), F.lit("p"), F.lit("0"))) == hashlib.sha1(b"d|p|0").hexdigest()[:20]
    assert one(spark, pick(F.array(*map(F.lit, [0.1, 0.2, 0.3, 0.4])), 0.5)) == 0.3
    assert len(one(spark, compress(F.col("t"), 100), t="x" * 500)) == 72 + 5 + 20


def test_bm25_and_vectors(spark):
    docs = spark.createDataFrame([(1, "fire smoke fire"), (2, "smoke"), (3, "water")], "chunk_id long, text string")
    q = spark.createDataFrame([(9, "fire smoke"), (8, ""), (7, "nothing")], "query_id long, text string")
    got = [(r.query_id, r.chunk_id, r.score, r["rank"]) for r in R.bm25(q, docs).orderBy("rank").collect()]
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    sat = lambda tf, n: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / (5 / 3)))
    assert got == [(9, 1, round(idf(1) * sat(2, 3) + idf(2) * sat(1, 3), 6), 1), (9, 2, round(idf(2) * sat(1, 1), 6), 2)]
    v = I.hashed_dense(docs.unionByName(spark.createDataFrame([(4, "")], docs.schema)), 16).collect()
    assert all(abs(sum(x * x for x in r.vector) - (r.chunk_id != 4)) < 1e-9 for r in v)
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0])], "chunk_id long, vector array<double>")
    qv = spark.createDataFrame([(1, [1.0, 0.1])], "query_id long, vector array<double>")
    for metric, order in (("cosine", [1, 3, 2]), ("dot", [3, 1, 2]), ("euclid", [1, 3, 2]), ("manhattan", [1, 3, 2])):
        assert [r.chunk_id for r in R.dense(qv, vec, 3, metric, block_rows=1).orderBy("rank").collect()] == order
    assert R.dense(qv.limit(0), vec).count() == 0


def leg(spark, rows):
    return spark.createDataFrame(rows, "query_id string, chunk_id string, score double, rank int")


def test_fusion(spark):
    dense, sparse = leg(spark, [("q", "a", 0.9, 1), ("q", "b", 0.8, 2)]), leg(spark, [("q", "b", 3.0, 1), ("q", "c", 2.0, 2)])
    got = R.rrf(dense, sparse).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a", "c"] and got[0].sources == "dense,sparse"
    assert got[0].fusion_score == round(0.65 / 62 + 0.35 / 61, 9) and got[1].sparse_rank is None
    assert [r.chunk_id for r in R.rrf(dense, sparse, weights=(0.65, 0)).orderBy("rank").collect()] == ["a", "b"]
    assert R.rrf(dense, sparse, 2).count() == 2


def test_variants(spark):
    rows = [("q", "q1", "c1", 0.9), ("q", "q1", "c2", 0.7), ("q", "q2", "c2", 0.8), ("q", "q2", "c3", 0.6), ("q", "q3", "c4", 0.85)]
    got = R.merge_variants(spark.createDataFrame(rows, "query_id string, variant string, chunk_id string, score double")).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["c1", "c4", "c2", "c3"] and got[2].variants == ["q1", "q2"]


def test_rewrite(spark):
    q = spark.createDataFrame([(1, " 请问 隧道火灾怎么办？"), (2, "water"), (3, "请吗")], "query_id int, text string")
    got = {}
    for r in R.rewrite(q).orderBy("variant_no").collect():
        got.setdefault(r.query_id, []).append(r.variant)
    assert got[1] == ["请问 隧道火灾怎么办？", "隧道火灾怎么办", "隧道燃烧怎么办", "隧道起火怎么办", "隧道火情怎么办", "公路隧道火灾怎么办"]
    assert got[2] == ["water", "water 火灾"] and got[3][1] == "火灾领域知识问答"


def test_filter_and_rerank(spark):
    rows = [(1, "fire", "a", "fire exit", "section"), (1, "fire", "b", "[1] x", "references"), (1, "fire", "c", "short", "figure_caption"), (1, "fire", "d", "x" * 60, "figure_caption"), (2, "Figure 2", "b", "[1] x", "references"), (1, "fire", "e", "t", None)]
    h = spark.createDataFrame(rows, "query_id int, query string, chunk_id string, text string, chunk_type string")
    m = R.filter_candidates(h)
    assert sorted((r.query_id, r.chunk_id) for r in R.kept(m).collect()) == [(1, "a"), (1, "d"), (1, "e"), (2, "b")]
    assert R.kept(R.filter_candidates(h, "off")).count() == 6
    assert R.filter_counts(m).where("query_id = 1").first().n_after == 3
    c = h.withColumn("fusion_score", F.lit(0.01))
    top = R.rerank(c, k=1).where("query_id = 1").first()
    assert top.chunk_id == "a" and top.final_score == round(0.75 + 0.1 * math.sqrt(0.5) + 0.1, 6)

    def fails(q, t):
        raise ValueError("no model")

    r = R.rerank_with_model(c, fails).where("query_id = 1").orderBy("rank").first()
    assert (r.chunk_id, r.reranker, r.fallback_reason) == ("a", "lexical", "no model")
    r = R.rerank_with_model(c, lambda q, t: [len(x) for x in t]).where("query_id = 1").orderBy("rank").first()
    assert (r.chunk_id, r.reranker) == ("d", "model")


def test_embed_quarantine(spark):
    def model(texts):
        if any("\x01" in t or t == "bad" for t in texts):
            raise ValueError("refused")
        return [[1.0, 2.0] for _ in texts]

    c = spark.createDataFrame([(1, "ok"), (2, "con\x01trol"), (3, "bad")], "chunk_id int, text string").coalesce(1)
    good, bad = I.embed(c, model)
    assert {(r.chunk_id, r.status) for r in good.collect()} == {(1, "ok"), (2, "recovered")}
    assert {(r.chunk_id, r.status, r.detail) for r in bad.collect()} == {(2, "recovered", ""), (3, "failed", "refused")} or bad.where("chunk_id = 3").count() == 1


def python_chunks(text, size):
    """Recursive cut and greedy packing, written independently over strings."""

    def cut(t, seps):
        if len(t) <= size:
            return [t] if t else []
        if not seps:
            return [t[i : i + size] for i in range(0, len(t), size)]
        parts, now = [], ""
        i = 0
        while i < len(t):
            if t.startswith(seps[0], i):
                parts.append(now + seps[0])
                now, i = "", i + len(seps[0])
            else:
                now, i = now + t[i], i + 1
        parts += [now] if now else []
        return [x for p in parts for x in cut(p, seps[1:])]

    out, now = [], ""
    for p in cut(text, list(N.SEPARATORS)):
        if len(now) + len(p) <= size:
            now += p
        else:
            out += [now] if now else []
            now = p
    return [x.strip() for x in [*out, now] if x.strip()]


def test_chunks_equal_python(spark):
    rnd = random.Random(4)
    alphabet = ["ab", "c", " ", " ", "\n", "\n\n", "。", "，", ",", "；", "火灾", "xyzuvw" * 3]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 120))) for _ in range(150)]
    import re

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for size in (12, 40):
        got = {r.i: r.c for r in df.select("i", N.recursive_chunks(F.col("t"), size).alias("c")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == python_chunks(re.sub(r"\n{3,}", "\n\n", t).strip(), size)
    s = df.select(F.lit("d").alias("doc_id"), F.col("i").cast("string").alias("section_id"), F.col("t").alias("text"))
    kids = N.chunk_sections(s, 140, 64, 12).collect()
    assert all(len(r.text) <= 64 + 12 for r in kids) and len({(r.section_id, r.parent_no, r.child_no) for r in kids}) == len(kids)
    with pytest.raises(ValueError):
        N.chunk_sections(s, 50, 60, 10)


def test_cleaning_and_sections(spark):
    page = lambda n, body: ("d", n, f"Header line\n{body}\n\n第 {n} 页")
    p = spark.createDataFrame([page(1, "1 引言\nfirst\n\n\nfirst\nsecond   x"), page(2, "1.1 背景介绍\ntext here"), page(3, "2 方法说明\n=========\nmore"), ("e", 1, "")], "doc_id string, page_number int, text string")
    noise = N.boundary_noise(p)
    assert "Header line" in {r.line for r in noise.collect()}
    texts = {(r.doc_id, r.page_number): r.text for r in N.clean_pages(p, noise).collect()}
    assert texts["d", 1] == "1 引言\nfirst\n\nsecond x" and texts["d", 3] == "2 方法说明\n===\nmore" and texts["e", 1] == ""
    s = N.sections(N.clean_lines(p, noise)).orderBy("section_no").collect()
    assert [(r.title, r.path, r.level, r.page_start) for r in s] == [("1 引言", ["1 引言"], 1, 1), ("1.1 背景介绍", ["1 引言", "1.1 背景介绍"], 2, 2), ("2 方法说明", ["2 方法说明"], 1, 3)]
    c = N.captions(spark.createDataFrame([("d", 1, "图 1 实验装置示意图\nFigure 2: layout of rooms\n图纸")], "doc_id string, page_number int, text string"))
    assert [r.caption_no for r in c.collect()] == [1, 2]
    html = "<table><tr><th>参数</th><th>值</th></tr><tr><td> </td></tr><tr><td>温度</td><td><b>600</b></td></tr></table>"
    assert one(spark, N.table_rows(F.col("h")), h=html) == [["参数", "值"], ["温度", "600"]]
    assert one(spark, N.strip_html(F.col("h")), h="<p>a</p><script>x</script><td>b</td>c") == "a\nb\tc"


def test_metadata(spark):
    text = "某某大学\n隧道火灾烟气控制研究进展\n作者：张三、李四等\n摘 要：本文研究\n烟气。\n关键词：火灾；烟气 ；x\n2019 2019"
    p = spark.createDataFrame([("d", "/a/硕士学位论文_王五.pdf", "Untitled", text), ("e", "/a/题目甲_王五、赵六 (2).pdf", None, "")], "doc_id string, source_path string, raw_title string, text string")
    d, e = N.paper_metadata(p).orderBy("doc_id").collect()
    assert (d.paper_title, d.authors, d.year, d.abstract, d.keywords) == ("隧道火灾烟气控制研究进展", ["张三", "李四"], 2019, "本文研究 烟气。", ["火灾", "烟气"])
    assert (e.paper_title, e.authors, e.year) == ("题目甲", ["王五", "赵六"], None)


def evidence(spark):
    rows = [(1, "c1", "p", "d", "paper", "T", "S", [], 2020, "", 1, 1, "alpha", 0.9), (1, "c2", "p", "d", "paper", "T", "S", [], 2020, "", 2, 2, "beta", 0.8), (1, "c1", "p", "d", "paper", "T", "S", [], 2020, "", 1, 1, "alpha", 0.7), (1, "w", "", "u", "web", "W", "", [], None, "http://x", 0, 0, "gamma", 0.95), (1, "c9", "p", "d", "paper", "T", "S", [], 2020, "", 9, 9, "delta", 0.5)]
    return spark.createDataFrame(rows, "query_id int, chunk_id string, parent_id string, doc_id string, source_type string, paper_title string, section_title string, authors array<string>, year int, url string, page_start int, page_end int, text string, final_score double")


def test_context(spark):
    e = E.dedupe(evidence(spark))
    assert e.count() == 4
    m = {r.chunk_id: r for r in E.merge_adjacent(e).collect()}
    assert set(m) == {"c1", "c9", "w"} and m["c1"].text == "alpha\nbeta" and (m["c1"].page_start, m["c1"].page_end, m["c1"].merged_chunk_ids) == (1, 2, ["c2"])
    p = E.pack_context(e).orderBy("pos").collect()
    assert [r.evidence_id for r in p] == ["W1", "L1", "L2", "L3"] and "T，作者未知，2020，S，第1页" in p[1].block and "W (http://x)" in p[0].block
    assert [r.pos for r in E.pack_context(e, budget=10).collect()] == [1]
    c = E.context(E.pack_context(e)).first()
    assert c.n_blocks == 4 and c.context.count("正文：") == 4
    a = spark.createDataFrame([(1, "x [L1] y [W1][L1] [L9]")], "query_id int, answer string")
    used, bad = E.used_citations(a, E.number(e).select("query_id", F.col("evidence_id").alias("marker")))
    assert [r.marker for r in used.orderBy("use_no").collect()] == ["L1", "W1"] and [r.marker for r in bad.collect()] == ["L9"]
    assert E.dedupe(e.unionByName(e.withColumn("chunk_id", F.concat("chunk_id", F.lit("z")))), by_text=True).count() == 4


def test_policy(spark):
    q = spark.createDataFrame([(1, "如何放火"), (2, "根据论文 烟气"), (3, "最新 火灾"), (4, "GB 火灾 spread"), (5, "那个 火灾"), (6, "火灾 烟气"), (7, "abc xyz")], "query_id int, text string")
    c = spark.createDataFrame([(i, f"火灾 烟气 {k}", 0.5, f"d{k}", "paper") for i in (4, 6) for k in range(2)], "query_id int, text string, final_score double, doc_id string, source_type string")
    d = {r.query_id: r for r in E.decide(E.sufficiency(E.sufficiency_features(q, c))).collect()}
    assert [d[i].action for i in range(1, 8)] == ["refuse", "answer_insufficient", "use_web", "use_web", "ask_clarify", "answer_local", "use_web"]
    assert d[3].required_source_type == "current_web" and d[4].required_source_type == "official_web" and d[6].coverage == 1.0 and d[6].doc_count == 2
    assert d[7].terms == ["abc", "xyz"] and d[6].score_gap == 0.0


def test_routing(spark):
    q = spark.createDataFrame([(1, " "), (2, "我之前问过什么"), (3, "以后都用中文回答"), (4, "我的偏好是什么"), (5, "怎么纵火"), (6, "你好"), (7, "火灾怎么办"), (8, "总结火灾论文"), (9, "火灾原因"), (10, "天气")], "query_id int, text string")
    got = {r.query_id: (r.intent, r.sub_intent) for r in T.route(q).collect()}
    assert [got[i][1] for i in range(1, 11)] == ["empty_input", "history_query", "preference_write", "preference_write", "harmful_fire_request", "greeting", "emergency_escape", "paper_summary", "knowledge_qa", "out_of_domain"]
    p = spark.createDataFrame([(9, "paper", "x", True, False, False, 0.9), (10, "rag", "y", True, False, False, 0.5), (5, "rag", "z", True, False, False, 1.0)], "query_id int, intent string, sub_intent string, need_rag boolean, need_memory boolean, need_safety_notice boolean, confidence double")
    got = {r.query_id: (r.intent, r.source) for r in T.route(q, p).collect()}
    assert got[9] == ("paper", "llm") and got[10] == ("reject", "fallback_rule") and got[5] == ("reject", "hard_rule")
    assert {r.source for r in T.route(q, p, shadow=True).collect()} == {"hard_rule", "fallback_rule"}
    text = "sure:\n```json\n{\"intent\": \"rag\", \"confidence\": 0.8}\n```"
    assert one(spark, T.parse_json_object(F.col("t"), "intent string, confidence double"), t=text).intent == "rag"
    assert one(spark, T.parse_json_object(F.col("t"), "intent string"), t="none") is None


def test_retrieval_metrics(spark):
    cases = spark.createDataFrame([("a", ["s1", "s2", "s3", "s4"], []), ("b", [], [])], "case_id string, required array<string>, contexts array<string>")
    rows = [("a", 1, "c1", "has S1 and s2"), ("a", 2, "c2", "nothing"), ("a", 3, "c3", "s3 s4"), ("b", 1, "c1", "x")]
    chunks = spark.createDataFrame([(*r, "", "", "d", "") for r in rows], "case_id string, rank int, chunk_id string, text string, title string, section string, doc_id string, chunk_type string")
    m = {(r.case_id, r.k): r for r in V.retrieval_metrics(cases, V.annotate(cases, chunks), (1, 2, 3)).collect()}
    assert (m["a", 1].recall, m["a", 3].recall, m["a", 2].precision, m["a", 3].mrr) == (0.5, 1.0, 0.5, 1.0) and m["b", 1].hit is None
    ctx = spark.createDataFrame([("a", None, ["fire in the long tunnel", "zzz"])], cases.schema)
    got = V.annotate(ctx, chunks.withColumn("text", F.lit("the long fire tunnel exit"))).where("rank = 1").first()
    assert got.contexts == [0]


def test_groups_and_docs(spark):
    g = lambda *a: one(spark, V.groups(*map(F.lit, a)))
    assert g("rag", "answer_with_local_evidence", "", "single_doc", "") == ["all", "local_answerable", "local_single_doc"]
    assert g("emergency", "", "refuse", "multi_doc", "") == ["all", "local_multi_doc", "fallback_safety_excluded", "emergency", "emergency_safety", "emergency_local_evidence"]
    cases = spark.createDataFrame([("a", ["/x/One.pdf", "Two.PDF", "three"])], "case_id string, documents array<string>")
    chunks = spark.createDataFrame([("a", 1, "d1", "one", ""), ("a", 2, "d2", "", "none")], "case_id string, rank int, doc_id string, title string, text string")
    r = V.doc_hits(cases, chunks, (5,)).first()
    assert (r.doc_hit, r.doc_recall, r.unique_docs) == (1.0, round(1 / 3, 4), 2)


def test_answers(spark):
    cases = spark.createDataFrame([("a", "emergency", ["应急"], ["烟气", "疏散"], ["p1"], "烟气 疏散", {"expected_web": "true"}), ("b", "rag", [], [], [], "", {})], "case_id string, intent string, tags array<string>, keywords array<string>, required array<string>, reference_answer string, metadata map<string,string>")
    p = spark.createDataFrame([("a", "立即疏散，注意烟气。", ["烟气 疏散 资料"], ["p1"], True, "", [])], "case_id string, answer string, contexts array<string>, citations array<string>, evidence_sufficient boolean, fallback_action string, errors array<string>")
    s = {r.case_id: r for r in V.score_answers(cases, p).collect()}
    assert s["a"].answer_keyword_recall == 1.0 and s["a"].overall > 0.8 and s["a"].missed_web and not s["a"].fallback_correct and s["b"].has_error and s["b"].groundedness == 0.0
    avg = V.average_scores(V.score_answers(cases, p)).first()
    assert avg.n == 2 and avg.missed_web == 0.5
    assert V.gate(V.score_answers(cases, p), 0.99).first().passed is False


def test_router_metrics(spark):
    rows = spark.createDataFrame([("rag", "rag", "x", "x", "llm", "s", 0.9, 0.1, True, True), ("rag", "chat", "x", "y", "fallback_rule", "s", 0.5, 0.3, True, False), ("chat", "chat", None, "z", "llm", "t", None, None, None, True)], "expected string, predicted string, expected_sub string, predicted_sub string, source string, source_intent string, confidence double, latency double, expected_need_rag boolean, need_rag boolean")
    s = V.router_summary(rows, V.label_scores(V.confusion(rows))).first()
    assert (s.accuracy, s.sub_accuracy, s.n_fallback, s.n_low_confidence) == (round(2 / 3, 6), 0.5, 1, 1) and s.macro_f1 == round(2 / 3, 6)
    t = V.latency_summary(rows, "latency", []).first()
    assert (t.n, t.p50, t.p95) == (2, 0.1, 0.3)
    assert V.flag_mismatches(rows, ("need_rag",)).first().mismatches == 1


def test_index_maintenance(spark):
    schema = "chunk_id string, doc_id string, status string, content_hash string"
    c = spark.createDataFrame([("1", "a", "active", "h"), ("2", "a", "deleted", "h"), ("3", "b", None, "k")], schema)
    new = spark.createDataFrame([("a", "h"), ("b", "z"), ("c", "q")], "doc_id string, content_hash string")
    assert {r.doc_id: r.decision for r in I.ingest_decision(new, c).collect()} == {"a": "skipped", "b": "replace", "c": "insert"}
    d = {r.chunk_id: (r.status, r.changed) for r in I.soft_delete(c, spark.createDataFrame([("a",), ("a",)], "doc_id string")).collect()}
    assert d == {"1": ("deleted", True), "2": ("deleted", False), "3": (None, False)}
    up = I.upsert(c, spark.createDataFrame([("1", "a", "x", "1"), ("1", "a", "x", "2"), ("9", "z", "y", "3")], schema), order="content_hash")
    assert {r.chunk_id: r.content_hash for r in up.collect()} == {"1": "2", "2": "h", "3": "k", "9": "3"}
    assert {r.doc_id: r.n_chunks for r in I.counts_by_doc(c).collect()} == {"a": 1, "b": 1}


def test_memory(spark):
    m = spark.createDataFrame([(1, "以后默认用中文回答"), (2, "我的密码是 123456"), (3, "短"), (4, "这次报错了 error"), (5, "本项目采用 Spark，不要使用别的工具")], "i int, content string")
    s = {r.i: r for r in M.score_importance(m).collect()}
    assert s[1].importance == 0.8 and s[1].tags == ["preference", "language"] and s[1].confidence == 0.85
    assert s[2].importance == 0.0 and s[3].reason == "文本过短" and s[4].importance == 0.0 and s[5].importance == 0.45
    c = M.extract_candidates(spark.createDataFrame([(1, "你好呀今天。以后默认用中文回答！本项目采用 Spark；不要使用别的工具吧")], "turn_id int, content string")).orderBy("rank").collect()
    assert [r.content for r in c] == ["用户偏好：以后默认用中文回答", "项目事实：本项目采用 Spark"]
    msgs = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"问题 {i} 请修改 不要删除{i % 4}", i) for i in range(10)], "session_id int, message_id int, role string, content string, created_at int")
    assert [r.message_id for r in M.recent_messages(msgs, 4).orderBy("pos").collect()] == [6, 7, 8, 9]
    st = M.session_state(msgs).first()
    assert st.current_goal == "问题 0 请修改 不要删除0" and st.current_step.startswith("问题 8") and st.constraints == ["不要删除0", "不要删除2"]
    assert M.rolling_summary(msgs, 10, 4).first().summary.startswith("最初目标：问题 0") and M.rolling_summary(msgs, 11).count() == 0
    assert one(spark, M.append_bounded(F.array(*map(F.lit, [1, 2, 3])), F.lit(4), 3)) == [2, 3, 4]
    mem = spark.createDataFrame([("m1", "u", "semantic", ["a"], "active", 0.5, 0.5, [1.0, 0.0], 0), ("m2", "u", "semantic", ["a"], "active", 0.5, 0.5, [1.0, 0.0], 365), ("m3", "v", "semantic", [], "active", 1.0, 0.5, [1.0, 0.0], 0), ("m4", "u", "semantic", [], "deleted", 1.0, 0.5, [1.0, 0.0], 0)], "memory_id string, user_id string, memory_type string, tags array<string>, status string, importance double, confidence double, vector array<double>, age int")
    mem = mem.withColumn("created_at", F.expr("timestamp '2024-06-01' - make_dt_interval(age)"))
    q = spark.createDataFrame([(1, "u", [1.0, 0.0])], "query_id int, user_id string, vector array<double>")
    got = M.search_memories(q, mem, F.lit("2024-06-01 00:00:00")).orderBy("rank").collect()
    assert [(r.memory_id, r.score) for r in got] == [("m1", 1.0), ("m2", 0.5)]
    cand = spark.createDataFrame([("k1", "u", 0.9, 0.8, ["b"], [1.0, 0.1]), ("k2", "u", 0.9, 0.8, ["c"], [0.0, 1.0]), ("k3", "u", 0.1, 0.8, [], [1.0, 0.0])], "candidate_id string, user_id string, importance double, confidence double, tags array<string>, vector array<double>")
    new, merged = M.dedupe_memories(cand, mem)
    assert [r.candidate_id for r in new.collect()] == ["k2"] and [r.candidate_id for r in merged.collect()] == ["k1"]
    out = {r.memory_id: (r.importance, r.tags) for r in M.merge_memories(mem, merged).collect()}
    assert (0.9, ["a", "b"]) in out.values()
    sec = spark.createDataFrame([(1, 1, "A", "x" * 100), (1, 2, "B", "y" * 400), (1, 3, "C", "z")], "session_id int, pos int, title string, body string")
    f = M.fit_sections(sec, 350).first()
    assert f.truncated and f.text.endswith("[已截断]") and "# C" not in f.text


def test_catalog_and_detection(spark):
    c = spark.createDataFrame([("a", 1, "T", ["x"], 2020, "", ["k1", "k2"], "active", "abc"), ("a", 2, "T", ["x"], 2020, "abs", ["k1"], None, "abcdef"), ("b", 1, "U", ["y"], None, "", [], "deleted", "q")], "doc_id string, chunk_index int, paper_title string, authors array<string>, year int, abstract string, keywords array<string>, status string, text string")
    p = C.papers(c)
    r = p.first()
    assert p.count() == 1 and (r.abstract, r.chunk_count, r.keywords) == ("abs", 2, ["k1", "k2"])
    assert C.search_papers(p, "ABS").first().total == 1 and C.search_papers(p, "nope").count() == 0
    assert C.length_histogram(c).agg(F.sum("n")).first()[0] == 3 and C.length_histogram(c).count() == 10
    assert one(spark, C.suspicious_heading(F.col("t")), t="#$%^&*") and not one(spark, C.suspicious_heading(F.col("t")), t="1.2 结果分析")
    boxes = spark.createDataFrame([("j", 1, 0.0, 0.0, 10.0, 10.0, 0, 0.9), ("j", 1, 1.0, 1.0, 10.0, 10.0, 1, 0.8), ("j", 1, 20.0, 20.0, 30.0, 30.0, 0, 0.7), ("j", 2, 1.0, 1.0, 10.0, 10.0, 1, 0.8)], "job string, frame int, x1 double, y1 double, x2 double, y2 double, class_id int, score double")
    assert sorted(r.score for r in D.suppress(boxes, 0.5).collect()) == [0.7, 0.8, 0.9]
    step = "array<struct<step_id:int,step_type:string,status:string,latency_ms:long>>"
    t = spark.createDataFrame([("t", "s", "rag", "g" * 200, "2024-01-01T00:00:00", "2024-01-01T00:00:01.5", "success", [(1, "a", "success", 5), (2, "b", "failed", None), (3, "a", "skipped", 7)])], f"trace_id string, session_id string, intent string, goal string, start_time string, end_time string, final_status string, steps {step}")
    i = O.trace_index(t).first()
    assert (i.latency_ms, i.error_count, i.n_steps, len(i.goal)) == (1500, 1, 3, 100)
    assert {r.step_type: (r.n_steps, r.n_failed, r.p95) for r in O.step_accounting(O.steps(t)).collect()} == {"a": (2, 0, 7), "b": (1, 1, None)}


def test_order_statistics_of_close_values(spark):
    """Distinct values close to each other are spread over the ranges, and the picks stay exact."""
    from ragmill.operators import evaluate as E

    n = 40_000
    df = spark.range(n).select(F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 == 1, None).otherwise("b").alias("g"), (1000 + F.col("id") / n).alias("v"))
    counted = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    sizes = E._ranged(counted, "v", ["g"]).groupBy("g", "_range").count().collect()
    assert len(sizes) == 3 * 64 and max(r["count"] for r in sizes if r.g == "b") < n / 2 / 32
    values = {}
    for r in df.collect():
        values.setdefault(r.g, []).append(r.v)
    for r in E.latency_summary(df, "v", ["g"]).collect():
        v = sorted(values[r.g])
        assert [r.p50, r.p90, r.p95] == [v[round((len(v) - 1) * p)] for p in (0.5, 0.9, 0.95)] and r.n == len(v)
    one = E.describe(df, "v", []).first()
    every = sorted(x for v in values.values() for x in v)
    assert one.p10 == every[round((n - 1) * 0.1)] and one.median == (every[n // 2 - 1] + every[n // 2]) / 2


def test_context_parts_and_memory_lines(spark):
    """Parts come in order, sessions without a state have recent messages only; memory answers keep to the topic."""
    from ragmill.operators import memory as M

    m = [("s", "m1", "user", "问 一", 1), ("s", "m2", "assistant", "x" * 600, 2), ("s", "m3", "tool", "out", 3), ("t", "m4", "user", "only", 1)]
    messages = spark.createDataFrame(m, "session_id string, message_id string, role string, content string, created_at int")
    state = [("s", "goal", None, ["a", " "], [], ["done"], "", [("step 1", "ok", "fine"), (None, "", "")], ["m3", "m4", "m1"])]
    states = spark.createDataFrame(state, "session_id string, current_goal string, current_step string, constraints array<string>, pending_items array<string>, completed_items array<string>, rolling_summary string, intermediate_results array<struct<step:string,status:string,summary:string>>, pinned_message_ids array<string>")
    got = {(r.session_id, r.title): r.body for r in M.context_sections(states, messages, 2).where("trim(body) <> ''").collect()}
    long = "助手：" + "x" * 500 + "..."
    assert got == {("s", "当前任务目标"): "goal", ("s", "当前约束"): "- a", ("s", "已完成事项"): "- done", ("s", "中间结果"): "- step 1：ok：fine", ("s", "关键消息"): "tool：out\n用户：问 一", ("s", "最近对话"): f"{long}\ntool：out", ("t", "最近对话"): "用户：only"}
    fitted = {r.session_id: r.text for r in M.fit_sections(M.context_sections(states, messages, 2)).collect()}
    assert fitted["s"].startswith("# 当前任务目标") and fitted["t"] == "# 最近对话\n用户：only"
    prompts = [(1, "我的笔记", "- [semantic|0.90] 标题用中文\n\n- plain\n- [x] - 笔记 two"), (2, "other", "- [a|1] one\n-- two"), (3, "火灾", "- [a|1] nothing here"), (4, None, None)]
    lines = M.memory_lines(spark.createDataFrame(prompts, "query_id int, query string, prompt string"))
    assert sorted(map(tuple, lines.collect())) == [(1, 1, "标题用中文"), (1, 2, "笔记 two"), (2, 1, "one"), (2, 2, "two"), (3, 1, "nothing here")]


def test_failed_variants(spark):
    import pytest
    from ragmill.operators import retrieve as R

    rows = [(1, 0, "a", None), (1, 1, "b", "timeout"), (2, 0, "c", "timeout"), (2, 1, "d", "timeout"), (3, 0, "e", None), (3, 0, "e", None), (None, 0, "x", None)]
    variants = spark.createDataFrame(rows, "query_id long, variant_no int, text string, error string")
    pairs = spark.createDataFrame([("a", 7, 0.5), ("b", 8, 0.9), ("c", 9, 0.9), ("e", 7, 0.1), ("e", 8, 0.1)], "text string, chunk_id long, score double")
    hits, outcomes = R.retrieve_variants(variants, lambda q: q.join(pairs, "text").select("query_id", "chunk_id", "score"))
    assert sorted((r.query_id, r["rank"], r.chunk_id, r.score, r.variants) for r in hits.collect()) == [(1, 1, 7, 0.5, [0]), (3, 1, 7, 0.1, [0]), (3, 2, 8, 0.1, [0])]
    assert sorted(map(tuple, outcomes.collect())) == [(1, 2, 1, False), (2, 2, 2, True), (3, 1, 0, False)]
    R.require_hits(outcomes)
    R.require_hits(outcomes.limit(0))
    with pytest.raises(RuntimeError):
        R.require_hits(outcomes.where("failed"))


def shuffled(df):
    """Expressions that the plan's exchanges deal rows by."""
    return "\n".join(x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x)


def test_legs_sum_rows_of_one_chunk(spark):
    rows = [(1, "fire smoke fire"), (1, "smoke fire fire"), (1, "smoke"), (None, "fire"), (None, "fire smoke"), (2, "smoke water"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "chunk_id long, text string")
    q = spark.createDataFrame([(9, "fire smoke fire"), (8, "water nothing"), (7, None)], "query_id long, text string")
    toks = [(c, (t or "").split()) for c, t in rows]
    mean = max(1.0, sum(len(t) for _, t in toks) / len(toks))
    tf = {}
    for c, t in toks:
        for w in t:
            tf[c, len(t), w] = tf.get((c, len(t), w), 0) + 1
    df = {w: sum(k[2] == w for k in tf) for w in ("fire", "smoke", "water")}
    idf = {w: math.log(1 + (len(rows) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    sat = lambda n, l: n * 2.5 / (n + 1.5 * (0.25 + 0.75 * l / mean))
    want, sparse = {}, {}
    for (c, l, w), n in tf.items():
        for i, text in ((9, "fire smoke fire"), (8, "water nothing")):
            if many := text.split().count(w):
                want[i, c] = want.get((i, c), 0) + many * idf[w] * sat(n, l)
                sparse[i, c] = sparse.get((i, c), 0) + idf[w] * (1 + math.log(1 + many)) * idf[w] * sat(n, l)
    for found, expected in ((R.bm25(q, docs, 3), want), (R.sparse_bm25(q, docs, 3), sparse)):
        got = [(r.query_id, r["rank"], r.chunk_id, r.score) for r in found.orderBy("query_id", "rank").collect()]
        best = []
        for i in (8, 9):
            some = sorted((-round(s, 6), c is not None, c or 0, c) for (x, c), s in expected.items() if x == i)[:3]
            best += [(i, n + 1, c, -s) for n, (s, _, _, c) in enumerate(some)]
        assert got == best
    p, s = I.postings(docs), I.corpus_stats(docs)
    old = R.sparse_dot(I.sparse_query(q, I.term_stats(p, s)), I.sparse_vectors(p, s), 3)
    assert sorted(map(repr, old.collect())) == sorted(map(repr, R.sparse_bm25(q, docs, 3).select(old.columns).collect()))
    assert R.bm25(q.limit(0), docs).count() == R.bm25(q, docs.limit(0)).count() == R.sparse_bm25(q, docs.limit(0)).count() == 0
    v = sorted((r.chunk_id or 0, r.vector) for r in I.hashed_dense(docs, 8).collect())
    assert [c for c, _ in v] == [0, 0, 1, 1, 1, 2, 3, 4] and v[2] == v[3] == v[4] and v[0] == v[1]
    assert abs(sum(x * x for x in v[2][1]) - 1) < 1e-9 and not any(v[6][1]) and not any(v[7][1])


def test_legs_shuffle_no_tokens_and_no_texts(spark):
    docs = spark.range(3000).select(F.col("id").alias("chunk_id"), F.concat_ws(" ", F.col("id") % 7, F.lit("fire smoke"), F.col("id") % 11).alias("text"))
    q = spark.createDataFrame([(i, f"fire smoke {i}") for i in range(5)], "query_id long, text string")
    hits = R.bm25(q, docs, 4)
    assert "term" not in shuffled(hits) and "Aggregate" not in hits._jdf.queryExecution().executedPlan().toString()
    joined = R.beside_texts(hits, docs)
    assert "hashpartitioning(chunk_id" not in shuffled(joined) and joined.count() == 20
    assert "term" not in shuffled(I.hashed_dense(docs)) and "hashpartitioning(chunk_id" not in shuffled(I.hashed_dense(docs))
    c = joined.withColumnRenamed("score", "fusion_score").drop("rank").join(R.few(q.withColumnRenamed("text", "query"), 100), "query_id")
    assert shuffled(R.rerank(c)).count("hashpartitioning") == 1


def test_blocks_of_queries_do_not_matter(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 13}" for j in range(1, 9))) for i in range(60)], "chunk_id long, text string")
    q = spark.createDataFrame([(i, f"w{i} w{i + 1} w{3 * i % 13}") for i in range(12)], "query_id long, text string")
    want = [sorted(map(repr, f(q, docs, 5).collect())) for f in (R.bm25, R.sparse_bm25)]
    blocks = R._term_blocks
    monkeypatch.setattr(R, "_term_blocks", lambda queries: blocks(queries, 4))
    monkeypatch.setattr(R, "GROUP", 3)
    assert [sorted(map(repr, f(q, docs, 5).collect())) for f in (R.bm25, R.sparse_bm25)] == want
