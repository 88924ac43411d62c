"""Evidence and routing queries over the retrieval results of the benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragmill.operators import evidence as E
from ragmill.operators import retrieve as R
from ragmill.operators import route as T
from ragmill.plans.ingest import ORACLE_SQL as _INGEST_SQL
from ragmill.plans.retrieval import FUSED, ITEMS, TOK, TOKENS, bench, bm25_sql, corpus, table

#: Word lists in the language of these tables.
WORDS = {"temporal": ("ndoure",), "official": ("entiin",), "local_scope": ("thinor",), "harmful": ("eranes",), "ambiguous": ("tion ",)}
TERMS = ("heed", "ingwh", "theron")
RULES = {"chat": ("hello",), "preference": ("lyonly",), "memory": ("eratble",), "history": ("ndthat",), "paper": ("tion",), "emergency": ("heed",), "domain": ("the", "que"), "harmful": ("worthless",)}


def reranked(spark, sf):
    """BM25 hits of each item with a score between 0 and 1, and evidence columns."""
    hits = R.bm25(bench(spark, sf), corpus(spark, sf), 12)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("source").alias("section_title"), F.when(F.col("lang") == "en", "paper").otherwise("web").alias("source_type"), "text")
    return R.beside_texts(hits, d).withColumn("final_score", F.round(F.col("score") / (F.col("score") + 40), 6))


def sufficiency(spark, sf):
    f = E.sufficiency_features(bench(spark, sf), reranked(spark, sf), WORDS, TERMS)
    s = E.sufficiency(f, 0.3)
    return s.select("query_id", "top_score", "evidence_count", "doc_count", "source_type_count", "score_gap", F.size("matched_terms").alias("n_matched"), F.size("missing_terms").alias("n_missing"), F.round("coverage", 6).alias("coverage"), "reason", "sufficient", "needs_web")


def fallback_policy(spark, sf):
    d = E.decide(E.sufficiency(E.sufficiency_features(bench(spark, sf), reranked(spark, sf), WORDS, TERMS), 0.3))
    return d.select("query_id", "action", "decision_reason", "confidence", "required_source_type", F.array_join("query_flags", ",").alias("query_flags"), E.web_trigger(d, 2, 0.3).alias("web_trigger"))


def evidence_rows(spark, sf):
    """Reranked hits as evidence."""
    e = reranked(spark, sf).withColumns({"parent_id": F.lit(""), "page_start": (F.col("doc_id") % 7).cast("int"), "page_end": (F.col("doc_id") % 7 + 1).cast("int"), "doc_id": F.col("section_title")})
    return E.dedupe(e)


def evidence_merge(spark, sf):
    m = E.merge_adjacent(evidence_rows(spark, sf))
    return m.withColumn("merged_chunk_ids", F.array_join("merged_chunk_ids", ","))


def context_pack(spark, sf):
    e = evidence_rows(spark, sf).withColumns({"paper_title": F.col("section_title"), "authors": F.array().cast("array<string>"), "year": F.lit(None).cast("int"), "url": F.lit("")})
    p = E.pack_context(e, 3000, 600)
    return p.select("query_id", "chunk_id", "evidence_id", "pos", F.length("block").alias("n"), F.length("text").alias("n_text"), "used")


def answers(spark, sf):
    """Answers that cite marks, some of which no evidence has."""
    c = evidence_rows(spark, sf).withColumns({"paper_title": F.col("section_title"), "authors": F.array().cast("array<string>"), "year": F.lit(None).cast("int"), "url": F.lit("")})
    p = E.pack_context(c, 3000, 600)
    a = bench(spark, sf).select("query_id", F.concat(F.substring("text", 1, 20), F.lit(" [L1] and [W2] [L1] ["), F.when(F.col("query_id") % 2 == 0, "L9").otherwise("W1"), F.lit("]")).alias("answer"))
    return a, p.select("query_id", F.col("evidence_id").alias("marker"), "chunk_id")


def used_citations(spark, sf):
    used, _ = E.used_citations(*answers(spark, sf))
    return used.select("query_id", "marker", "use_no", "chunk_id")


def invalid_citations(spark, sf):
    return E.used_citations(*answers(spark, sf))[1]


def web_evidence(spark, sf):
    from ragmill.operators.ingest import strip_html

    p = table(spark, sf, "pages").select(F.floor(F.col("page_id") / 10).alias("query_id"), F.col("page_id").alias("result_no"), "url", strip_html(F.col("html")).alias("text"), (F.length("html") % 100 / 100).alias("score"))
    return E.web_candidates(E.web_evidence(p)).select("query_id", "chunk_id", "doc_id", "chunk_no", F.round("fusion_score", 9).alias("fusion_score"), "text")


def local_and_web(spark, sf):
    local = reranked(spark, sf).select("query_id", F.col("chunk_id").cast("string").alias("chunk_id"), "text", F.col("final_score").alias("fusion_score"))
    from ragmill.operators.ingest import strip_html

    q = R.few(bench(spark, sf).withColumnRenamed("text", "query"), ITEMS)
    p = table(spark, sf, "pages").withColumn("query_id", F.floor(F.col("page_id") / 10)).join(q.drop("query"), "query_id", "left_semi")  # results of other queries are never made
    p = p.select("query_id", F.col("page_id").alias("result_no"), "url", strip_html(F.col("html")).alias("text"), F.lit(0.5).alias("score"))
    web = E.web_candidates(E.web_evidence(p)).select("query_id", "chunk_id", "text", "fusion_score")
    return E.combine_and_rerank(local.join(q, "query_id"), web.join(q, "query_id")).select("query_id", "chunk_id", "final_score", "rank")


def intent_route(spark, sf):
    q = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    r = T.route(q.withColumn("query_id", F.concat_ws("-", "conv_id", "turn")), rules=RULES)
    return r.select("conv_id", "turn", "intent", "sub_intent", "need_rag", "need_memory", "need_safety_notice", "source")


def intent_merge(spark, sf):
    """Predictions from labels, merged with the rules."""
    q = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), "text")
    p = table(spark, sf, "labels").select(F.col("doc_id").alias("query_id"), F.when(F.col("toxic") == 1, "reject").otherwise("rag").alias("intent"), F.lit("model").alias("sub_intent"), (F.col("toxic") == 0).alias("need_rag"), F.lit(False).alias("need_memory"), F.lit(False).alias("need_safety_notice"), F.when(F.col("quality") == 1, 0.9).otherwise(0.5).alias("confidence"))
    return T.route(q, p, rules=RULES).groupBy("intent", "sub_intent", "source").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (sufficiency, fallback_policy, evidence_merge, context_pack, used_citations, invalid_citations, web_evidence, local_and_web, intent_route, intent_merge)}

RER = f"""{TOK}, {bm25_sql(12)},
rer AS MATERIALIZED (SELECT h.query_id, h.chunk_id, d.doc_id, d.source AS section_title, CASE WHEN lang = 'en' THEN 'paper' ELSE 'web' END AS source_type, d.text, round(h.score / (h.score + 40), 6) AS final_score FROM hits h JOIN documents d ON d.doc_id = h.chunk_id)"""
TERM_SQL = "list_distinct(list_filter(['heed', 'ingwh', 'theron'], lambda w: contains(text, w)) || list_filter(" + TOKENS.format("text") + ", lambda x: regexp_matches(x, '^[\\x00-\\x7f]{2,}$')))"
SUFF = f"""{RER}, q AS (SELECT item_id AS query_id, text, CASE WHEN len({TERM_SQL}) > 0 THEN {TERM_SQL} ELSE list_distinct(list_filter({TOKENS.format("text")}, lambda x: length(x) > 1)) END AS terms FROM benchmark),
agg AS (SELECT query_id, max(final_score) AS top_score, count(*) AS evidence_count, count(DISTINCT doc_id) AS doc_count, count(DISTINCT source_type) AS source_type_count, list(final_score ORDER BY final_score DESC) AS s FROM rer GROUP BY 1),
found AS (SELECT q.query_id, count(DISTINCT t) AS n FROM (SELECT query_id, unnest(terms) AS t FROM q) q JOIN rer ON rer.query_id = q.query_id AND contains(lower(rer.text), lower(t)) GROUP BY 1),
suff AS (SELECT query_id, coalesce(top_score, 0) AS top_score, coalesce(evidence_count, 0) AS evidence_count, coalesce(doc_count, 0) AS doc_count, coalesce(source_type_count, 0) AS source_type_count,
  round(CASE WHEN len(s) > 1 THEN s[1] - s[2] ELSE coalesce(s[1], 0) END, 4) AS score_gap, coalesce(n, 0)::INTEGER AS n_matched, (len(terms) - coalesce(n, 0))::INTEGER AS n_missing, coalesce(n, 0)::DOUBLE / greatest(len(terms), 1) AS cov, len(terms) AS nt, text FROM q LEFT JOIN agg USING (query_id) LEFT JOIN found USING (query_id)),
judged AS (SELECT *, CASE WHEN contains(text, 'ndoure') THEN 'temporal_keyword_detected' WHEN evidence_count < 2 THEN 'evidence_count_below_threshold' WHEN top_score < 0.3 THEN 'top_score_below_threshold' WHEN nt > 0 AND cov < 0.3 THEN 'term_coverage_below_threshold' ELSE 'local_evidence_sufficient' END AS reason FROM suff)"""
PACK = f"""{RER}, ev AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_type ORDER BY final_score DESC, chunk_id) AS n, text AS t0 FROM rer),
ev2 AS (SELECT *, CASE WHEN source_type = 'web' THEN 'W' ELSE 'L' END || n AS evidence_id, regexp_replace(trim(t0), '\\n{{3,}}', chr(10) || chr(10), 'g') AS t1 FROM ev),
ev3 AS (SELECT *, CASE WHEN length(t1) <= 600 THEN t1 ELSE rtrim(substr(t1, 1, 432), ' ') || chr(10) || '...' || chr(10) || ltrim(right(t1, 160), ' ') END AS t2, CASE WHEN doc_id % 7 = 0 THEN '页码未知' ELSE '第' || doc_id % 7 || '-' || (doc_id % 7 + 1) || '页' END AS pg FROM ev2),
ev4 AS (SELECT *, '[' || evidence_id || ']' || chr(10) || '来源：' || CASE WHEN source_type = 'web' THEN section_title ELSE section_title || '，作者未知，年份未知，' || section_title || '，' || pg END || chr(10) || '章节：' || section_title || '；页码：' || pg || '；分数：' || printf('%.4f', final_score) || chr(10) || '正文：' || t2 AS block FROM ev3),
pack AS (SELECT *, row_number() OVER w AS pos, sum(length(block)) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM ev4 WINDOW w AS (PARTITION BY query_id ORDER BY final_score DESC, chunk_id) QUALIFY pos = 1 OR used <= 3000),
marks AS (SELECT item_id AS query_id, unnest(list_distinct_in) AS marker, unnest(range(len(list_distinct_in)))::INTEGER AS use_no FROM (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN ['L1', 'W2', 'L9'] ELSE ['L1', 'W2', 'W1'] END AS list_distinct_in FROM benchmark))"""
LOW = "lower(trim(text))"
ROUTES = [
    (f"coalesce({LOW}, '') = ''", "chat", "empty_input", 0, 0, 0),
    ("contains(text, 'ndthat')", "chat", "history_query", 0, 0, 0),
    ("contains(text, 'lyonly') OR regexp_matches(text, '(以后|默认|始终|一律|统一|全部|都).{0,30}(笔记|回答|输出|语言|中文|英文|格式)')", "chat", "preference_write", 0, 1, 0),
    ("contains(text, 'eratble') OR regexp_matches(text, '(笔记|回答|输出|标题|格式|语言).{0,20}(应该|需要|用什么|怎么|如何|是什么)')", "chat", "memory_query", 0, 1, 0),
    ("contains(text, 'worthless')", "reject", "harmful_fire_request", 0, 0, 0),
    (f"contains({LOW}, 'hello') AND length({LOW}) <= 30", "chat", "greeting", 0, 0, 0),
    ("contains(text, 'heed') AND (contains(text, 'the') OR contains(text, 'que'))", "emergency", "emergency_escape", 1, 0, 1),
    ("contains(text, 'tion') AND (contains(text, 'the') OR contains(text, 'que'))", "paper", "paper_summary", 1, 0, 0),
    ("contains(text, 'the') OR contains(text, 'que')", "rag", "knowledge_qa", 1, 0, 0),
    ("true", "reject", "out_of_domain", 0, 0, 0),
]


def _case(i: int, cast: str = "", hard: int = 10) -> str:
    return "CASE " + " ".join(f"WHEN {r[0]} THEN " + (f"'{r[i]}'" if i < 3 else f"{bool(r[i])}") for r in ROUTES) + " END"


SOURCE = "CASE WHEN " + " OR ".join(f"({r[0]})" for r in ROUTES[:7]) + " THEN 'hard_rule' ELSE 'fallback_rule' END"
WEB_CHUNKS_SQL = _INGEST_SQL["web_chunks"]
ORACLE_SQL = {
    "sufficiency": f"WITH {SUFF} SELECT query_id, top_score, evidence_count, doc_count, source_type_count, score_gap, n_matched, n_missing, round(cov, 6) AS coverage, reason, reason = 'local_evidence_sufficient' AS sufficient, reason <> 'local_evidence_sufficient' AS needs_web FROM judged",
    "fallback_policy": f"""WITH {SUFF}, d AS (SELECT *, reason = 'local_evidence_sufficient' AS ok FROM judged),
p AS (SELECT *, CASE WHEN contains(text, 'eranes') THEN 1 WHEN contains(text, 'thinor') AND NOT ok THEN 2 WHEN contains(text, 'ndoure') THEN 3 WHEN contains(text, 'entiin') THEN 4 WHEN ok THEN 5 WHEN contains(text, 'tion ') THEN 6 ELSE 7 END AS r FROM d)
SELECT query_id, ['refuse', 'answer_insufficient', 'use_web', 'use_web', 'answer_local', 'ask_clarify', 'use_web'][r] AS action,
  ['harmful_request_detected', 'local_scope_requested_but_evidence_insufficient', 'temporal_information_required', 'official_information_required', 'local_evidence_sufficient', 'ambiguous_reference_detected', 'local_evidence_insufficient_and_web_allowed'][r] AS decision_reason,
  [1.0, 0.95, 0.9, 0.9, 0.85, 0.75, 0.65][r]::DOUBLE AS confidence, CASE r WHEN 3 THEN 'current_web' WHEN 4 THEN 'official_web' END AS required_source_type,
  concat_ws(',', CASE WHEN contains(text, 'ndoure') THEN 'temporal' END, CASE WHEN contains(text, 'entiin') THEN 'official' END, CASE WHEN contains(text, 'thinor') THEN 'local_scope' END, CASE WHEN contains(text, 'eranes') THEN 'harmful' END, CASE WHEN contains(text, 'tion ') THEN 'ambiguous' END) AS query_flags,
  NOT ok OR contains(text, 'ndoure') OR evidence_count < 2 OR top_score < 0.3 AS web_trigger FROM p""",
    "evidence_merge": """WITH {RER}, e AS (SELECT query_id, source_type, section_title AS doc_id, (doc_id % 7)::INTEGER AS a, (doc_id % 7 + 1)::INTEGER AS b, chunk_id::VARCHAR AS id, trim(text, ' ') AS t, final_score AS s FROM rer),
g AS (SELECT query_id, source_type, doc_id, list([{'a': a, 'b': b, 'id': id, 't': t, 's': s, 'm': []::VARCHAR[]}] ORDER BY a, b, -s, id, t) AS xs FROM e GROUP BY ALL),
k AS (SELECT query_id, source_type, doc_id, unnest(list_reduce(xs, lambda acc, x:
  CASE WHEN length(acc[-1].t) + length(x[1].t) <= 1200 AND CASE WHEN x[1].a <> 0 THEN x[1].a ELSE x[1].b END <= CASE WHEN acc[-1].b <> 0 THEN acc[-1].b ELSE acc[-1].a END + 1
  THEN acc[:-2] || [{'a': least(acc[-1].a, CASE WHEN x[1].a <> 0 THEN x[1].a ELSE acc[-1].a END), 'b': greatest(acc[-1].b, x[1].b, acc[-1].a), 'id': acc[-1].id,
    't': CASE WHEN acc[-1].t = '' THEN x[1].t WHEN x[1].t = '' OR contains(acc[-1].t, x[1].t) THEN acc[-1].t ELSE acc[-1].t || chr(10) || x[1].t END, 's': greatest(acc[-1].s, x[1].s), 'm': acc[-1].m || [x[1].id]}]
  ELSE acc || x END)) AS k FROM g)
SELECT query_id, source_type, doc_id, doc_id AS evidence_group, k.id AS chunk_id, k.t AS text, k.s AS final_score, k.a AS page_start, k.b AS page_end, array_to_string(k.m, ',') AS merged_chunk_ids FROM k""".replace("{RER}", RER),
    "context_pack": f"WITH {PACK} SELECT query_id, chunk_id, evidence_id, pos::INTEGER AS pos, length(block)::INTEGER AS n, length(t2)::INTEGER AS n_text, used::BIGINT AS used FROM pack",
    "used_citations": f"WITH {PACK} SELECT m.query_id, marker, use_no, chunk_id FROM marks m JOIN pack p ON p.query_id = m.query_id AND p.evidence_id = m.marker",
    "invalid_citations": f"WITH {PACK} SELECT query_id, marker FROM marks m WHERE NOT EXISTS (SELECT 1 FROM pack p WHERE p.query_id = m.query_id AND p.evidence_id = m.marker)",
    "intent_route": f"SELECT conv_id, turn, {_case(1)} AS intent, {_case(2)} AS sub_intent, {_case(3)} AS need_rag, {_case(4)} AS need_memory, {_case(5)} AS need_safety_notice, {SOURCE} AS source FROM conversations WHERE role = 'user'",
    "intent_merge": f"""WITH q AS (SELECT doc_id, text FROM documents), r AS (SELECT q.doc_id, {_case(1)} AS i, {_case(2)} AS s, {SOURCE} AS src, toxic, quality FROM q LEFT JOIN labels l USING (doc_id))
SELECT intent, sub_intent, source, count(*) AS n FROM (SELECT CASE WHEN src = 'hard_rule' OR coalesce(quality, 0) = 0 THEN i WHEN toxic = 1 THEN 'reject' ELSE 'rag' END AS intent, CASE WHEN src = 'hard_rule' OR coalesce(quality, 0) = 0 THEN s ELSE 'model' END AS sub_intent,
  CASE WHEN src = 'hard_rule' OR coalesce(quality, 0) = 0 THEN src ELSE 'llm' END AS source FROM r) GROUP BY ALL""",
}
ORACLE_SQL["web_evidence"] = f"""WITH base AS ({WEB_CHUNKS_SQL}), p AS (SELECT page_id, page_id // 10 AS query_id, url, (length(html) % 100) / 100 AS score FROM pages),
e AS (SELECT query_id, substr(sha1(coalesce(url, '') || '|' || text || '|' || chunk_no), 1, 20) AS chunk_id, substr(sha1(CASE WHEN url <> '' THEN url ELSE 'result-' || page_id END), 1, 16) AS doc_id, chunk_no, score, text FROM base JOIN p USING (page_id))
SELECT query_id, chunk_id, doc_id, chunk_no, round(greatest(score, 0) / (100 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)), 9) AS fusion_score, text FROM e"""
