"""Conversation and memory queries: conversations as sessions, turns as time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragmill.operators import memory as M
from ragmill.plans.retrieval import table

#: Signals in the language of these tables.
ACTION, CONSTRAINT, DECISION = "(tion|que)", "(?:the|la) (.{2,20})", "(?:ention|ement).{4,}"
SIGNALS = {"preference": "(heed|eau)", "language": "(thor|ment).{0,30}(the|la)", "project": "(ingwh|oire)", "workflow": "(eratble|anon)", "constraint": "(ndou|vi).{2,30}", "sensitive": "(?i)(password|secret|xxyy)", "transient": "(?i)(error|stst)"}


def messages(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("message_id"), (F.col("conv_id") % 10).alias("user_id"), "role", F.col("text").alias("content"), F.col("turn").alias("created_at"))


def sessions(spark, sf):
    t = lambda c: F.timestamp_seconds(c)
    m = messages(spark, sf).groupBy("session_id", "user_id").agg(F.count("*").alias("n"))
    return m.select("session_id", "user_id", t(F.col("session_id") * 60).alias("updated_at"), F.when(F.col("session_id") % 7 == 0, t(F.lit(0))).alias("deleted_at"))


def recent_sessions(spark, sf):
    return M.list_sessions(sessions(spark, sf), 5).select("user_id", "session_id", "rank")


def recent_messages(spark, sf):
    return M.recent_messages(messages(spark, sf), 3).select("session_id", "message_id", "role", "pos")


def recent_context(spark, sf):
    return M.recent_context(messages(spark, sf), 3)


def session_tokens(spark, sf):
    s = sessions(spark, sf).withColumn("updated_at", F.lit(2).cast("long"))
    return M.touch_sessions(s, messages(spark, sf)).select("session_id", "updated_at", "tokens")


def requested_messages(spark, sf):
    """Each session asks for its last two messages; ids are unique over all sessions."""
    m = messages(spark, sf).withColumn("message_id", F.concat_ws("-", "session_id", "message_id"))
    last = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("created_at", "message_id")), asc=False), 1, 2), lambda x: x["message_id"])
    r = m.groupBy(F.col("session_id").alias("request_id")).agg(last.alias("ids"))
    return M.messages_by_ids(r, m).select("request_id", "pos", "message_id", "role")


def session_state(spark, sf):
    return M.session_state(messages(spark, sf), action=ACTION, constraint=CONSTRAINT).withColumn("constraints", F.array_join("constraints", "|"))


def latest_states(spark, sf):
    """Every turn an update of its session's state; sessions that are deleted reject theirs."""
    m = messages(spark, sf).select("session_id", F.col("message_id").alias("updated_at"), F.col("role").alias("current_step"))
    states = m.where("updated_at = 0")
    kept, _ = M.upsert_states(states, m, sessions(spark, sf))
    return kept


def rolling_summary(spark, sf):
    return M.rolling_summary(messages(spark, sf), at_least=5, keep=2, most=400, decision=DECISION)


def context_fit(spark, sf):
    s = messages(spark, sf).select("session_id", F.col("message_id").alias("pos"), F.col("role").alias("title"), F.col("content").alias("body"))
    return M.fit_sections(s, 1500)


def importance(spark, sf):
    return M.score_importance(messages(spark, sf), "content", SIGNALS).select("session_id", "message_id", "importance", "confidence", "memory_type", F.array_join("tags", ",").alias("tags"), "reason")


def memory_candidates(spark, sf):
    t = messages(spark, sf).where("role = 'user'").select(F.concat_ws("-", "session_id", "message_id").alias("turn_id"), "user_id", "content")
    return M.extract_candidates(t, 2, SIGNALS).select("turn_id", "sentence_no", "content", "importance", "confidence", "rank")


def memories(spark, sf):
    v = table(spark, sf, "embeddings")
    kind = F.element_at(F.array(F.lit("semantic"), F.lit("episodic"), F.lit("procedural")), (F.col("vec_id") % 3 + 1).cast("int"))
    return v.select(F.col("vec_id").alias("memory_id"), F.col("label").alias("user_id"), kind.alias("memory_type"), F.array(F.concat(F.lit("t"), (F.col("vec_id") % 5).cast("string"))).alias("tags"), F.when(F.col("vec_id") % 6 == 0, "deleted").otherwise("active").alias("status"), (F.col("vec_id") % 10 / 10).alias("importance"), F.lit(0.5).alias("confidence"), F.timestamp_seconds(1_700_000_000 + F.col("vec_id") * 86_400).alias("created_at"), F.col("embedding").alias("vector"))


def candidates(spark, sf):
    v = table(spark, sf, "embeddings").where("vec_id % 6 = 0")
    return v.select((F.col("vec_id") + 1_000_000).alias("candidate_id"), F.col("label").alias("user_id"), F.lit(0.9).alias("importance"), F.lit(0.8).alias("confidence"), F.array(F.lit("new")).alias("tags"), F.col("embedding").alias("vector"))


def memory_dedup(spark, sf):
    new, merged = M.dedupe_memories(candidates(spark, sf), memories(spark, sf), near=0.3)
    return merged.select("candidate_id", "memory_id", "cosine")


def memory_merge(spark, sf):
    m = memories(spark, sf)
    _, merged = M.dedupe_memories(candidates(spark, sf), m, near=0.3)
    return M.merge_memories(m, merged).select("memory_id", "importance", "confidence", F.array_join("tags", ",").alias("tags"))


def decay_search(spark, sf):
    q = table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("user_id"), F.col("embedding").alias("vector"))
    return M.search_memories(q, memories(spark, sf), F.lit("2025-01-01 00:00:00"), 5, 0.05).select("query_id", "memory_id", "cosine", "score", "rank")


def memory_prompt(spark, sf):
    q = table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("user_id"), F.col("embedding").alias("vector"))
    h = M.search_memories(q, memories(spark, sf), F.lit("2025-01-01 00:00:00"), 5, 0.05)
    return M.memory_prompt(h.withColumn("content", F.concat(F.lit("memory "), F.col("memory_id"))))


def user_questions(spark, sf):
    return M.user_questions(messages(spark, sf), "the", 2).select("session_id", "message_id", "pos")


QUERIES = {f.__name__: f for f in (recent_sessions, recent_messages, recent_context, session_tokens, requested_messages, session_state, latest_states, rolling_summary, context_fit, importance, memory_candidates, memory_dedup, memory_merge, decay_search, memory_prompt, user_questions)}

MSG = "m AS (SELECT conv_id AS session_id, turn AS message_id, conv_id % 10 AS user_id, role, text AS content FROM conversations)"
SES = "s AS (SELECT DISTINCT conv_id AS session_id, conv_id % 10 AS user_id FROM conversations WHERE conv_id % 7 <> 0)"
SQ = "trim(regexp_replace(content, '\\s+', ' ', 'g'))"
CLIP = "CASE WHEN length({0}) > {1} THEN rtrim(substr({0}, 1, {1}), ' ') || '...' ELSE {0} END"
HIT = {n: f"regexp_matches(trim(TEXT), '{p}')" for n, p in SIGNALS.items()}


def _importance(t: str) -> str:
    h = {n: p.replace("TEXT", t) for n, p in HIT.items()}
    score = " + ".join(f"CASE WHEN {h[n]} THEN {w}::DOUBLE ELSE 0 END" for n, w in M.WEIGHTS.items())
    any_ = " OR ".join(h.values())
    conf = f"greatest(CASE WHEN {h['preference']} THEN 0.82 ELSE 0.6 END, CASE WHEN {h['language']} THEN 0.85 ELSE 0 END, CASE WHEN {h['project']} THEN 0.75 ELSE 0 END, CASE WHEN {h['workflow']} OR {h['constraint']} THEN 0.7 ELSE 0 END)::DOUBLE"
    tags = f"concat_ws(',', CASE WHEN {h['preference']} OR {h['language']} THEN 'preference' END, CASE WHEN {h['language']} THEN 'language' END, CASE WHEN {h['project']} THEN 'project' END, CASE WHEN {h['workflow']} THEN 'workflow' END, CASE WHEN {h['constraint']} THEN 'constraint' END)"
    reason = "concat_ws('；', " + ", ".join(f"CASE WHEN {h[n]} THEN '{r}' END" for n, r in M.REASONS.items()) + ")"
    ok = f"length(trim({t})) >= 6"
    return f"""CASE WHEN {ok} THEN round(greatest(0.0, least(1.0, {score})), 6) ELSE 0.0 END AS importance, CASE WHEN NOT ({ok}) THEN 0.0 WHEN {any_} THEN {conf} ELSE 0.3 END::DOUBLE AS confidence,
  CASE WHEN {ok} AND {h['workflow']} THEN 'procedural' ELSE 'semantic' END AS memory_type, CASE WHEN {ok} THEN {tags} ELSE '' END AS tags, CASE WHEN NOT ({ok}) THEN '文本过短' WHEN {any_} THEN {reason} ELSE '无明确高价值信号' END AS reason"""


COS = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6)"
NEAR = f"""near AS (SELECT a.vec_id + 1000000 AS candidate_id, b.vec_id AS memory_id, {COS} AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id % 6 <> 0 WHERE a.vec_id % 6 = 0),
best AS (SELECT * FROM near WHERE cosine >= 0.3 QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY cosine DESC, memory_id DESC) = 1)"""
DECAY = f"""n AS (SELECT a.vec_id AS query_id, b.vec_id AS memory_id, {COS} AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id % 6 <> 0 WHERE a.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) <= 15),
d AS (SELECT *, round(cosine * pow(0.5::DOUBLE, greatest(0.0, (epoch_us(TIMESTAMP '2025-01-01') - (1700000000 + memory_id * 86400)::BIGINT * 1000000)::DOUBLE / 86400000000) / [365.0, 90.0, 180.0][memory_id % 3 + 1]::DOUBLE) * (0.75 + 0.5 * (memory_id % 10)::DOUBLE / 10), 6) AS score FROM n),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id)::INTEGER AS rank FROM d WHERE score >= 0.05 QUALIFY rank <= 5)"""
ORACLE_SQL = {
    "recent_sessions": f"WITH {SES} SELECT user_id, session_id, row_number() OVER (PARTITION BY user_id ORDER BY session_id DESC)::INTEGER AS rank FROM s QUALIFY rank <= 5",
    "recent_messages": f"WITH {MSG}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY message_id DESC) AS r FROM m QUALIFY r <= 3) SELECT session_id, message_id, role, row_number() OVER (PARTITION BY session_id ORDER BY r DESC)::INTEGER AS pos FROM r",
    "recent_context": f"WITH {MSG}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY message_id DESC) AS r FROM m QUALIFY r <= 3) SELECT session_id, string_agg(CASE role WHEN 'user' THEN '用户' WHEN 'assistant' THEN '助手' ELSE role END || '：' || {CLIP.format('content', 500)}, chr(10) ORDER BY r DESC) AS context FROM r GROUP BY 1",
    "session_tokens": f"WITH {MSG} SELECT session_id, greatest(2, max(message_id))::BIGINT AS updated_at, sum(CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, length(content) // 2) END)::BIGINT AS tokens FROM m GROUP BY 1",
    "requested_messages": f"WITH {MSG}, r AS (SELECT session_id AS request_id, role, session_id || '-' || message_id AS message_id, (row_number() OVER (PARTITION BY session_id ORDER BY message_id DESC) - 1)::INTEGER AS pos FROM m QUALIFY pos < 2) SELECT request_id, pos, message_id, role FROM r",
    "session_state": f"""WITH {MSG}, u AS (SELECT session_id, message_id AS o, {SQ} AS q, trim(regexp_extract(content, '{CONSTRAINT}', 0)) AS c FROM m WHERE role = 'user'),
g AS (SELECT session_id, substr(arg_min(q, o), 1, 60) AS current_goal, substr(arg_max(q, o) FILTER (regexp_matches(q, '{ACTION}')), 1, 50) AS current_step FROM u GROUP BY 1), k AS (SELECT session_id, string_agg(c, '|' ORDER BY o) AS constraints FROM (SELECT session_id, c, min(o) AS o FROM u WHERE c <> '' GROUP BY ALL) GROUP BY 1)
SELECT session_id, current_goal, current_step, coalesce(constraints, '') AS constraints FROM g LEFT JOIN k USING (session_id)""",
    "latest_states": f"WITH {MSG}, l AS (SELECT session_id, message_id AS updated_at, role AS current_step FROM m WHERE session_id % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY message_id DESC) = 1) SELECT * FROM l UNION ALL SELECT session_id, message_id, role FROM m WHERE message_id = 0 AND session_id % 7 = 0",
    "rolling_summary": f"""WITH {MSG}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY message_id DESC) AS r, count(*) OVER (PARTITION BY session_id) AS n FROM m), old AS (SELECT * FROM r WHERE n >= 5 AND r > 2),
q AS (SELECT session_id, list({SQ} ORDER BY r DESC) AS qs FROM old WHERE role = 'user' AND {SQ} <> '' GROUP BY 1),
d0 AS (SELECT session_id, r, unnest(range(len(ds))) AS i, trim(unnest(ds)) AS d FROM (SELECT session_id, r, regexp_extract_all(content, '{DECISION}') AS ds FROM old)),
d1 AS (SELECT session_id, r, i, {CLIP.format('d', 100)} AS d FROM d0 WHERE d <> '' QUALIFY row_number() OVER (PARTITION BY session_id, substr({CLIP.format('d', 100)}, 1, 20) ORDER BY r DESC, i) = 1),
d AS (SELECT session_id, list(d ORDER BY r DESC, i) AS ds FROM d1 GROUP BY 1),
t AS (SELECT o.session_id, concat_ws(chr(10), CASE WHEN len(qs) > 0 THEN '最初目标：' || {CLIP.format('qs[1]', 80)} END, CASE WHEN len(qs) > 1 THEN '历史问题：' || array_to_string(list_transform(qs[2:][-8:], lambda x: {CLIP.format('x', 60)}), '；') END, CASE WHEN len(ds) > 0 THEN '关键决定：' || array_to_string(ds[-5:], '；') END) AS s FROM (SELECT DISTINCT session_id FROM old) o LEFT JOIN q USING (session_id) LEFT JOIN d USING (session_id))
SELECT session_id, {CLIP.format('s', 400)} AS summary FROM t""",
    "context_fit": """WITH b AS (SELECT conv_id AS session_id, turn AS pos, '# ' || role || chr(10) || trim(text, ' ') || chr(10) AS block FROM conversations WHERE trim(text, ' ') <> ''),
u AS (SELECT *, sum(length(block)) OVER w AS upto FROM b WINDOW w AS (PARTITION BY session_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
o AS (SELECT *, sum((upto > 1500)::INTEGER) OVER (PARTITION BY session_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS over, 1500 - (upto - length(block)) AS left_over FROM u),
p AS (SELECT session_id, pos, over, CASE WHEN over = 0 THEN block WHEN over = 1 AND left_over > 200 THEN rtrim(substr(block, 1, left_over::BIGINT), ' ') || chr(10) || '[已截断]' || chr(10) END AS block FROM o)
SELECT session_id, trim(regexp_replace(coalesce(string_agg(block, chr(10) ORDER BY pos), ''), '^\\s+|\\s+$', '', 'g'), ' ') AS text, max(over) > 0 AS truncated FROM p GROUP BY 1""",
    "importance": f"WITH {MSG} SELECT session_id, message_id, {_importance('content')} FROM m",
    "memory_candidates": f"""WITH {MSG}, x AS (SELECT session_id || '-' || message_id AS turn_id, unnest(range(len(ss)))::INTEGER AS sentence_no, trim(unnest(ss)) AS s FROM (SELECT *, string_split_regex(content, '[。！？!?\\n；;]') AS ss FROM m WHERE role = 'user')),
y AS (SELECT turn_id, sentence_no, s, {_importance('s')} FROM x WHERE length(s) >= 6)
SELECT turn_id, sentence_no, CASE WHEN contains(tags, 'preference') THEN '用户偏好：' WHEN contains(tags, 'project') THEN '项目事实：' WHEN contains(tags, 'workflow') THEN '工作流程：' WHEN contains(tags, 'constraint') THEN '约束：' WHEN memory_type = 'procedural' THEN '流程：' ELSE '记忆：' END || regexp_replace(s, '[。！？!?. ]+$', '') AS content, importance, confidence, row_number() OVER (PARTITION BY turn_id ORDER BY importance DESC, sentence_no)::INTEGER AS rank FROM y WHERE importance > 0 QUALIFY rank <= 2""",
    "memory_dedup": f"WITH {NEAR} SELECT * FROM best",
    "memory_merge": f"WITH {NEAR}, g AS (SELECT memory_id, true AS hit FROM best GROUP BY 1) SELECT vec_id AS memory_id, greatest((vec_id % 10)::DOUBLE / 10, CASE WHEN hit THEN 0.9 ELSE 0 END)::DOUBLE AS importance, CASE WHEN hit THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN hit THEN 'new,' ELSE '' END || 't' || vec_id % 5 AS tags FROM embeddings LEFT JOIN g ON memory_id = vec_id",
    "decay_search": f"WITH {DECAY} SELECT query_id, memory_id, cosine, score, rank FROM hits",
    "memory_prompt": f"WITH {DECAY} SELECT query_id, string_agg('- [' || ['semantic', 'episodic', 'procedural'][memory_id % 3 + 1] || '|' || printf('%.2f', score) || '] memory ' || memory_id, chr(10) ORDER BY rank) AS prompt FROM hits GROUP BY 1",
    "user_questions": f"WITH {MSG}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY message_id DESC) AS r FROM m WHERE role = 'user' AND contains(content, 'the') QUALIFY r <= 2) SELECT session_id, message_id, row_number() OVER (PARTITION BY session_id ORDER BY r DESC)::INTEGER AS pos FROM r",
}
