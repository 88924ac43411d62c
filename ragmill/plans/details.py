"""Queries of the smaller operators: evidence rules, model output, session upkeep, audits and metric tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragmill.operators import catalog as C
from ragmill.operators import evaluate as V
from ragmill.operators import evidence as E
from ragmill.operators import index as I
from ragmill.operators import memory as M
from ragmill.operators import route as T
from ragmill.plans import evaluation
from ragmill.plans.memory import messages, sessions
from ragmill.plans.retrieval import table


def sanitize_texts(spark, sf):
    return table(spark, sf, "pages").select("page_id", I.sanitize(F.col("html")).alias("clean"), I.sanitize(F.col("html"), 20_000).alias("longer"))


def parent_evidence(spark, sf):
    """Documents as children of every tenth one; a parent whose id ends in 50 has a blank text."""
    d = table(spark, sf, "documents")
    c = d.select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") - F.col("doc_id") % 10).alias("parent_id"), "text")
    p = d.where("doc_id % 10 = 0").select(F.col("doc_id").alias("parent_id"), F.when(F.col("doc_id") % 100 == 50, " ").otherwise(F.col("text")).alias("parent_text"))
    return E.to_evidence(c, p).select("chunk_id", "parent_id", "text")


def answer_flags(spark, sf):
    """Turns as answers: whether they end up sufficient, and whether they were given without evidence."""
    m = messages(spark, sf).withColumn("context", F.when(F.col("message_id") % 2 == 0, "").otherwise(F.col("content")))
    answer = F.when(F.col("message_id") % 5 == 0, F.concat(F.lit("证据不足"), F.col("content"))).otherwise(F.col("content"))
    intent = F.when(F.col("role") == "user", "rag").otherwise("chat")
    return m.select("session_id", "message_id", E.final_sufficient(F.col("message_id") % 3 > 0, F.col("message_id") % 4, answer).alias("sufficient"), E.hallucination_flag(intent, F.col("context"), answer).alias("hallucinated"))


def template_answers(spark, sf):
    """Turns as context of one line of evidence, answered by the template."""
    context = F.when(F.col("message_id") % 4 == 3, "").otherwise(F.concat(F.lit("[L"), F.col("message_id"), F.lit("]\n正文："), F.col("content"), F.lit("\n[W1]\n正文：end")))
    action = F.when(F.col("message_id") % 7 == 5, "refuse").when(F.col("message_id") % 7 == 6, "ask_clarify").otherwise("answer_local")
    return E.template_answer(messages(spark, sf).select("session_id", "message_id", action.alias("action"), context.alias("context"))).select("session_id", "message_id", "answer")


def parsed_output(spark, sf):
    """Events as what a model wrote: an object in a fence, one without, and text without any."""
    e = table(spark, sf, "events")
    body = F.concat(F.lit('{"intent": "'), F.col("event_type"), F.lit('", "user": '), F.col("user_id"), F.lit("}"))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("so "), body, F.lit("."))).otherwise("no object")
    return e.select("event_id", T.parse_json_object(text, "intent string, user long").alias("o")).select("event_id", "o.intent", "o.user")


def bounded_steps(spark, sf):
    """Each session's turns as recorded steps, to which one more is added."""
    g = messages(spark, sf).groupBy("session_id").agg(F.array_sort(F.collect_list(F.col("message_id").cast("int"))).alias("steps"))
    return g.select("session_id", F.array_join(M.append_bounded(F.col("steps"), F.lit(-1), 4), ",").alias("steps"))


def deleted_sessions(spark, sf):
    s, m = sessions(spark, sf), messages(spark, sf)
    states = m.groupBy("session_id").agg(F.count("*").alias("n"))
    marked, left = M.delete_sessions(s, states, s.where("session_id % 3 = 0").select("session_id"), F.timestamp_seconds(F.lit(1_000)))
    return marked.join(left, "session_id", "left").select("session_id", F.unix_seconds("deleted_at").alias("deleted_at"), "n")


def metrics_long(spark, sf):
    return V.long_form(evaluation.hit_recall_mrr(spark, sf))


def audit_short(spark, sf):
    """The shortest documents of each source."""
    d = table(spark, sf, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("section_id"), F.lit(0).alias("parent_no"), F.lit(0).alias("child_no"), "text")
    return C.audit_samples(d, 5, 400).select("doc_id", "section_id", "n", "rank")


def audit_auxiliary(spark, sf):
    """Documents as auxiliary chunks: German ones as tables, French ones as captions."""
    kind = F.when(F.col("lang") == "de", "table").when(F.col("lang") == "fr", "figure_caption").otherwise("section")
    return C.audit_auxiliary(table(spark, sf, "documents").select(F.col("source").alias("doc_id"), kind.alias("chunk_type"), "text"))


QUERIES = {f.__name__: f for f in (sanitize_texts, parent_evidence, answer_flags, template_answers, parsed_output, bounded_steps, deleted_sessions, metrics_long, audit_short, audit_auxiliary)}

SQL_CLEAN = "trim(regexp_replace(regexp_replace(html, '[\\x00-\\x1f\\x7f�]', ' ', 'g'), '\\s+', ' ', 'g'))"
SQL_ANSWER = "CASE WHEN turn % 5 = 0 THEN '证据不足' || text ELSE text END"
ORACLE_SQL = {
    "sanitize_texts": f"SELECT page_id, substr({SQL_CLEAN}, 1, 1000) AS clean, substr({SQL_CLEAN}, 1, 20000) AS longer FROM pages",
    "parent_evidence": """SELECT c.doc_id AS chunk_id, c.doc_id - c.doc_id % 10 AS parent_id, CASE WHEN p.doc_id % 100 <> 50 AND trim(p.text, ' ') <> '' THEN p.text ELSE c.text END AS text
FROM documents c LEFT JOIN documents p ON p.doc_id = c.doc_id - c.doc_id % 10""",
    "answer_flags": f"""SELECT conv_id AS session_id, turn AS message_id,
  turn % 3 > 0 AND turn % 4 > 0 AND NOT (contains({SQL_ANSWER}, '证据不足') OR contains({SQL_ANSWER}, '无法回答') OR contains({SQL_ANSWER}, '不能回答')) AS sufficient,
  role = 'user' AND (turn % 2 = 0 OR trim(text, ' ') = '') AND NOT contains({SQL_ANSWER}, '证据不足') AS hallucinated FROM conversations""",
    "template_answers": """SELECT conv_id AS session_id, turn AS message_id, CASE WHEN turn % 7 = 5 THEN '无法回答该请求。' WHEN turn % 7 = 6 THEN '请说明所指的内容。' WHEN turn % 4 = 3 THEN '证据不足，无法回答。'
  ELSE '根据检索到的证据：' || substr(regexp_extract(text, '^[^\\n]*') || '；end', 1, 450) || ' ' || CASE WHEN true THEN '[L' || turn || '][W1]' END END AS answer FROM conversations""",
    "parsed_output": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN event_type END AS intent, CASE WHEN event_id % 3 < 2 THEN user_id::BIGINT END AS user FROM events",
    "bounded_steps": "SELECT conv_id AS session_id, array_to_string((list(turn::INTEGER ORDER BY turn) || [-1])[-4:], ',') AS steps FROM conversations GROUP BY 1",
    "deleted_sessions": """SELECT conv_id AS session_id, CASE WHEN conv_id % 7 = 0 THEN 0 WHEN conv_id % 3 = 0 THEN 1000 END::BIGINT AS deleted_at, CASE WHEN conv_id % 3 <> 0 THEN count(*) END AS n FROM conversations GROUP BY conv_id""",
    "metrics_long": f"WITH x AS ({evaluation.ORACLE_SQL['hit_recall_mrr']}) SELECT * FROM x UNPIVOT INCLUDE NULLS (value FOR metric IN (hit, recall, precision, mrr))",
    "audit_short": "SELECT source AS doc_id, doc_id AS section_id, length(text)::INTEGER AS n, row_number() OVER (PARTITION BY source ORDER BY length(text), doc_id)::INTEGER AS rank FROM documents WHERE length(text) < 400 QUALIFY rank <= 5",
    "audit_auxiliary": "SELECT source AS doc_id, count(*) FILTER (lang = 'de') AS n_tables, count(*) FILTER (lang = 'fr') AS n_captions, round(avg(length(text)), 4) AS mean_length FROM documents GROUP BY ROLLUP (source)",
}
