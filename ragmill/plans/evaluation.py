"""Evaluation queries: benchmark items as cases, BM25 hits as retrieval, labels and events as router and latency rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragmill.operators import evaluate as V
from ragmill.operators import evidence as E
from ragmill.operators import retrieve as R
from ragmill.plans.evidence import SUFF, TERMS, WORDS, reranked
from ragmill.plans.retrieval import TOK, bench, bm25_sql, corpus, table


def cases(spark, sf):
    """An item asks for its own first 25 characters and two phrases most texts lack, and has itself as context."""
    t = F.col("text")
    g = F.when(F.col("query_id") % 5 == 4, F.array().cast("array<string>"))
    return bench(spark, sf).select(
        F.col("query_id").alias("case_id"), "text", F.coalesce(g, F.array(F.substring(t, 1, 25), F.substring(t, 30, 25), F.lit("zz top"))).alias("required"), F.coalesce(g, F.array(t)).alias("contexts"),
        F.array(F.concat(F.lit("/a/Src"), (F.col("query_id") % 20).cast("string"), F.lit(".pdf")), F.lit("src3")).alias("documents"),
        F.element_at(F.array(F.lit("single_doc"), F.lit("multi_doc"), F.lit("no_local_evidence"), F.lit("safety_rule_plus_local_doc")), (F.col("query_id") % 4 + 1).cast("int")).alias("scope"),
        F.when(F.col("query_id") % 3 == 0, "emergency").otherwise("rag").alias("intent"), F.when(F.col("query_id") % 2 == 0, "answer_with_local_evidence").otherwise("refuse_or_clarify").alias("behavior"),
    )


def hits(spark, sf):
    h = R.bm25(bench(spark, sf), corpus(spark, sf), 10)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), "text", F.lit("").alias("title"), F.col("lang").alias("section"), F.lit("section").alias("chunk_type"))
    return R.beside_texts(h, d).withColumnRenamed("query_id", "case_id")


def hit_recall_mrr(spark, sf):
    c = cases(spark, sf)
    return V.retrieval_metrics(c, V.annotate(c, hits(spark, sf)))


def context_coverage(spark, sf):
    c = cases(spark, sf)
    return V.coverage(c, V.annotate(c, hits(spark, sf)))


def doc_hit(spark, sf):
    return V.doc_hits(cases(spark, sf), hits(spark, sf))


def details(spark, sf):
    c = cases(spark, sf)
    m = V.retrieval_metrics(c, V.annotate(c, hits(spark, sf)))
    none = F.lit("")
    return m.join(c.select("case_id", V.groups(F.col("intent"), F.col("behavior"), none, F.col("scope"), none).alias("groups")), "case_id")


def group_summary(spark, sf):
    return V.group_summary(V.long_form(details(spark, sf)))


def stage_averages(spark, sf):
    c, h = cases(spark, sf), hits(spark, sf)
    m = None
    for name, part in (("first3", h.where("rank <= 3")), ("sparse", h)):
        x = V.retrieval_metrics(c, V.annotate(c, part)).withColumn("stage", F.lit(name))
        m = x if m is None else m.unionByName(x)
    return V.averages(V.long_form(m), ["stage", "metric", "k"])


def failure_topn(spark, sf):
    return V.failures(details(spark, sf), 5).select("group", "rank", "case_id", "recall", "hit", "mrr")


def predictions(spark, sf):
    """Answers made of an item and its first hit, with all hits as contexts; every seventh case has none."""
    c = bench(spark, sf).where("query_id % 7 <> 6").select(F.col("query_id").alias("case_id"), F.col("text").alias("q"))
    h = hits(spark, sf).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("text").alias("t")))).alias("x"))
    p = c.join(h, "case_id", "left").withColumn("contexts", F.coalesce(F.transform("x", lambda r: r["t"]), F.array().cast("array<string>")))
    return p.select(
        "case_id", F.concat("q", F.lit("! "), F.coalesce(F.get("contexts", F.lit(0)), F.lit(""))).alias("answer"), "contexts", F.when(F.col("case_id") % 2 == 0, F.array("q")).otherwise(F.array().cast("array<string>")).alias("citations"),
        (F.size("contexts") > 1).alias("evidence_sufficient"), F.when(F.col("case_id") % 5 == 0, "use_web").otherwise("").alias("fallback_action"), F.array().cast("array<string>").alias("errors"),
    )


def answer_cases(spark, sf):
    m = F.create_map(F.lit("question_type"), F.when(F.col("case_id") % 6 == 0, "no_answer").when(F.col("case_id") % 6 == 1, "web_fallback").otherwise("fact"))
    return cases(spark, sf).select("case_id", "intent", F.array().cast("array<string>").alias("tags"), F.filter(F.slice(F.split("text", " "), 1, 12), lambda w: F.length(w) > 4).alias("keywords"), "required", F.col("text").alias("reference_answer"), m.alias("metadata"))


def answer_scores(spark, sf):
    return V.score_answers(answer_cases(spark, sf), predictions(spark, sf))


def answer_averages(spark, sf):
    return V.average_scores(answer_scores(spark, sf).drop("expected_action", "actual_action"))


def score_gate(spark, sf):
    return V.gate(answer_scores(spark, sf), 0.5)


def features(spark, sf):
    f = E.decide(E.sufficiency(E.sufficiency_features(bench(spark, sf), reranked(spark, sf), WORDS, TERMS), 0.3))
    e = F.when(F.col("query_id") % 4 == 0, "use_web").when(F.col("query_id") % 9 == 1, "refuse").otherwise("answer_local")
    return f.withColumn("expected_action", e).withColumnRenamed("action", "actual_action")


def calibration(spark, sf):
    return V.calibration_metrics(features(spark, sf))


def grid_search(spark, sf):
    return V.grid_search(features(spark, sf))


def router_rows(spark, sf):
    """Expected language against one guessed from single letters, as rows of a router evaluation."""
    t = F.lower("text")
    p = F.when(t.contains("ß") | t.contains("ü"), "de").when(t.contains("ñ"), "es").when(t.contains("è"), "fr").otherwise("en")
    return table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("expected"), p.alias("predicted"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("expected_sub"), F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("predicted_sub"),
        F.when(F.col("doc_id") % 4 == 0, "fallback_rule").otherwise("llm").alias("source"), F.col("source").alias("source_intent"), (F.col("n_chars") % 100 / 100).alias("confidence"), (F.col("lang") == "en").alias("expected_need_rag"), (p == "en").alias("need_rag"),
    )


def confusion(spark, sf):
    return V.confusion(router_rows(spark, sf))


def label_scores(spark, sf):
    return V.label_scores(V.confusion(router_rows(spark, sf)))


def router_summary(spark, sf):
    r = router_rows(spark, sf)
    return V.router_summary(r, V.label_scores(V.confusion(r)))


def grouped_accuracy(spark, sf):
    return V.grouped_accuracy(router_rows(spark, sf))


def flag_mismatches(spark, sf):
    return V.flag_mismatches(router_rows(spark, sf), ("need_rag",))


def label_conversion(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), F.when(F.col("doc_id") % 10 == 3, " ").otherwise(F.col("text")).alias("question"), F.col("lang").alias("intent"), F.create_map(F.lit("router_intent"), F.when(F.col("doc_id") % 50 == 0, "chat")).alias("metadata"))
    c = V.convert_labels(d, {"en": "paper", "fr": "emergency"})
    known = table(spark, sf, "documents").select(F.explode(F.array(F.lit("paper"), F.lit("rag"), F.lit("chat"))).alias("label")).distinct()
    return V.unknown_labels(c, known)


def latency_pct(spark, sf):
    return V.latency_summary(table(spark, sf, "events"), "value", ["event_type"])


QUERIES = {f.__name__: f for f in (hit_recall_mrr, context_coverage, doc_hit, group_summary, stage_averages, failure_topn, answer_scores, answer_averages, score_gate, calibration, grid_search, confusion, label_scores, router_summary, grouped_accuracy, flag_mismatches, label_conversion, latency_pct)}

CASES = """cases AS (SELECT item_id AS case_id, text, CASE WHEN item_id % 5 = 4 THEN [] ELSE [substr(text, 1, 25), substr(text, 30, 25), 'zz top'] END AS required, CASE WHEN item_id % 5 = 4 THEN [] ELSE [text] END AS contexts,
  ['src' || item_id % 20, 'src3'] AS documents, ['single_doc', 'multi_doc', 'no_local_evidence', 'safety_rule_plus_local_doc'][item_id % 4 + 1] AS scope, CASE WHEN item_id % 3 = 0 THEN 'emergency' ELSE 'rag' END AS intent, CASE WHEN item_id % 2 = 0 THEN 'answer_with_local_evidence' ELSE 'refuse_or_clarify' END AS behavior FROM benchmark)"""
MARKED = f"""{TOK}, {bm25_sql(10)}, {CASES},
ch AS (SELECT h.query_id AS case_id, h.rank, h.chunk_id, d.source AS doc_id, d.text, list_distinct(t.t) AS tok, lower(concat_ws(chr(10), d.text, '', d.lang, d.source, 'section')) AS hay FROM hits h JOIN documents d ON d.doc_id = h.chunk_id JOIN toks t ON t.chunk_id = h.chunk_id),
ctok AS (SELECT case_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_+#.\\-]+|[\\x{{4e00}}-\\x{{9fff}}]'), lambda x: lower(x))) AS ct FROM cases),
marked AS MATERIALIZED (SELECT c.case_id, rank, chunk_id, list_filter(required, lambda s: contains(hay, lower(s))) AS strings, len(contexts) > 0 AND (contains(ch.text, c.text) OR contains(c.text, ch.text) OR len(list_intersect(ct, tok))::DOUBLE / len(ct) >= 0.75) AS ctx, len(required) + len(contexts) AS n_gold FROM ch JOIN cases c USING (case_id) JOIN ctok USING (case_id)),
agg AS (SELECT case_id, k, count(*) AS n, count(*) FILTER (len(strings) > 0 OR ctx) AS n_hit, min(rank) FILTER (len(strings) > 0 OR ctx) AS first, len(list_distinct(flatten(list(strings)))) + max(ctx::INT) AS covered FROM marked, (VALUES (5), (10)) t(k) WHERE rank <= k GROUP BY ALL),
metrics AS MATERIALIZED (SELECT c.case_id, t.k, (len(required) + len(contexts))::INTEGER AS n_gold, CASE WHEN len(required) > 0 THEN CASE WHEN n_hit > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS hit, CASE WHEN len(required) > 0 THEN coalesce(round(covered::DOUBLE / (len(required) + len(contexts)), 4), 0.0) END AS recall,
  CASE WHEN len(required) > 0 THEN coalesce(round(n_hit::DOUBLE / n, 4), 0.0) END AS precision, CASE WHEN len(required) > 0 THEN coalesce(round(1.0::DOUBLE / first, 4), 0.0) END AS mrr FROM cases c CROSS JOIN (VALUES (5), (10)) t(k) LEFT JOIN agg a ON a.case_id = c.case_id AND a.k = t.k)"""
TAIL = MARKED[MARKED.index("agg AS (") :]
FIRST3 = TAIL.replace("agg AS (", "agg3 AS (", 1).replace("metrics AS", "metrics3 AS").replace("JOIN agg a", "JOIN agg3 a").replace("rank <= k", "rank <= k AND rank <= 3")
LOCAL = "behavior = 'answer_with_local_evidence' AND scope <> 'no_local_evidence'"
EMERGENCY = "(intent = 'emergency' OR scope = 'safety_rule_plus_local_doc')"
GROUPS = f"""grp AS (SELECT case_id, unnest(list_filter(['all', CASE WHEN {LOCAL} THEN 'local_answerable' END, CASE WHEN {LOCAL} AND scope <> 'multi_doc' THEN 'local_single_doc' END, CASE WHEN scope = 'multi_doc' THEN 'local_multi_doc' END,
  CASE WHEN scope = 'no_local_evidence' OR behavior = 'refuse_or_clarify' THEN 'fallback_safety_excluded' END, CASE WHEN {EMERGENCY} THEN 'emergency' END, CASE WHEN {EMERGENCY} THEN 'emergency_safety' END, CASE WHEN {EMERGENCY} AND scope <> 'no_local_evidence' THEN 'emergency_local_evidence' END], lambda g: g IS NOT NULL)) AS "group" FROM cases)"""
LONG = "(SELECT case_id, k, unnest(['hit', 'recall', 'precision', 'mrr']) AS metric, unnest([hit, recall, precision, mrr]) AS value FROM metrics)"
GUESS = "CASE WHEN contains(lower(text), 'ß') OR contains(lower(text), 'ü') THEN 'de' WHEN contains(lower(text), 'ñ') THEN 'es' WHEN contains(lower(text), 'è') THEN 'fr' ELSE 'en' END"
ROUTER = f"""r AS (SELECT doc_id, lang AS expected, {GUESS} AS predicted, CASE WHEN doc_id % 3 = 0 THEN source END AS expected_sub, 'src' || doc_id % 20 AS predicted_sub, CASE WHEN doc_id % 4 = 0 THEN 'fallback_rule' ELSE 'llm' END AS source, source AS source_intent, n_chars % 100 / 100.0 AS confidence FROM documents),
m AS (SELECT expected, predicted, count(*) AS n FROM r GROUP BY ALL), l AS (SELECT expected AS label FROM m UNION SELECT predicted FROM m),
ls AS (SELECT label, coalesce((SELECT sum(n) FROM m WHERE expected = label), 0)::BIGINT AS support, coalesce((SELECT sum(n) FROM m WHERE predicted = label), 0)::BIGINT AS np, coalesce((SELECT sum(n) FROM m WHERE expected = label AND predicted = label), 0)::BIGINT AS h FROM l),
pr AS (SELECT *, h::DOUBLE / greatest(np, 1) AS p, h::DOUBLE / greatest(support, 1) AS q FROM ls),
sc AS (SELECT label, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1, support FROM pr)"""
FEATS = f"""{SUFF}, f AS (SELECT *, contains(text, 'ndoure') AS kt, contains(text, 'entiin') AS ko, contains(text, 'thinor') AS kl, contains(text, 'eranes') AS kh, contains(text, 'tion ') AS ka, CASE WHEN query_id % 4 = 0 THEN 'use_web' WHEN query_id % 9 = 1 THEN 'refuse' ELSE 'answer_local' END AS e FROM judged)"""
ACT = "CASE WHEN kh THEN 'refuse' WHEN kl AND NOT ({0}) THEN 'answer_insufficient' WHEN kt THEN 'use_web' WHEN ko THEN 'use_web' WHEN {0} THEN 'answer_local' WHEN ka THEN 'ask_clarify' ELSE 'use_web' END"
PICK = "(SELECT list(value ORDER BY value) AS v, event_type FROM events GROUP BY 2)"
AT = "v[round_even((len(v) - 1) * {0}::DOUBLE, 0)::INTEGER + 1]"
ORACLE_SQL = {
    "hit_recall_mrr": f"WITH {MARKED} SELECT * FROM metrics",
    "context_coverage": f"""WITH {MARKED}, g AS (SELECT case_id, len(list_distinct(flatten(list(strings)))) AS s, max(ctx::INT) AS c FROM marked GROUP BY 1)
SELECT c.case_id, CASE WHEN len(required) > 0 THEN round(coalesce(s, 0)::DOUBLE / len(required), 4) END AS citation_hit_rate, CASE WHEN len(contexts) > 0 THEN round(coalesce(g.c, 0)::DOUBLE / len(contexts), 4) END AS context_coverage FROM cases c LEFT JOIN g USING (case_id)""",
    "doc_hit": f"""WITH {MARKED}, d AS (SELECT ch.case_id, k, count(DISTINCT doc_id) AS u, len(list_distinct(flatten(list(list_filter(list_distinct(documents), lambda n: contains(lower(concat_ws(chr(10), doc_id, '', substr(ch.text, 1, 500))), n)))))) AS n FROM ch JOIN cases USING (case_id), (VALUES (5), (10)) t(k) WHERE rank <= k GROUP BY ALL)
SELECT c.case_id, t.k, CASE WHEN coalesce(n, 0) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS doc_hit, round(coalesce(n, 0)::DOUBLE / len(list_distinct(documents)), 4) AS doc_recall, coalesce(u, 0) AS unique_docs FROM cases c CROSS JOIN (VALUES (5), (10)) t(k) LEFT JOIN d ON d.case_id = c.case_id AND d.k = t.k""",
    "group_summary": f"WITH {MARKED}, {GROUPS} SELECT \"group\", metric, k, count(DISTINCT case_id) AS n_cases, count(value) AS n_scored, round(avg(value), 4) AS average FROM {LONG} JOIN grp USING (case_id) GROUP BY ALL",
    "stage_averages": f"""WITH {MARKED}, {FIRST3}, l AS (SELECT 'sparse' AS stage, * FROM {LONG} UNION ALL SELECT 'first3', * FROM {LONG.replace("FROM metrics", "FROM metrics3")})
SELECT stage, metric, k, round(avg(value), 4) AS average, count(value) AS n_scored FROM l GROUP BY ALL""",
    "failure_topn": f"""WITH {MARKED}, {GROUPS} SELECT "group", row_number() OVER (PARTITION BY "group" ORDER BY coalesce(recall, 1), coalesce(hit, 1), coalesce(mrr, 1), case_id)::INTEGER AS rank, case_id, recall, hit, mrr FROM metrics JOIN grp USING (case_id) WHERE k = 10 QUALIFY rank <= 5""",
    "calibration": f"""WITH {FEATS}, a AS (SELECT e, {ACT.format("reason = 'local_evidence_sufficient'")} AS a FROM f)
SELECT round(count(*) FILTER (e = a)::DOUBLE / greatest(count(*), 1), 6) AS accuracy, round(count(*) FILTER (e = 'answer_local' AND a = 'answer_local')::DOUBLE / greatest(count(*) FILTER (e = 'answer_local'), 1), 6) AS local_recall, round(count(*) FILTER (e = 'use_web' AND a = 'use_web')::DOUBLE / greatest(count(*) FILTER (e = 'use_web'), 1), 6) AS web_recall,
  round(count(*) FILTER (e = 'use_web' AND a = 'use_web')::DOUBLE / greatest(count(*) FILTER (a = 'use_web'), 1), 6) AS web_precision, round(count(*) FILTER (e = 'answer_local' AND a = 'use_web')::DOUBLE / greatest(count(*) FILTER (e = 'answer_local'), 1), 6) AS false_web_rate,
  round(count(*) FILTER (e = 'use_web' AND a <> 'use_web')::DOUBLE / greatest(count(*) FILTER (e = 'use_web'), 1), 6) AS missed_web_rate, round(count(*) FILTER (e = 'refuse' AND a = 'refuse')::DOUBLE / greatest(count(*) FILTER (e = 'refuse'), 1), 6) AS refusal_accuracy, count(*) AS total FROM a""",
    "grid_search": f"""WITH {FEATS}, g AS (SELECT * FROM (SELECT unnest([0.12, 0.15, 0.18, 0.20, 0.22, 0.25, 0.28, 0.30]::DOUBLE[]) AS min_score), (SELECT unnest([1, 2, 3]) AS min_count), (SELECT unnest([0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.50]::DOUBLE[]) AS min_coverage)),
a AS (SELECT min_score, min_count, min_coverage, e, {ACT.format("top_score >= min_score AND evidence_count >= min_count AND cov >= min_coverage AND NOT kt")} AS a FROM f, g)
SELECT min_score, min_count, min_coverage, round(count(*) FILTER (e = a)::DOUBLE / count(*), 6) AS accuracy, round(0.35::DOUBLE * count(*) FILTER (e = 'use_web' AND a = e) / greatest(count(*) FILTER (e = 'use_web'), 1) + 0.25::DOUBLE * count(*) FILTER (e = 'answer_local' AND a = e) / greatest(count(*) FILTER (e = 'answer_local'), 1)
  + 0.15::DOUBLE * count(*) FILTER (e = 'refuse' AND a = e) / greatest(count(*) FILTER (e = 'refuse'), 1) - 0.20::DOUBLE * count(*) FILTER (e = 'answer_local' AND a = 'use_web') / greatest(count(*) FILTER (e = 'answer_local'), 1), 6) AS objective
FROM a GROUP BY ALL ORDER BY objective DESC, accuracy DESC, min_score, min_count, min_coverage LIMIT 5""",
    "confusion": f"WITH {ROUTER} SELECT * FROM m",
    "label_scores": f"WITH {ROUTER} SELECT * FROM sc",
    "router_summary": f"WITH {ROUTER} SELECT count(*) AS total, round(avg((expected = predicted)::INT), 6) AS accuracy, round(avg((expected_sub = predicted_sub)::INT), 6) AS sub_accuracy, count(*) FILTER (source = 'fallback_rule') AS n_fallback, count(*) FILTER (confidence < 0.75) AS n_low_confidence, (SELECT round(avg(f1), 6) FROM sc) AS macro_f1 FROM r",
    "grouped_accuracy": f"WITH {ROUTER} SELECT 'source' AS key, source AS value, count(*) AS n, round(avg((expected = predicted)::INT), 6) AS accuracy FROM r GROUP BY 2 UNION ALL SELECT 'source_intent', source_intent, count(*), round(avg((expected = predicted)::INT), 6) FROM r GROUP BY 2",
    "flag_mismatches": f"WITH {ROUTER} SELECT 'need_rag' AS flag, count(*) FILTER ((expected = 'en') <> (predicted = 'en')) AS mismatches FROM r",
    "label_conversion": "SELECT case_id, expected FROM (SELECT doc_id AS case_id, CASE WHEN doc_id % 50 = 0 THEN 'chat' WHEN lang = 'en' THEN 'paper' WHEN lang = 'fr' THEN 'emergency' ELSE 'rag' END AS expected FROM documents WHERE trim(CASE WHEN doc_id % 10 = 3 THEN ' ' ELSE text END) <> '') WHERE expected NOT IN ('paper', 'rag', 'chat')",
    "latency_pct": f"SELECT event_type, len(v)::BIGINT AS n, round(list_avg(v), 6) AS mean, {AT.format(0.5)} AS p50, {AT.format(0.9)} AS p90, {AT.format(0.95)} AS p95 FROM {PICK}",
}

_TERMS = "list_distinct(list_transform(regexp_extract_all({0}, '[A-Za-z0-9_]{{2,}}'), lambda x: lower(x)))"
_HELD = "len(list_filter({0}, lambda w: contains({1}, w)))"
_SHARE = "CASE WHEN len({0}) > 0 THEN round({1}::DOUBLE / len({0}), 4) ELSE 1.0::DOUBLE END"
_TOTAL = " + ".join(f"{w}::DOUBLE * {n}" for n, w in V.WEIGHTS.items())
SCORED = f"""{TOK}, {bm25_sql(10)}, {CASES},
ctx AS (SELECT query_id AS case_id, list(d.text ORDER BY rank) AS found FROM hits h JOIN documents d ON d.doc_id = h.chunk_id GROUP BY 1),
j AS (SELECT c.case_id, intent, c.text AS ref, list_filter(list_transform(string_split(c.text, ' ')[1:12], lambda w: trim(w, ' ')), lambda w: length(w) > 4) AS keywords, list_filter(list_transform(required, lambda w: trim(w, ' ')), lambda w: w <> '') AS required,
  c.case_id % 7 <> 6 AS known, CASE WHEN c.case_id % 7 <> 6 THEN c.text || '! ' || coalesce(found[1], '') ELSE '' END AS answer, CASE WHEN c.case_id % 7 <> 6 THEN coalesce(array_to_string(found, chr(10)), '') ELSE '' END AS context,
  CASE WHEN c.case_id % 7 <> 6 AND c.case_id % 2 = 0 THEN c.text ELSE '' END AS cited, c.case_id % 7 <> 6 AND coalesce(len(found), 0) > 1 AS enough FROM cases c LEFT JOIN ctx USING (case_id)),
t AS MATERIALIZED (SELECT *, {_TERMS.format("ref")} AS rt, {_TERMS.format("answer")} AS at_, {_TERMS.format("context")} AS ct,
  list_transform(list_filter(list_transform(string_split_regex(answer, '[。！？!?]\\s*'), lambda y: trim(y, ' ')), lambda y: y <> ''), lambda y: {_TERMS.format("y")}) AS st FROM j),
parts AS (SELECT *, {_SHARE.format("keywords", _HELD.format("keywords", "answer"))} AS answer_keyword_recall, {_SHARE.format("keywords", _HELD.format("keywords", "context"))} AS context_keyword_recall,
  CASE WHEN len(rt) = 0 THEN 1.0 WHEN len(at_) = 0 THEN 0.0 ELSE round(len(list_intersect(rt, at_))::DOUBLE / len(rt), 4) END::DOUBLE AS reference_overlap,
  CASE WHEN len(required) > 0 THEN round({_HELD.format("required", "cited || chr(10) || context")}::DOUBLE / len(required), 4) WHEN trim(cited, ' ') <> '' THEN 1.0 ELSE 0.0 END::DOUBLE AS citation_score,
  CASE WHEN len(st) = 0 THEN 0.0 WHEN len(ct) = 0 THEN CASE WHEN contains(answer, '证据不足') THEN 1.0 ELSE 0.0 END
    ELSE round(len(list_filter(st, lambda y: len(y) > 0 AND (len(list_intersect(y, ct))::DOUBLE / len(y) >= 0.25 OR len(list_filter(y, lambda w: length(w) >= 3 AND contains(context, w))) > 0)))::DOUBLE / len(st), 4) END::DOUBLE AS groundedness,
  CASE WHEN intent = 'emergency' AND NOT ({" OR ".join(f"contains(answer, '{w}')" for w in V.SAFETY_TERMS)}) THEN 0.0 ELSE 1.0 END::DOUBLE AS safety,
  CASE WHEN case_id % 6 = 0 THEN 'answer_insufficient' WHEN case_id % 6 = 1 THEN 'use_web' ELSE 'answer_local' END AS expected_action, CASE WHEN known AND case_id % 5 = 0 THEN 'use_web' WHEN enough THEN 'answer_local' ELSE 'answer_insufficient' END AS actual_action FROM t),
whole AS (SELECT *, CASE WHEN trim(ref, ' ') <> '' THEN round(0.6::DOUBLE * answer_keyword_recall + 0.4::DOUBLE * reference_overlap, 4) ELSE answer_keyword_recall END AS completeness FROM parts),
scored AS MATERIALIZED (SELECT case_id, reference_overlap, {", ".join(V.WEIGHTS)}, round({_TOTAL}, 4) AS overall, expected_action, actual_action, actual_action = expected_action AS fallback_correct,
  CASE WHEN expected_action = 'answer_local' THEN enough ELSE NOT enough END AS sufficiency_correct, actual_action = 'use_web' AS web_triggered, actual_action = 'use_web' AND expected_action <> 'use_web' AS false_web, expected_action = 'use_web' AND actual_action <> 'use_web' AS missed_web, NOT known AS has_error FROM whole)"""
_VALUES, _FLAGS = ["reference_overlap", *V.WEIGHTS, "overall"], ["fallback_correct", "sufficiency_correct", "web_triggered", "false_web", "missed_web", "has_error"]
ORACLE_SQL["answer_scores"] = f"WITH {SCORED} SELECT * FROM scored"
ORACLE_SQL["answer_averages"] = f"WITH {SCORED} SELECT count(*) AS n, {', '.join(f'round(avg({c}), 4) AS {c}' for c in _VALUES)}, {', '.join(f'round(avg({c}::INTEGER), 4) AS {c}' for c in _FLAGS)} FROM scored"
ORACLE_SQL["score_gate"] = f"WITH {SCORED} SELECT round(avg(overall), 4) AS overall, round(avg(overall), 4) >= 0.5 AS passed FROM scored"
