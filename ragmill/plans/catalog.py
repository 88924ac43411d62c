"""Catalogue, audit, index maintenance, trace and detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragmill.operators import catalog as C
from ragmill.operators import detect as D
from ragmill.operators import index as I
from ragmill.operators import traces as O
from ragmill.operators.ingest import chunk_sections
from ragmill.plans.retrieval import table


def chunks(spark, sf):
    """Documents as chunks: a source is a paper, deleted where doc_id ends in 7, without status where it ends in 3."""
    d = table(spark, sf, "documents")
    status = F.when(F.col("doc_id") % 10 == 7, "deleted").when(F.col("doc_id") % 10 != 3, "active")
    return d.select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_index"), F.concat(F.lit("Paper "), F.col("source")).alias("paper_title"), F.array("lang").alias("authors"), (2000 + F.regexp_replace("source", "[^0-9]", "").cast("int") % 12).alias("year"),
        F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise("").alias("abstract"), F.slice(F.split("text", " "), 1, 3).alias("keywords"), F.col("lang").alias("chunk_type"), F.col("source").alias("section"), "text", status.alias("status"), F.md5("source").alias("content_hash"),
    )


def paper_catalog(spark, sf):
    p = C.papers(chunks(spark, sf))
    return p.withColumn("authors", F.array_join("authors", ",")).withColumn("keywords", F.array_join("keywords", ","))


def paper_search(spark, sf):
    return C.search_papers(C.papers(chunks(spark, sf)), "src1", None, "chunks", 1, 5).select("doc_id", "chunk_count", "total")


def year_counts(spark, sf):
    return C.year_counts(C.papers(chunks(spark, sf)))


def keyword_top(spark, sf):
    return C.top_keywords(chunks(spark, sf), 30, 2)


def paper_detail(spark, sf):
    c = chunks(spark, sf)
    ids = c.select("doc_id").distinct()
    return C.paper_detail(c, ids).select("doc_id", "chunk_count", F.explode("chunks").alias("c")).select("doc_id", "chunk_count", "c.chunk_index", F.col("c.head").alias("head"))


def len_stats(spark, sf):
    return C.length_stats(chunks(spark, sf))


def len_hist(spark, sf):
    return C.length_histogram(chunks(spark, sf))


def chunks_per_doc(spark, sf):
    return C.chunks_per_document(chunks(spark, sf))


def by_chunk_type(spark, sf):
    return C.by_type(chunks(spark, sf))


def section_totals(spark, sf):
    return C.section_totals(chunks(spark, sf))


def children(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("section_id"), F.get(F.split("text", "\n"), F.lit(0)).alias("title"), "text")
    return chunk_sections(d)


def audit_sections(spark, sf):
    return C.audit_sections(children(spark, sf))


def audit_dist(spark, sf):
    return C.audit_distributions(table(spark, sf, "documents").select(F.col("source").alias("doc_id"), "text"))


def suspicious_headings(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("title"))
    return d.groupBy("doc_id").agg(F.count_if(C.suspicious_heading(F.col("title"))).alias("n_suspicious"), F.count("*").alias("n_lines"))


def upsert_merge(spark, sf):
    """A third of the chunks come again with another text, and some new ones."""
    old = chunks(spark, sf).select("chunk_id", "text")
    new = old.where("chunk_id % 3 = 0").select(F.when(F.col("chunk_id") % 2 == 0, F.col("chunk_id")).otherwise(-F.col("chunk_id")).alias("chunk_id"), F.lit("new").alias("text"))
    m = I.upsert(old, new)
    return m.groupBy((F.col("text") == "new").alias("is_new")).agg(F.count("*").alias("n"), F.sum("chunk_id").alias("ids"))


def content_hash_skip(spark, sf):
    c = chunks(spark, sf)
    names = table(spark, sf, "documents").select(F.explode(F.array("source", F.concat("source", F.lit("x")))).alias("doc_id")).distinct()
    return I.ingest_decision(names.withColumn("content_hash", F.when(F.col("doc_id").like("%1%"), F.md5("doc_id")).otherwise("other")), c)


def soft_delete(spark, sf):
    c = chunks(spark, sf)
    d = I.soft_delete(c, c.where("doc_id like '%2'").select("doc_id"))
    return d.groupBy("doc_id").agg(F.count_if("changed").alias("n_changed"), F.count_if(F.col("status") == "deleted").alias("n_deleted"))


def counts_by_doc(spark, sf):
    return I.counts_by_doc(chunks(spark, sf))


def status_backfill(spark, sf):
    fixed, counts = I.backfill_status(chunks(spark, sf))
    return counts.crossJoin(fixed.agg(F.count_if(F.col("status") == "active").alias("n_active")))


def outcome_summary(spark, sf):
    return I.outcome_summary(table(spark, sf, "documents").groupBy(F.col("source").alias("doc_id")).agg((F.sum("n_chars") > 100_000).alias("ok"), F.count("*").alias("chunks")))


def traces(spark, sf):
    """Sessions of a user and day as traces, events as steps."""
    e = table(spark, sf, "events")
    s = F.struct("event_id", F.col("event_type").alias("step_type"), F.when(F.col("event_type") == "error", "failed").when(F.col("value") > 50, "skipped").otherwise("success").alias("status"), F.bround(F.col("value") * 100, 0).cast("long").alias("latency_ms"))
    g = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.array_sort(F.collect_list(s)).alias("steps"))
    return g.select(F.concat_ws("-", "user_id", "day").alias("trace_id"), F.col("user_id").cast("string").alias("session_id"), F.lit("rag").alias("intent"), "start_time", "end_time", F.lit("success").alias("final_status"), F.concat(F.lit("goal "), F.col("user_id")).alias("goal"), "steps")


def trace_index(spark, sf):
    return O.trace_index(traces(spark, sf)).drop("start_time", "end_time")


def trace_steps(spark, sf):
    return O.step_accounting(O.steps(traces(spark, sf)))


def anchors(spark, sf):
    """Vectors as anchors: places from the first components, class scores from the next."""
    v = table(spark, sf, "embeddings")
    x = lambda i: F.get("embedding", F.lit(i)).cast("double")
    scores = F.transform(F.slice("embedding", 5, 4), lambda s: F.least(F.abs(s.cast("double")) * 4, F.lit(1.0)))
    return v.select("vec_id", F.col("label").cast("string").alias("job"), F.floor(F.col("vec_id") / 50).cast("int").alias("frame"), (x(0) * 20 + 50).alias("cx"), (x(1) * 20 + 50).alias("cy"), (F.abs(x(2)) * 200 + 20).alias("w"), (F.abs(x(3)) * 200 + 20).alias("h"), scores.alias("scores"), F.lit(2.0).alias("scale_x"), F.lit(1.5).alias("scale_y"))


def box_decode(spark, sf):
    b = D.decode_boxes(anchors(spark, sf))
    return b.groupBy("job", "frame", "class_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("x2") - F.col("x1")), 6).alias("width"), F.round(F.max("score"), 6).alias("best"))


def nms(spark, sf):
    six = [F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2", "score")]
    return D.suppress(D.decode_boxes(anchors(spark, sf)), 0.3).select("job", "frame", "class_id", *six)



def job_metrics(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("job"), F.col("event_id").alias("frame"), (F.col("event_id") % 9 != 0).alias("done"), F.col("value").alias("latency_ms"))
    return D.job_metrics(e)


QUERIES = {f.__name__: f for f in (paper_catalog, paper_search, year_counts, keyword_top, paper_detail, len_stats, len_hist, chunks_per_doc, by_chunk_type, section_totals, audit_sections, audit_dist, suspicious_headings, upsert_merge, content_hash_skip, soft_delete, counts_by_doc, status_backfill, outcome_summary, trace_index, trace_steps, box_decode, nms, job_metrics)}

CHUNKS = """c AS (SELECT doc_id AS chunk_id, source AS doc_id, 'Paper ' || source AS paper_title, lang, text, CASE WHEN doc_id % 10 = 7 THEN 'deleted' WHEN doc_id % 10 <> 3 THEN 'active' END AS status, 2000 + regexp_replace(source, '[^0-9]', '', 'g')::INTEGER % 12 AS year, CASE WHEN doc_id % 3 = 0 THEN text ELSE '' END AS abstract, string_split(text, ' ')[1:3] AS keywords, md5(source) AS content_hash FROM documents),
a AS (SELECT * FROM c WHERE status IS DISTINCT FROM 'deleted')"""
PICKED = "v[round_even((len(v) - 1) * {0}::DOUBLE, 0)::INTEGER + 1]"
ANCHOR = """anc AS (SELECT label::VARCHAR AS job, (vec_id // 50)::INTEGER AS frame, embedding[1]::DOUBLE * 20 + 50 AS cx, embedding[2]::DOUBLE * 20 + 50 AS cy, abs(embedding[3]::DOUBLE) * 200 + 20 AS w, abs(embedding[4]::DOUBLE) * 200 + 20 AS h, list_transform(embedding[5:8], lambda s: least(abs(s::DOUBLE) * 4, 1.0)) AS sc FROM embeddings)"""
ORACLE_SQL = {
    "paper_catalog": f"WITH {CHUNKS} SELECT doc_id, arg_min(paper_title, chunk_id) AS paper_title, arg_min(lang, chunk_id) AS authors, arg_min(year, chunk_id) AS year, arg_min(abstract, chunk_id) FILTER (abstract <> '') AS abstract, array_to_string(arg_min(keywords, chunk_id) FILTER (len(keywords) > 0), ',') AS keywords, count(*) AS chunk_count FROM a GROUP BY 1",
    "year_counts": f"WITH {CHUNKS}, p AS (SELECT doc_id, any_value(year) AS year, count(*) AS n FROM a GROUP BY 1) SELECT year, count(*) AS n_papers, sum(n)::BIGINT AS n_chunks FROM p GROUP BY 1",
    "paper_search": f"WITH {CHUNKS}, p AS (SELECT doc_id, count(*) AS chunk_count FROM a GROUP BY 1), h AS (SELECT * FROM p WHERE contains('paper ' || doc_id, 'src1')) SELECT doc_id, chunk_count, (SELECT count(*) FROM h) AS total FROM h ORDER BY chunk_count DESC, doc_id LIMIT 5",
    "keyword_top": f"WITH {CHUNKS} SELECT keyword, count(*) AS n FROM (SELECT unnest(keywords) AS keyword FROM c) WHERE length(keyword) >= 2 GROUP BY 1 ORDER BY n DESC, keyword LIMIT 30",
    "paper_detail": f"WITH {CHUNKS} SELECT doc_id, count(*) OVER (PARTITION BY doc_id) AS chunk_count, chunk_id AS chunk_index, substr(text, 1, 500) AS head FROM a",
    "len_stats": "WITH v AS (SELECT list(length(text) ORDER BY length(text)) AS v FROM documents) SELECT len(v)::BIGINT AS n, round(list_avg(v), 4) AS mean, list_median(v)::DOUBLE AS median, v[1] AS least, v[-1] AS most, round(list_stddev_samp(v), 4) AS stdev, v[len(v) // 10 + 1] AS p10, v[len(v) // 4 + 1] AS p25, v[len(v) * 3 // 4 + 1] AS p75, v[len(v) * 9 // 10 + 1] AS p90 FROM v",
    "len_hist": "WITH b AS (SELECT * FROM (VALUES (0, 0, 50), (1, 50, 100), (2, 100, 200), (3, 200, 300), (4, 300, 500), (5, 500, 800), (6, 800, 1000), (7, 1000, 1500), (8, 1500, 2000), (9, 2000, NULL)) t(bin_no, low, high)) SELECT bin_no, low, high, count(text) AS n, round(count(text) * 100.0 / sum(count(text)) OVER (), 2) AS pct FROM b LEFT JOIN documents ON length(text) >= low AND (high IS NULL OR length(text) < high) GROUP BY ALL",
    "chunks_per_doc": "SELECT count(*) AS n_docs, round(avg(c), 4) AS mean, median(c)::DOUBLE AS median, min(c) AS least, max(c) AS most FROM (SELECT source, count(*) AS c FROM documents GROUP BY 1)",
    "by_chunk_type": "SELECT lang AS chunk_type, count(*) AS n, round(avg(length(text)), 4) AS mean_length FROM documents GROUP BY 1",
    "section_totals": "SELECT source AS section, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY 1 ORDER BY n_chars DESC, section LIMIT 15",
    "audit_dist": f"WITH g AS (SELECT source AS doc_id, list(length(text) ORDER BY length(text)) AS v FROM documents GROUP BY 1) SELECT doc_id, len(v)::BIGINT AS n, round(list_avg(v), 6) AS mean, list_median(v)::DOUBLE AS median, v[1] AS least, v[-1] AS most, {', '.join(f'{PICKED.format(p / 100)} AS p{p}' for p in (10, 25, 75, 90, 95))} FROM g",
    "suspicious_headings": "WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents), u AS (SELECT doc_id, length(s) AS n, length(regexp_replace(s, '[^A-Za-z0-9\\x{4e00}-\\x{9fff}]', '', 'g')) AS w, length(regexp_replace(s, '[^A-Za-z\\x{4e00}-\\x{9fff}]', '', 'g')) AS l, regexp_matches(s, '[\\x{E000}-\\x{F8FF}\\x{FFFD}]') AS p FROM t) SELECT doc_id, count(*) FILTER (p OR (n >= 6 AND (n - w)::DOUBLE / n >= 0.45) OR (n >= 8 AND (n - l)::DOUBLE / n >= 0.65)) AS n_suspicious, count(*) AS n_lines FROM u GROUP BY 1",
    "upsert_merge": "WITH n AS (SELECT CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE -doc_id END AS chunk_id, 'new' AS text FROM documents WHERE doc_id % 3 = 0), m AS (SELECT doc_id AS chunk_id, text FROM documents WHERE doc_id NOT IN (SELECT chunk_id FROM n) UNION ALL SELECT * FROM n) SELECT text = 'new' AS is_new, count(*) AS n, sum(chunk_id)::BIGINT AS ids FROM m GROUP BY 1",
    "content_hash_skip": f"WITH {CHUNKS}, i AS (SELECT DISTINCT unnest([source, source || 'x']) AS doc_id FROM documents), h AS (SELECT doc_id, max(content_hash) AS h FROM a GROUP BY 1) SELECT i.doc_id, CASE WHEN h IS NULL THEN 'insert' WHEN h = CASE WHEN i.doc_id LIKE '%1%' THEN md5(i.doc_id) ELSE 'other' END THEN 'skipped' ELSE 'replace' END AS decision FROM i LEFT JOIN h USING (doc_id)",
    "soft_delete": f"WITH {CHUNKS} SELECT doc_id, count(*) FILTER (doc_id LIKE '%2' AND status IS DISTINCT FROM 'deleted') AS n_changed, count(*) FILTER (doc_id LIKE '%2' OR status = 'deleted') AS n_deleted FROM c GROUP BY 1",
    "counts_by_doc": f"WITH {CHUNKS} SELECT doc_id, count(*) AS n_chunks, max(content_hash) AS content_hash FROM a GROUP BY 1",
    "status_backfill": f"WITH {CHUNKS} SELECT count(*) AS scanned, count(*) FILTER (status IS NULL) AS migrated, count(*) FILTER (coalesce(status, 'active') = 'active') AS n_active FROM c",
    "outcome_summary": "WITH o AS (SELECT source AS doc_id, sum(n_chars) > 100000 AS ok, count(*) AS chunks FROM documents GROUP BY 1), r AS (SELECT doc_id, count(*) FILTER (ok) AS parsed, count(*) FILTER (NOT ok) AS failed, sum(chunks)::BIGINT AS chunks FROM o GROUP BY ROLLUP (doc_id)) SELECT *, CASE WHEN failed = 0 THEN 'ok' ELSE 'partial_failed' END AS status FROM r",
    "trace_index": "SELECT user_id || '-' || ts::DATE AS trace_id, user_id::VARCHAR AS session_id, 'rag' AS intent, round_even((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0, 0)::BIGINT AS latency_ms, 'success' AS final_status, count(*) FILTER (event_type = 'error')::INTEGER AS error_count, count(*)::INTEGER AS n_steps, 'goal ' || user_id AS goal FROM events GROUP BY user_id, ts::DATE",
    "trace_steps": f"WITH s AS (SELECT event_type AS step_type, CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 50 THEN 'skipped' ELSE 'success' END AS status, round_even(value * 100, 0)::BIGINT AS latency_ms FROM events), g AS (SELECT step_type, count(*) AS n_steps, count(*) FILTER (status = 'success') AS n_success, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (status = 'skipped') AS n_skipped, list(latency_ms ORDER BY latency_ms) FILTER (latency_ms IS NOT NULL) AS v FROM s GROUP BY 1) SELECT step_type, n_steps, n_success, n_failed, n_skipped, round(list_avg(v), 6) AS mean, {', '.join(f'{PICKED.format(p / 100)} AS p{p}' for p in (50, 90, 95))} FROM g",
    "box_decode": f"WITH {ANCHOR} SELECT job, frame, (list_position(sc, list_max(sc)) - 1)::INTEGER AS class_id, count(*) AS n, round(sum(w * 2.0), 6) AS width, round(max(list_max(sc)), 6) AS best FROM anc WHERE list_max(sc) > 0.35 GROUP BY ALL",
    "nms": f"""WITH {ANCHOR}, b AS (SELECT job, frame, (cx - w / 2) * 2.0 AS x1, (cy - h / 2) * 1.5 AS y1, (cx + w / 2) * 2.0 AS x2, (cy + h / 2) * 1.5 AS y2, (list_position(sc, list_max(sc)) - 1)::INTEGER AS class_id, list_max(sc) AS score FROM anc WHERE list_max(sc) > 0.35),
g AS (SELECT job, frame, list([{{'x1': x1::DOUBLE, 'y1': y1::DOUBLE, 'x2': x2::DOUBLE, 'y2': y2::DOUBLE, 'c': class_id, 's': score}}] ORDER BY score DESC, x1, y1, x2, y2, class_id) AS bs FROM b GROUP BY ALL),
k AS (SELECT job, frame, unnest(list_reduce(bs, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k:
  greatest(0.0, least(k.x2, x[1].x2) - greatest(k.x1, x[1].x1)) * greatest(0.0, least(k.y2, x[1].y2) - greatest(k.y1, x[1].y1)) / ((k.x2 - k.x1) * (k.y2 - k.y1) + (x[1].x2 - x[1].x1) * (x[1].y2 - x[1].y1)
    - greatest(0.0, least(k.x2, x[1].x2) - greatest(k.x1, x[1].x1)) * greatest(0.0, least(k.y2, x[1].y2) - greatest(k.y1, x[1].y1)) + 1e-6) > 0.3)) > 0 THEN acc ELSE acc || x END)) AS k FROM g)
SELECT job, frame, k.c AS class_id, round(k.x1, 6) AS x1, round(k.y1, 6) AS y1, round(k.x2, 6) AS x2, round(k.y2, 6) AS y2, round(k.s, 6) AS score FROM k""",
    "job_metrics": "SELECT event_type AS job, count(*) AS n_frames, count(*) FILTER (event_id % 9 <> 0) AS n_done, round(avg(value) FILTER (event_id % 9 <> 0), 4) AS mean_latency_ms, round(count(*) FILTER (event_id % 9 <> 0)::DOUBLE / count(*), 4) AS progress FROM events GROUP BY 1",
}
