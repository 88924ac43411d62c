"""Queries of short-term context, memory answers, Chinese metadata, captions, auxiliary chunks, stage lists and length distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragmill.operators import catalog as C
from ragmill.operators import evaluate as V
from ragmill.operators import index as I
from ragmill.operators import ingest as N
from ragmill.operators import memory as M
from ragmill.plans import memory as memory_plan
from ragmill.plans import retrieval
from ragmill.plans.catalog import PICKED
from ragmill.plans.ingest import DOC_LINES, SQUEEZE, children_sql, papers
from ragmill.plans.ingest import ORACLE_SQL as INGEST_SQL
from ragmill.plans.evidence import RER
from ragmill.plans.memory import messages
from ragmill.plans.retrieval import TOKENS, table
from ragmill.sources import readers as S


def states(spark, sf):
    """Each session's state as its turns would leave it: questions pending, answers as results, first and last turn pinned."""
    m = messages(spark, sf).withColumn("message_id", F.concat_ws("-", "session_id", "message_id"))
    turn = F.struct(F.col("pos"), F.col("message_id"), F.col("role"), F.col("content"))
    g = m.withColumn("pos", F.element_at(F.split("message_id", "-"), -1).cast("int")).groupBy("session_id").agg(F.array_sort(F.collect_list(turn)).alias("x"))
    first, of = F.get("x", F.lit(0)), lambda role: F.filter("x", lambda t: t["role"] == role)
    texts = lambda role: F.transform(of(role), lambda t: t["content"])
    return g.select(
        "session_id", F.substring(first["content"], 1, 60).alias("current_goal"), F.lit(None).cast("string").alias("current_step"), F.array(first["role"], F.lit(" ")).alias("constraints"), texts("user").alias("pending_items"), F.array().cast("array<string>").alias("completed_items"),
        F.concat_ws(" ", "session_id", F.size("x")).alias("rolling_summary"), F.transform(of("assistant"), lambda t: F.struct(t["message_id"].alias("step"), F.lit("").alias("status"), t["content"].alias("summary"))).alias("intermediate_results"),
        F.array(F.element_at("x", -1)["message_id"], first["message_id"], F.lit("none")).alias("pinned_message_ids"),
    )


def context_parts(spark, sf):
    """All parts of each session's short-term context."""
    m = messages(spark, sf).withColumn("created_at", F.col("message_id")).withColumn("message_id", F.concat_ws("-", "session_id", "message_id"))
    return M.context_sections(states(spark, sf), m, 4, 5)


def short_context(spark, sf):
    """The short-term context of each session, fitted into its budget."""
    return M.fit_sections(context_parts(spark, sf))


def memory_answers(spark, sf):
    """The memories that answer a question about them, from each query's memory prompt; every other question is on a topic."""
    p = memory_plan.memory_prompt(spark, sf)
    return M.memory_lines(p.withColumn("query", F.when(F.col("query_id") % 200 == 0, "我的笔记偏好").otherwise("what do you know")).withColumn("prompt", F.regexp_replace("prompt", "memory (\\d*[05])\\b", "标题 $1")))


def metadata_chinese(spark, sf):
    """Documents as the text of a Chinese paper: labelled authors, abstract and keywords; the title comes from the first page."""
    text = F.concat(F.lit("作者："), F.col("lang"), F.lit("甲、"), F.col("source"), F.lit("乙等\n摘 要："), F.col("text"), F.lit("\n关键词："), F.col("lang"), F.lit("；"), F.col("source"), F.lit("，ok\n第1章 end"))
    d = table(spark, sf, "documents").select("doc_id", F.lit("/x/CNKI.pdf").alias("source_path"), F.lit("untitled").alias("raw_title"), text.alias("text"))
    return N.paper_metadata(d).withColumns({"authors": F.array_join("authors", ","), "keywords": F.array_join("keywords", ",")})


def _captioned(spark, sf):
    return papers(spark, sf).withColumn("text", F.concat(F.lit("Fig. 1-2: "), F.replace("text", F.lit("\n"), F.lit("\n图 3 "))))


def figure_captions(spark, sf):
    """Lines of documents as captions."""
    return N.captions(_captioned(spark, sf)).select("doc_id", "caption_no", "caption")


def auxiliary(spark, sf):
    """Navigation tables and captions as chunks of their own."""
    nav = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract("html", "(?s)<nav>(.*?)</nav>", 1), "<ul>", "<tr>"), "</ul>", "</tr>"), "(</?)li>", "$1td>")
    t = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page_number"), F.when(F.col("page_id") % 2 == 0, F.col("url")).alias("title"), N.table_rows(nav).alias("rows"))
    return N.auxiliary_chunks(t, N.captions(_captioned(spark, sf))).select("doc_id", "title", F.array_join("path", "/").alias("path"), "text", "chunk_type", "page_number")


def previews(spark, sf):
    return table(spark, sf, "pages").select("page_id", I.preview(F.concat("html", F.lit("\x01end"))).alias("preview"))


def stage_lists(spark, sf):
    """Both sparse legs as one table of ranked chunks with their stage."""
    return V.stages(bm25=retrieval.bm25_topk(spark, sf), hashed=retrieval.sparse_topk(spark, sf))


def title_words(spark, sf):
    """Words of titles that have Chinese for some words, without stop words."""
    from ragmill.plans.kept import _in_cjk

    t = table(spark, sf, "documents").select(_in_cjk(F.col("text")).alias("paper_title"))
    return C.title_words(t, spark.createDataFrame([("烟气",)], "word string"))


def sections_of(spark, sf):
    return table(spark, sf, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("section_id"), F.get(F.split("text", "\n"), F.lit(0)).alias("title"), "text")


def audit_lengths(spark, sf):
    s = sections_of(spark, sf)
    return C.audit_lengths(s, N.chunk_sections(s))


def audit_rollup(spark, sf):
    """Counts of the audit by source and over all; the title of a section is its first line."""
    return C.audit_sections(N.chunk_sections(sections_of(spark, sf))).withColumn("doc_id", F.coalesce("doc_id", F.lit("*")))


QUERIES = {f.__name__: f for f in (context_parts, short_context, memory_answers, metadata_chinese, figure_captions, auxiliary, previews, stage_lists, title_words, audit_lengths, audit_rollup)}

LINE = "CASE role WHEN 'user' THEN '用户' WHEN 'assistant' THEN '助手' ELSE role END || '：' || CASE WHEN length(content) > 500 THEN rtrim(substr(content, 1, 500), ' ') || '...' ELSE content END"
PARTS = f"""m AS (SELECT conv_id AS session_id, turn, role, text AS content, {LINE.replace("content", "text")} AS line FROM conversations),
g AS (SELECT session_id, count(*) AS n, arg_min(content, turn) AS first_text, arg_min(role, turn) AS first_role, min(turn) AS first_turn, max(turn) AS last_turn,
  string_agg('- ' || content, chr(10) ORDER BY turn) FILTER (role = 'user' AND trim(content, ' ') <> '') AS pending, string_agg('- ' || concat_ws('：', session_id || '-' || turn, nullif(content, '')), chr(10) ORDER BY turn) FILTER (role = 'assistant') AS results FROM m GROUP BY 1),
last4 AS (SELECT session_id, string_agg(line, chr(10) ORDER BY turn) AS body FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 4) GROUP BY 1),
parts AS (
  SELECT session_id, 0 AS pos, substr(first_text, 1, 60) AS body FROM g UNION ALL SELECT session_id, 2, '- ' || first_role FROM g UNION ALL SELECT session_id, 3, coalesce(pending, '') FROM g UNION ALL SELECT session_id, 4, '' FROM g
  UNION ALL SELECT session_id, 5, session_id || ' ' || n FROM g UNION ALL SELECT session_id, 6, coalesce(results, '') FROM g
  UNION ALL SELECT g.session_id, 7, a.line || chr(10) || b.line FROM g JOIN m a ON a.session_id = g.session_id AND a.turn = last_turn JOIN m b ON b.session_id = g.session_id AND b.turn = first_turn
  UNION ALL SELECT session_id, 8, body FROM last4),
titled AS (SELECT session_id, pos, [{", ".join(f"'{t}'" for t in M.CONTEXT_TITLES)}][pos + 1] AS title, body FROM parts)"""
CJK_TEXT = "'作者：' || lang || '甲、' || source || '乙等' || chr(10) || '摘 要：' || text || chr(10) || '关键词：' || lang || '；' || source || '，ok' || chr(10) || '第1章 end'"
NOISE_LINES = " OR ".join(f"x = '{w}' OR starts_with(x, '{w}:') OR starts_with(x, '{w}：')" for w in N.TITLE_NOISE)
CAPTIONS = f"""{DOC_LINES.replace("regexp_replace(text,", "regexp_replace('Fig. 1-2: ' || replace(text, chr(10), chr(10) || '图 3 '),")},
caps AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INTEGER AS caption_no, line AS caption FROM lines WHERE regexp_matches(line, '{N.CAPTION}'))"""
_DESCRIBED = f"len(v)::BIGINT AS n, round(list_avg(v), 6) AS mean, list_median(v)::DOUBLE AS median, v[1] AS least, v[-1] AS most, {', '.join(f'{PICKED.format(p / 100)} AS p{p}' for p in (10, 25, 75, 90, 95))}"
SECS = "secs AS (SELECT source AS doc_id, doc_id AS section_id, string_split(text, chr(10))[1] AS title, text FROM documents)"
AUDIT = f"""{SECS}, {children_sql("secs", "doc_id, section_id, title")}"""
ODD = "regexp_matches(title, '[\\x{E000}-\\x{F8FF}\\x{FFFD}]') OR (length(title) >= 6 AND length(regexp_replace(title, '[A-Za-z0-9\\x{4e00}-\\x{9fff}]', '', 'g'))::DOUBLE / length(title) >= 0.45) OR (length(title) >= 8 AND length(regexp_replace(title, '[A-Za-z\\x{4e00}-\\x{9fff}]', '', 'g'))::DOUBLE / length(title) >= 0.65)"

ORACLE_SQL = {
    "context_parts": f"WITH {PARTS} SELECT * FROM titled",
    "short_context": f"""WITH {PARTS}, b AS (SELECT session_id, pos, '# ' || title || chr(10) || trim(body, ' ') || chr(10) AS block FROM titled WHERE trim(body, ' ') <> ''),
u AS (SELECT *, sum(length(block)) OVER w AS upto FROM b WINDOW w AS (PARTITION BY session_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
o AS (SELECT *, sum((upto > 3500)::INTEGER) OVER (PARTITION BY session_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS over, 3500 - (upto - length(block)) AS left_over FROM u),
p AS (SELECT session_id, pos, over, CASE WHEN over = 0 THEN block WHEN over = 1 AND left_over > 200 THEN rtrim(substr(block, 1, left_over::BIGINT), ' ') || chr(10) || '[已截断]' || chr(10) END AS block FROM o)
SELECT session_id, trim(regexp_replace(coalesce(string_agg(block, chr(10) ORDER BY pos), ''), '^\\s+|\\s+$', '', 'g'), ' ') AS text, max(over) > 0 AS truncated FROM p GROUP BY 1""",
    "memory_answers": f"""WITH p AS (SELECT query_id, query_id % 200 = 0 AS topic, regexp_replace(prompt, 'memory (\\d*[05])\\b', '标题 \\1', 'g') AS prompt FROM ({memory_plan.ORACLE_SQL["memory_prompt"]})),
l AS (SELECT query_id, topic, list_filter(list_transform(string_split(prompt, chr(10)), lambda x: trim(regexp_replace(regexp_replace(trim(x, ' '), '^-\\s*\\[[^\\]]+\\]\\s*', ''), '^[- ]+', ''), ' ')), lambda x: x <> '') AS ls FROM p),
f AS (SELECT *, list_filter(ls, lambda x: regexp_matches(x, '火灾|笔记|中文|英文|标题|格式')) AS fs FROM l),
t AS (SELECT query_id, (CASE WHEN topic AND len(fs) > 0 THEN fs ELSE ls END)[1:5] AS ms FROM f)
SELECT query_id, unnest(range(1, len(ms) + 1))::INTEGER AS pos, unnest(ms) AS memory FROM t""",
    "metadata_chinese": f"""WITH d AS MATERIALIZED (SELECT doc_id, source, lang, {CJK_TEXT} AS text FROM documents), l AS (SELECT *, string_split(text, chr(10)) AS ls FROM d),
y AS (SELECT doc_id, unnest(regexp_extract_all('CNKI' || chr(10) || array_to_string(ls[1:120], chr(10)), '(?:19|20)\\d{{2}}'))::INTEGER AS y FROM l),
b AS (SELECT doc_id, y FROM (SELECT doc_id, y, count(*) AS n FROM y GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, y) = 1),
t AS (SELECT doc_id, list_filter(list_transform(ls[1:40], lambda z: {SQUEEZE.format("z")}), lambda x: length(x) BETWEEN 6 AND 80 AND NOT ({NOISE_LINES}) AND NOT regexp_matches(x, '^(?:19|20)\\d{{2}}$'))[1:8] AS c FROM l),
w AS (SELECT doc_id, coalesce((SELECT arg_min(q[1], -length(q[1]) * 100 + q[2]) FROM (SELECT unnest(list_zip(c, range(len(c)))) AS q)), '') AS t1 FROM t)
SELECT d.doc_id, CASE WHEN t1 <> '' AND NOT regexp_matches(lower(t1), '{"|".join(N.BAD_TITLES)}') THEN t1 ELSE 'CNKI' END AS paper_title,
  array_to_string(list_filter([lang || '甲', source || '乙'], lambda p: length(p) > 1 AND length(p) <= 12), ',') AS authors, b.y AS year,
  substr({SQUEEZE.format("regexp_extract(text, '(?s)(?:^|\\n)\\s*摘\\s*要\\s*[:：]?\\s*(.*?)\\n\\s*(?:关\\s*键\\s*词|关键字|Abstract|目\\s*录|第[一二三四五六七八九十百\\d]+[章节]|1[.．、\\s]|引言|绪论)', 1)")}, 1, 3000) AS abstract,
  array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_extract(text, '(?:关\\s*键\\s*词|关键字)\\s*[:：]?\\s*([^\\n]{{2,200}})', 1), '\\s+', '', 'g'), '[;；,，、]+'), lambda k: length(k) > 1 AND length(k) <= 40), ',') AS keywords
FROM d LEFT JOIN b USING (doc_id) JOIN w USING (doc_id)""",
    "figure_captions": f"WITH {CAPTIONS} SELECT * FROM caps",
    "auxiliary": f"""WITH {CAPTIONS}, nav AS ({INGEST_SQL["page_links"]})
SELECT page_id AS doc_id, CASE WHEN page_id % 2 = 0 AND url IS NOT NULL THEN url ELSE 'Table on page 1' END AS title, '表格' AS path, text, 'table' AS chunk_type, 1 AS page_number FROM nav JOIN pages USING (page_id) WHERE trim(text, ' ') <> ''
UNION ALL SELECT doc_id, substr(caption, 1, 80), '图注', caption, 'figure_caption', 1 FROM caps""",
    "previews": "SELECT page_id, regexp_replace(html || chr(1) || 'end', '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}]', '', 'g') AS preview FROM pages",
    "stage_lists": f"SELECT *, 'bm25' AS stage FROM ({retrieval.ORACLE_SQL['bm25_topk']}) UNION ALL BY NAME SELECT *, 'hashed' AS stage FROM ({retrieval.ORACLE_SQL['sparse_topk']})",
    "title_words": "WITH t AS (SELECT regexp_replace(regexp_replace(regexp_replace(text, '\\bthe\\b', '火灾', 'g'), '\\band\\b', '烟气', 'g'), '\\bof\\b', '疏散', 'g') AS t FROM documents) SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(t, '[\\x{4e00}-\\x{9fff}]{2,6}')) AS word FROM t) WHERE word <> '烟气' GROUP BY 1 ORDER BY n DESC, word LIMIT 25",
    "audit_lengths": f"""WITH {AUDIT}, per AS (SELECT doc_id, section_id, parent_no, any_value(length(parent_text)) AS p, count(*) AS c FROM child GROUP BY 1, 2, 3),
vals AS (SELECT doc_id, 'section' AS what, length(text) AS value FROM secs UNION ALL SELECT doc_id, 'parent', p FROM per UNION ALL SELECT doc_id, 'child', length(text) FROM child
  UNION ALL SELECT doc_id, 'children_per_parent', c FROM per UNION ALL SELECT doc_id, 'parents_per_section', count(*) FROM per GROUP BY doc_id, section_id),
g AS (SELECT doc_id, what, list(value ORDER BY value) AS v FROM vals GROUP BY 1, 2) SELECT doc_id, what, {_DESCRIBED} FROM g""",
}
_ROLLUP = f"""WITH {AUDIT}, x AS (SELECT *, length(text) AS n, length(parent_text) AS p, section_id || '|' || parent_no AS parent_id, {ODD} AS odd FROM child)
SELECT doc_id, count(DISTINCT section_id) AS n_sections, count(DISTINCT parent_id) AS n_parents, count(*) AS n_children, round(avg(n), 4) AS mean_child, round(avg(n::DOUBLE / p), 4) AS mean_ratio, count(*) FILTER (n < 50) AS n_short, count(*) FILTER (n > 800) AS n_long,
  count(DISTINCT CASE WHEN odd THEN section_id END) AS n_suspicious, round(count(*)::DOUBLE / count(DISTINCT parent_id), 4) AS children_per_parent FROM x GROUP BY ROLLUP (doc_id)"""
ORACLE_SQL["audit_sections"] = _ROLLUP
ORACLE_SQL["audit_rollup"] = f"SELECT * REPLACE (coalesce(doc_id, '*') AS doc_id) FROM ({_ROLLUP})"


def _layout(spark, sf):
    """Pages as layout JSON in the three shapes by turns: a title, nested text, a header and a table of the navigation."""
    nav = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract("html", "(?s)<nav>(.*?)</nav>", 1), "<ul>", "<tr>"), "</ul>", "</tr>"), "(</?)li>", "$1td>")
    piece = lambda c: F.array(F.struct(F.array(F.struct(c.alias("text"))).alias("content")))
    none = F.lit(None).cast("string")
    empty = F.lit(None).cast("array<struct<content:array<struct<text:string>>>>")
    made = lambda kind, title=none, body=empty, table=none, caption=empty: F.struct(F.lit(kind).alias("type"), F.lit(0).alias("page_idx"), title.alias("text"), body.alias("paragraph_content"), table.alias("table_body"), caption.alias("table_caption"))
    p = table(spark, sf, "pages").withColumn("lines", F.split(N.strip_html(F.col("html")), "\n"))
    blocks = F.array(made("title", F.col("url")), made("paragraph", body=F.transform("lines", lambda x: piece(x)[0])), made("header", F.lit("noise")), made("table", table=nav, caption=piece(F.col("url"))))
    shape = F.col("page_id") % 3
    json = F.when(shape == 0, F.to_json(F.array(blocks))).when(shape == 1, F.to_json(blocks)).otherwise(F.concat(F.lit('{"pdf_info":[{"page_idx":0,"para_blocks":'), F.to_json(blocks), F.lit("}]}")))
    return p.select(F.col("page_id").alias("doc_id"), F.when(shape == 0, "pages").when(shape == 1, "flat").otherwise("middle").alias("variant"), json.alias("json"))


def layout_sections(spark, sf):
    """Sections of pages that come as layout JSON, by the levels of its titles."""
    text, _, _ = S.route_blocks(S.layout_blocks(_layout(spark, sf)))
    return N.sections(text, F.col("level")).select("doc_id", "section_no", "title", F.array_join("path", "/").alias("path"), "level", "page_start", "text")


def layout_tables(spark, sf):
    _, tables, _ = S.route_blocks(S.layout_blocks(_layout(spark, sf)))
    return tables.select("doc_id", "page_number", "title", N.table_text(F.col("rows")).alias("text"))


QUERIES |= {"layout_sections": layout_sections, "layout_tables": layout_tables}
_PAGE_TEXT = INGEST_SQL["web_text"]
ORACLE_SQL["layout_sections"] = f"""WITH t AS (SELECT page_id AS doc_id, {SQUEEZE.format("text")} AS text FROM ({_PAGE_TEXT}))
SELECT doc_id, 1 AS section_no, {SQUEEZE.format("url")} AS title, {SQUEEZE.format("url")} AS path, 1 AS level, 1 AS page_start, text FROM t JOIN pages ON page_id = doc_id WHERE text <> ''"""
ORACLE_SQL["layout_tables"] = f"SELECT page_id AS doc_id, 1 AS page_number, {SQUEEZE.format('url')} AS title, text FROM ({INGEST_SQL['page_links']}) JOIN pages USING (page_id)"
ORACLE_SQL["local_and_web"] = f"""WITH {RER}, wc AS ({INGEST_SQL["web_chunks"]}),
w AS (SELECT page_id // 10 AS query_id, substr(sha1(coalesce(url, '') || '|' || text || '|' || chunk_no), 1, 20) AS chunk_id, text FROM wc JOIN pages USING (page_id)),
both_ AS (SELECT query_id, chunk_id::VARCHAR AS chunk_id, text, final_score AS fusion FROM rer
  UNION ALL SELECT query_id, chunk_id, text, 0.5::DOUBLE / (100 + row_number() OVER (PARTITION BY query_id ORDER BY chunk_id)) FROM w WHERE query_id IN (SELECT item_id FROM benchmark)),
one AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY fusion DESC) = 1),
tk AS (SELECT o.*, list_distinct({TOKENS.format("b.text")}) AS q, {TOKENS.format("o.text")} AS t FROM one o JOIN benchmark b ON b.item_id = o.query_id),
sc AS (SELECT query_id, chunk_id, fusion, round(CASE WHEN len(q) = 0 OR len(t) = 0 THEN least(fusion * 10, 0.05)
  ELSE 0.75::DOUBLE * len(list_intersect(q, t)) / len(q) + 0.1::DOUBLE * sqrt(len(list_filter(t, lambda x: list_contains(q, x)))::DOUBLE / len(t)) + least(fusion * 10, 0.15) END, 6) AS final_score FROM tk)
SELECT query_id, chunk_id, final_score, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, fusion DESC, chunk_id)::INTEGER AS rank FROM sc QUALIFY rank <= 10"""
