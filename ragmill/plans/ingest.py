"""Cleaning and chunking queries: a document is a paper; for page furniture a source is one whose pages are its documents; pages are web results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragmill.operators import ingest as N
from ragmill.plans.retrieval import table

#: In these tables a heading is a line of one or two words with a full stop.
HEADING = "^[A-Z]\\w+( \\w+)?\\.$"


def pages(spark, sf):
    return table(spark, sf, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_number"), "text")


def papers(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page_number"), "text")


def boundary_noise(spark, sf):
    return N.boundary_noise(pages(spark, sf), share=0.02)


def clean_lines(spark, sf):
    return N.clean_lines(pages(spark, sf), N.boundary_noise(pages(spark, sf), share=0.02))


def clean_pages(spark, sf):
    return N.clean_pages(pages(spark, sf))


def section_split(spark, sf):
    s = N.sections(N.clean_lines(papers(spark, sf)), N.heading_level(F.col("line"), HEADING))
    return s.withColumn("path", F.array_join("path", "/"))


def chunk_fixed(spark, sf):
    t = table(spark, sf, "documents")
    return t.select("doc_id", F.posexplode(N.pieces(F.col("text"), 500, ())).alias("chunk_no", "text"))


def chunk_recursive(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("section_id"), "text")
    return N.chunk_sections(d).select("doc_id", "parent_no", "child_no", "text", F.length("text").alias("n_chars"))


def web_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", N.strip_html(F.col("html")).alias("text"))


def web_chunks(spark, sf):
    return web_text(spark, sf).select("page_id", F.posexplode(N.web_chunks(F.col("text"))).alias("chunk_no", "text"))


def page_links(spark, sf):
    """Lists of links as table rows: cells are the link texts of a page's navigation."""
    nav = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract("html", "(?s)<nav>(.*?)</nav>", 1), "<ul>", "<tr>"), "</ul>", "</tr>"), "(</?)li>", "$1td>")
    return table(spark, sf, "pages").select("page_id", N.table_text(N.table_rows(nav)).alias("text"))


def metadata_extract(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("/x/"), F.col("source"), F.lit("_"), F.col("lang"), F.lit(" (1).pdf")).alias("source_path"), F.lit("untitled").alias("raw_title"), "text")
    m = N.paper_metadata(d)
    return m.select("doc_id", "paper_title", F.array_join("authors", ",").alias("authors"), "year")


def build_chunks(spark, sf):
    p = papers(spark, sf)
    titles = p.select("doc_id").distinct().withColumn("paper_title", F.concat(F.lit("Paper "), F.col("doc_id")))
    return N.build_chunks(p, titles, N.heading_level(F.col("line"), HEADING)).select("chunk_id", "doc_id", "paper_title", "title", "chunk_index", "page_start", "page_end", "text")


QUERIES = {f.__name__: f for f in (boundary_noise, clean_lines, clean_pages, section_split, chunk_fixed, chunk_recursive, web_text, web_chunks, page_links, metadata_extract, build_chunks)}

SQUEEZE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
LINES = f"""raw AS MATERIALIZED (SELECT source AS doc_id, doc_id AS page_number, string_split(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '={{6,}}', '===', 'g'), chr(10)) AS ls FROM documents),
lines AS MATERIALIZED (SELECT doc_id, page_number, pos::INTEGER AS pos, {SQUEEZE.format("line")} AS line FROM (SELECT doc_id, page_number, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM raw))"""
NOISE = f"""cand AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY pos) AS a, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY pos DESC) AS z FROM lines WHERE length(line) BETWEEN 3 AND 80 OR regexp_matches(line, '^\\s*(第\\s*)?\\d{{1,4}}\\s*(页)?\\s*$')),
noise AS (SELECT c.doc_id, line FROM cand c JOIN (SELECT doc_id, count(DISTINCT page_number) AS n FROM raw GROUP BY 1) p USING (doc_id) WHERE n >= 3 GROUP BY c.doc_id, line HAVING sum((a <= 2)::INT + (z <= 2)::INT) >= greatest(3, floor(any_value(n) * 0.02::DOUBLE)))"""
KEPT = """kept1 AS (SELECT * FROM (SELECT *, sum((line = '')::INT) OVER (PARTITION BY doc_id, page_number ORDER BY pos) AS blanks FROM lines) WHERE line <> '' AND NOT regexp_matches(line, '^\\s*(第\\s*)?\\d{1,4}\\s*(页)?\\s*$')
  AND NOT contains(line, '中国知网') AND NOT contains(upper(line), 'CNKI') AND NOT (length(line) > 60 AND regexp_matches(line, '^\\s*(\\[\\d+\\]|\\d+\\s*[.．、])\\s*.{8,}$')) NOISE),
kept2 AS (SELECT * FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id, page_number ORDER BY pos) AS before FROM kept1) WHERE before IS NULL OR before <> line),
kept AS (SELECT doc_id, page_number, pos, line, coalesce(blanks > lag(blanks) OVER (PARTITION BY doc_id, page_number ORDER BY pos), false) AS gap FROM kept2)"""
DOC_LINES = LINES.replace("source AS doc_id, doc_id AS page_number", "doc_id, 1 AS page_number")
SECTIONS = f"""{DOC_LINES}, {KEPT.replace("NOISE", "")},
able AS (SELECT *, length(line) > 1 AND length(line) <= 90 AND NOT regexp_matches(line, '[。；，,;：]\\s*$') AS able FROM kept),
lev AS (
  SELECT *, CASE WHEN able AND (regexp_matches(line, '{N.COMMON_HEADING}') OR regexp_matches(line, '{N.CHAPTER_HEADING}')) THEN 1
    WHEN able AND regexp_matches(line, '{N.NUMBER_HEADING}') THEN least(length(regexp_replace(regexp_extract(line, '{N.NUMBER_HEADING}', 1), '[^.．]', '', 'g')) + 1, 6)
    WHEN regexp_matches(line, '{HEADING}') THEN 1 END AS lev FROM able),
isl AS (SELECT *, sum((lev IS NOT NULL)::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM lev),
s AS (
  SELECT doc_id, island, coalesce(max(line) FILTER (lev IS NOT NULL), '{N.BODY}') AS title, coalesce(max(lev), 1)::INTEGER AS level,
    regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (lev IS NULL), ''), '^\\s+|\\s+$', '', 'g') AS text FROM isl GROUP BY ALL),
folded AS (
  SELECT doc_id, unnest(list_reduce(list_prepend([{{'island': -1, 'level': 0, 'path': []::VARCHAR[]}}], list([{{'island': island::INTEGER, 'level': level, 'path': [title]}}] ORDER BY island)), lambda acc, x:
    acc || [{{'island': x[1].island, 'level': x[1].level, 'path': CASE WHEN x[1].level <= 1 THEN x[1].path ELSE acc[-1].path[1:x[1].level - 1]
      || list_transform(range(greatest(x[1].level - 1 - len(acc[-1].path[1:x[1].level - 1]), 0)), lambda i: coalesce(acc[-1].path[1:x[1].level - 1][-1], '{N.BODY}')) || x[1].path END}}])) AS h FROM s GROUP BY doc_id),
sect AS (
  SELECT s.*, array_to_string(h.path, '/') AS path, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.island)::INTEGER AS section_no
  FROM s JOIN folded f ON f.doc_id = s.doc_id AND h.island = s.island WHERE text <> '')"""
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def _sql_text(value: str) -> str:
    return "".join(f"chr({ord(c)})" if c < " " else f"'{c}'" for c in value).replace(")chr", ") || chr")


def pieces_sql(tag: str, source: str, keys: str, text: str, size: int) -> str:
    """CTEs up to ``{tag}p`` with the keys, x (the text) and ps, its pieces of at most ``size``."""
    steps = [f"{tag}0 AS MATERIALIZED (SELECT {keys}, x, [x] AS ps FROM (SELECT {keys}, {text} AS x FROM {source}))"]
    for i, sep in enumerate(map(_sql_text, N.SEPARATORS), 1):
        cut = f"list_transform(list_zip(string_split(p, {sep}), range(len(string_split(p, {sep})))), lambda q: q[1] || CASE WHEN q[2] < len(string_split(p, {sep})) - 1 THEN {sep} ELSE '' END)"
        steps.append(f"{tag}{i} AS (SELECT * REPLACE (flatten(list_transform(ps, lambda p: CASE WHEN length(p) > {size} THEN list_filter({cut}, lambda y: y <> '') ELSE [p] END)) AS ps) FROM {tag}{i - 1})")
    hard = f"list_transform(range((length(p) + {size - 1}) // {size}), lambda i: substr(p, i * {size} + 1, {size}))"
    steps.append(f"{tag}p AS MATERIALIZED (SELECT * REPLACE (flatten(list_transform(ps, lambda p: CASE WHEN length(p) > {size} THEN {hard} ELSE [p] END)) AS ps) FROM {tag}{len(N.SEPARATORS)})")
    return ",\n".join(steps)


def _fold(step: str) -> str:
    """A fold of ps over a struct of finished chunks and the one that is being filled."""
    return f"list_reduce(list_prepend({{'done': []::VARCHAR[], 'now': ''}}, list_transform(ps, lambda p: {{'done': []::VARCHAR[], 'now': p}})), lambda a, p: {step})"


def recursive_sql(tag: str, source: str, keys: str, text: str, size: int) -> str:
    """CTEs up to ``{tag}`` with the keys and cs, the trimmed chunks of a text without overlap."""
    step = f"CASE WHEN length(a.now) + length(p.now) <= {size} THEN {{'done': a.done, 'now': a.now || p.now}} ELSE {{'done': CASE WHEN a.now <> '' THEN a.done || [a.now] ELSE a.done END, 'now': p.now}} END"
    whole = STRIP.format(f"regexp_replace({text}, '\\n{{3,}}', chr(10) || chr(10), 'g')")
    return f"""{pieces_sql(tag, source, keys, whole, size)},
{tag}f AS (SELECT {keys}, {_fold(step)} AS f FROM {tag}p),
{tag} AS MATERIALIZED (SELECT {keys}, list_filter(list_transform(CASE WHEN f.now <> '' THEN f.done || [f.now] ELSE f.done END, lambda y: {STRIP.format("y")}), lambda y: y <> '') AS cs FROM {tag}f)"""


def children_sql(source: str, keys: str, parent: int = 1800, size: int = 800, overlap: int = 120) -> str:
    """CTEs up to ``child`` with the keys, parent_no, parent_text, child_no and text of all chunks of source(keys, text)."""
    more = f"{keys}, parent_no, parent_text"
    return f"""{recursive_sql("pa", source, keys, "text", parent)},
parent AS MATERIALIZED (SELECT {keys}, unnest(cs) AS parent_text, unnest(range(len(cs)))::INTEGER AS parent_no FROM pa),
{recursive_sql("ch", f"(SELECT * FROM parent WHERE length(parent_text) > {size})", more, "parent_text", size - overlap)},
base AS (SELECT * FROM ch UNION ALL SELECT {more}, [parent_text] FROM parent WHERE length(parent_text) <= {size}),
child AS MATERIALIZED (SELECT {more}, unnest(range(len(cs)))::INTEGER AS child_no, unnest(list_transform(list_zip(cs, range(len(cs))), lambda q: CASE WHEN q[2] = 0 THEN q[1] ELSE right(cs[q[2]], {overlap}) || q[1] END)) AS text FROM base)"""


WEB_STEP = f"""CASE WHEN length(a.now) + length(p.now) <= 800 THEN {{'done': a.done, 'now': a.now || p.now}}
  ELSE {{'done': CASE WHEN a.now <> '' THEN a.done || [{STRIP.format("a.now")}] ELSE a.done END, 'now': right(right(coalesce((CASE WHEN a.now <> '' THEN a.done || [{STRIP.format("a.now")}] ELSE a.done END)[-1], ''), 120) || p.now, 800)}} END"""
ORACLE_SQL = {
    "section_split": f"""WITH {SECTIONS} SELECT doc_id, section_no, substr(sha1(doc_id || '|' || section_no || '|' || title), 1, 16) AS section_id, title, path, level, 1 AS page_start, 1 AS page_end, text,
  CASE WHEN contains(title, '摘要') OR lower(title) = 'abstract' THEN 'abstract' WHEN contains(title, '参考文献') OR lower(title) = 'references' THEN 'references' WHEN contains(title, '关键词') THEN 'keywords' ELSE 'section' END AS chunk_type FROM sect""",
    "metadata_extract": """WITH y AS (SELECT doc_id, unnest(regexp_extract_all(concat_ws(chr(10), source || '_' || lang, array_to_string(string_split(text, chr(10))[1:120], chr(10))), '(?:19|20)\\d{2}'))::INTEGER AS y FROM documents),
b AS (SELECT doc_id, y FROM (SELECT doc_id, y, count(*) AS n FROM y GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, y) = 1)
SELECT d.doc_id, source AS paper_title, lang AS authors, b.y AS year FROM documents d LEFT JOIN b USING (doc_id)""",
    "boundary_noise": f"WITH {LINES}, {NOISE} SELECT * FROM noise",
    "clean_lines": f"WITH {LINES}, {NOISE}, {KEPT.replace('NOISE', 'AND NOT EXISTS (SELECT 1 FROM noise n WHERE n.doc_id = lines.doc_id AND n.line = lines.line)').replace('lines.doc_id', 'x.doc_id').replace('lines.line', 'x.line').replace('FROM lines) WHERE', 'FROM lines) x WHERE')} SELECT * FROM kept",
    "clean_pages": f"""WITH {LINES}, {KEPT.replace("NOISE", "")}
SELECT r.doc_id, r.page_number, coalesce(regexp_replace(t.text, '^\\n+', ''), '') AS text FROM raw r LEFT JOIN (SELECT doc_id, page_number, string_agg(CASE WHEN gap THEN chr(10) || chr(10) ELSE chr(10) END || line, '' ORDER BY pos) AS text FROM kept GROUP BY 1, 2) t USING (doc_id, page_number)""",
    "chunk_fixed": "SELECT doc_id, unnest(range(greatest(1, (length(text) + 499) // 500)))::INTEGER AS chunk_no, substr(text, (unnest(range(greatest(1, (length(text) + 499) // 500))) * 500 + 1)::INTEGER, 500) AS text FROM documents",
    "page_links": f"SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?s)<li>(.*?)</li>', 1), lambda c: {SQUEEZE.format(chr(39).join(['regexp_replace(c, ', '<[^>]+>', ', ', ' ', ', ', 'g', ')']))}), lambda c: true), chr(9)) AS text FROM pages",
    "web_text": """SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'),
  '(?i)</(p|div|li|tr|h[1-6]|article|section|table|ul|ol)>|<br */?>', chr(10), 'g'), '(?i)</t[dh]>', chr(9), 'g'), '<[^>]+>', ' ', 'g'), '[ \\x0b\\f\\r]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM pages""",
}
ORACLE_SQL["chunk_recursive"] = f"WITH {children_sql('documents', 'doc_id')} SELECT doc_id, parent_no, child_no, text, length(text)::INTEGER AS n_chars FROM child"
ORACLE_SQL["web_chunks"] = f"""WITH w AS (SELECT page_id, text FROM ({ORACLE_SQL["web_text"]})), {pieces_sql("wp", "w", "page_id", "text", 800)},
f AS (SELECT page_id, x, {_fold(WEB_STEP)} AS f FROM wpp),
c AS (SELECT page_id, CASE WHEN length(x) <= 800 THEN list_filter([x], lambda y: y <> '')
  ELSE list_filter(CASE WHEN {STRIP.format("f.now")} <> '' THEN f.done || [{STRIP.format("f.now")}] ELSE f.done END, lambda y: {STRIP.format("y")} <> '') END[1:3] AS cs FROM f)
SELECT page_id, unnest(range(len(cs)))::INTEGER AS chunk_no, unnest(cs) AS text FROM c"""
ORACLE_SQL["build_chunks"] = f"""WITH {SECTIONS}, named AS (SELECT *, substr(sha1(doc_id || '|' || section_no || '|' || title), 1, 16) AS section_id FROM sect),
{children_sql("named", "doc_id, section_no, section_id, title")},
x AS (SELECT *, substr(sha1(section_id || '|' || parent_no || '|' || left(parent_text, 120)), 1, 16) AS parent_id, (row_number() OVER (PARTITION BY doc_id ORDER BY section_no, parent_no, child_no) - 1)::INTEGER AS chunk_index FROM child)
SELECT substr(sha1(doc_id || '|' || parent_id || '|' || chunk_index || '|' || left(text, 120)), 1, 20) AS chunk_id, doc_id, 'Paper ' || doc_id AS paper_title, title, chunk_index, 1 AS page_start, 1 AS page_end, text FROM x"""
