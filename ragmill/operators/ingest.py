"""Cleaning, paper metadata, sections and chunks of page text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragmill.functions.text import CJK, contains_any, key_hash, squeeze

#: Line patterns of page numbers, reference entries and figure captions.
PAGE_NUMBER = "^\\s*(?:第\\s*)?\\d{1,4}\\s*(?:页)?\\s*$"
REFERENCE_LINE = "^\\s*(?:\\[\\d+\\]|\\d+\\s*[.．、])\\s*.{8,}$"
CAPTION = "^(?:图|Fig\\.?|Figure)\\s*\\d+(?:[-–.．]\\d+)*\\s*[:：.．、\\s]\\s*\\S.{1,119}$"
#: Headings by name, by chapter and by number.
COMMON_HEADING = "^(摘要|Abstract|ABSTRACT|引言|绪论|结论|总结|Conclusion|Conclusions|CONCLUSION|参考文献|References|REFERENCES|致谢|Acknowledgements?|附录|Appendix)$"
CHAPTER_HEADING = "^第[一二三四五六七八九十百\\d]+[章节篇]\\s*.{0,70}$"
NUMBER_HEADING = f"^(\\d+(?:[.．]\\d+){{0,4}})(?:[.．、])?\\s*([{CJK}A-Za-z][^\\n]{{0,70}})$"
#: Marks of titles that are no titles, and first-page lines that are none.
BAD_TITLES = ("university", "cnki", "cajviewer", "microsoft word", "untitled", "硕士学位论文", "博士学位论文", "电子科技大学", "毕业论文")
TITLE_NOISE = ("摘要", "关键词", "目录", "作者", "导师", "学院", "大学", "硕士", "博士")
SEPARATORS = ("\n\n", "\n", "。", "；", "，", ",", " ")
BODY = "正文"
PAGE = ["doc_id", "page_number"]


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, pos, line): squeezed lines of pages after control characters and long runs of rules are gone."""
    text = F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    text = F.regexp_replace(text, "([=_\\-~*·•])\\1{5,}", "$1$1$1")
    return pages.select(*PAGE, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).withColumn("line", squeeze(F.col("line")))


def boundary_noise(pages: DataFrame, least: int = 3, share: float = 0.45) -> DataFrame:
    """(doc_id, line): headers and footers, lines among a page's first two or last two candidates on enough of its pages.

    Candidates are page numbers and lines of 3 to 80 characters. A short page counts a line in both roles. Enough is ``share`` of
    the pages, ``least`` at least; documents of fewer pages have none.
    """
    c = page_lines(pages).where(((F.length("line") >= 3) & (F.length("line") <= 80)) | F.col("line").rlike(PAGE_NUMBER))
    w = Window.partitionBy(*PAGE)
    c = c.withColumn("a", F.row_number().over(w.orderBy("pos"))).withColumn("z", F.row_number().over(w.orderBy(F.desc("pos"))))
    n = c.groupBy("doc_id", "line").agg(F.sum((F.col("a") <= 2).cast("int") + (F.col("z") <= 2).cast("int")).alias("n"))
    size = pages.groupBy("doc_id").agg(F.count_distinct("page_number").alias("n_pages"))
    enough = F.greatest(F.lit(least), F.floor(F.col("n_pages") * share))
    return n.join(size, "doc_id").where((F.col("n_pages") >= least) & (F.col("n") >= enough)).select("doc_id", "line")


def clean_lines(pages: DataFrame, noise: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_number, pos, line, gap): the lines that stay, and whether a blank line comes before.

    Page numbers, library marks, long reference entries, boundary noise and repeats of the line before go; blank lines between
    do not make a repeat new.
    """
    w = Window.partitionBy(*PAGE).orderBy("pos")
    lines = page_lines(pages).withColumn("blanks", F.sum((F.col("line") == "").cast("int")).over(w)).where("line <> ''")
    lines = lines.where(~F.col("line").rlike(PAGE_NUMBER) & ~F.col("line").contains("中国知网") & ~F.upper("line").contains("CNKI") & ~(F.col("line").rlike(REFERENCE_LINE) & (F.length("line") > 60)))
    if noise is not None:
        lines = lines.join(noise, ["doc_id", "line"], "left_anti")
    lines = lines.withColumn("before", F.lag("line").over(w)).where(F.col("before").isNull() | (F.col("before") != F.col("line")))
    gap = F.col("blanks") > F.lag("blanks").over(w)
    return lines.withColumn("gap", F.coalesce(gap, F.lit(False))).select(*PAGE, "pos", "line", "gap")


def clean_pages(pages: DataFrame, noise: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_number, text): cleaned pages; a page of which nothing stays has an empty text."""
    kept = clean_lines(pages, noise).withColumn("piece", F.concat(F.when(F.col("gap"), "\n\n").otherwise("\n"), F.col("line")))
    text = kept.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("text"))
    return pages.select(*PAGE).distinct().join(text, PAGE, "left").select(*PAGE, F.coalesce(F.regexp_replace("text", "^\n+", ""), F.lit("")).alias("text"))


def captions(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, caption_no, caption)."""
    found = page_lines(pages).where(F.col("line").rlike(CAPTION))
    return found.withColumn("caption_no", F.row_number().over(Window.partitionBy(*PAGE).orderBy("pos"))).select(*PAGE, "caption_no", F.col("line").alias("caption"))


def table_rows(html: F.Column) -> F.Column:
    """Rows of an HTML table as arrays of cell texts; rows without text are left out."""
    rows = F.transform(F.regexp_extract_all(html, F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), lambda r: F.transform(F.regexp_extract_all(r, F.lit("(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: squeeze(F.regexp_replace(c, "<[^>]+>", " "))))
    return F.filter(rows, lambda r: F.exists(r, lambda c: c != ""))


def table_text(rows: F.Column) -> F.Column:
    """Rows as lines of tab-separated cells."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, "\t")), "\n")


def strip_html(html: F.Column) -> F.Column:
    """Text of a page: scripts and styles go, block ends break lines, cell ends are tabs, blanks are collapsed."""
    t = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    t = F.regexp_replace(F.regexp_replace(t, "(?i)</(p|div|li|tr|h[1-6]|article|section|table|ul|ol)>|<br */?>", "\n"), "(?i)</t[dh]>", "\t")
    t = F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), "[ \\x0b\\f\\r]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, " *\n *", "\n"), "\n{3,}", "\n\n"), "^\\s+|\\s+$", "")


def split_people(raw: F.Column) -> F.Column:
    parts = F.split(F.regexp_replace(F.regexp_replace(raw, "(?U)\\s+", ""), "(等|著)$", ""), "[、,，;/；]+")
    return F.filter(parts, lambda p: (F.length(p) > 1) & (F.length(p) <= 12))


def bad_title(title: F.Column) -> F.Column:
    return contains_any(F.lower(title), BAD_TITLES)


def paper_metadata(papers: DataFrame) -> DataFrame:
    """doc_id, paper_title, authors, year, abstract, keywords of papers(doc_id, source_path, raw_title, text).

    Title: the first of file name, first page and raw title that is no placeholder. Authors: the labelled line in the first 80,
    else the file name's. Year: the most frequent in the file name and the first 120 lines, the earliest on a tie. Extra
    columns are ignored.
    """
    stem = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("source_path", "([^/\\\\]*)$", 1), "\\.[^.]*$", ""), "\\s*\\(\\d+\\)$", ""))
    p = papers.select("doc_id", "raw_title", "text", F.split("text", "\n", -1).alias("lines"), stem.alias("stem"))
    split_at = "^(.*)_([^_]*)$"
    file_title = F.trim(F.when(F.col("stem").contains("_"), F.regexp_extract("stem", split_at, 1)).otherwise(F.col("stem")))
    file_authors = F.when(F.col("stem").contains("_"), split_people(F.regexp_extract("stem", split_at, 2))).otherwise(F.array().cast("array<string>"))
    noise = lambda line: F.exists(F.array(*map(F.lit, TITLE_NOISE)), lambda w: (line == w) | line.startswith(F.concat(w, F.lit(":"))) | line.startswith(F.concat(w, F.lit("："))))
    firsts = F.slice(F.filter(F.transform(F.slice("lines", 1, 40), squeeze), lambda x: (F.length(x) >= 6) & (F.length(x) <= 80) & ~noise(x) & ~x.rlike("^(?:19|20)\\d{2}$")), 1, 8)
    longest = F.get(F.transform(F.array_sort(F.transform(firsts, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))), lambda s: s["x"]), F.lit(0))
    raw = squeeze(F.coalesce("raw_title", F.lit("")))
    p = p.select("*", file_title.alias("t0"), F.coalesce(longest, F.lit("")).alias("t1"), F.when(F.lower(raw).isin("untitled", "none"), "").otherwise(raw).alias("t2"), file_authors.alias("a0"))
    good = lambda c: F.when((F.col(c) != "") & ~bad_title(F.col(c)), F.col(c))
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    labelled = split_people(F.regexp_extract(F.array_join(F.slice("lines", 1, 80), "\n"), "(?:作者|研究生|姓名)\\s*[:：]\\s*([^\\n]{2,80})", 1))
    seen = F.regexp_extract_all(F.concat_ws("\n", "stem", F.array_join(F.slice("lines", 1, 120), "\n")), F.lit("(?:19|20)\\d{2}"), F.lit(0))
    count = lambda y: F.size(F.filter("seen", lambda v: v == y))
    year = F.get(F.array_sort(F.transform(F.array_distinct("seen"), lambda y: F.struct((-count(y)).alias("n"), y.cast("int").alias("y")))), F.lit(0))["y"]
    abstract = F.regexp_extract("text", "(?s)(?:^|\\n)\\s*摘\\s*要\\s*[:：]?\\s*(.*?)(?=\\n\\s*(?:关\\s*键\\s*词|关键字|Abstract|目\\s*录|第[一二三四五六七八九十百\\d]+[章节]|1[.．、\\s]|引言|绪论))", 1)
    words = F.split(F.regexp_replace(F.regexp_extract("text", "(?:关\\s*键\\s*词|关键字)\\s*[:：]?\\s*([^\\n]{2,200})", 1), "(?U)\\s+", ""), "[;；,，、]+")
    return p.withColumn("seen", seen).select(
        "doc_id",
        F.coalesce(good("t0"), good("t1"), good("t2"), some("t0"), some("t1"), F.col("t2")).alias("paper_title"),
        F.when(F.size(labelled) > 0, labelled).otherwise(F.col("a0")).alias("authors"),
        year.alias("year"),
        F.substring(squeeze(abstract), 1, 3000).alias("abstract"),
        F.filter(words, lambda w: (F.length(w) > 1) & (F.length(w) <= 40)).alias("keywords"),
    )


def heading_level(line: F.Column, extra: str | None = None) -> F.Column:
    """Level of a heading line, null for others: 1 by name or chapter, dots + 1 (6 at most) by number; ``extra`` marks more of level 1."""
    able = (F.length(line) > 1) & (F.length(line) <= 90) & ~line.rlike("[。；，,;：]\\s*$")
    dots = F.length(F.regexp_replace(F.regexp_extract(line, NUMBER_HEADING, 1), "[^.．]", ""))
    level = F.when(line.rlike(COMMON_HEADING) | line.rlike(CHAPTER_HEADING), 1).when(line.rlike(NUMBER_HEADING), F.least(dots + 1, F.lit(6)))
    level = F.when(able, level)
    return level if extra is None else F.coalesce(level, F.when(line.rlike(extra), 1))


def chunk_type(title: F.Column) -> F.Column:
    low = F.lower(title)
    return F.when(title.contains("摘要") | (low == "abstract"), "abstract").when(title.contains("参考文献") | (low == "references"), "references").when(title.contains("关键词"), "keywords").otherwise("section")


def sections(lines: DataFrame, level: F.Column | None = None) -> DataFrame:
    """(doc_id, section_no, section_id, title, path, level, page_start, page_end, text, chunk_type) of lines(doc_id, page_number, pos, line).

    Each heading begins a section; text before the first is in one called 正文; sections without text are left out. The path
    is folded over the document's headings: level 1 starts anew, deeper ones cut the path above, padded with its last element.
    ``level`` gives the heading level of a row and may come from layout blocks instead of text.
    """
    w = Window.partitionBy("doc_id").orderBy("page_number", "pos")
    marked = lines.withColumn("lev", heading_level(F.col("line")) if level is None else level).withColumn("island", F.sum(F.col("lev").isNotNull().cast("int")).over(w))
    head = F.col("lev").isNotNull()
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~head, F.struct("page_number", "pos", "line")))), lambda x: x["line"]), "\n")
    s = marked.groupBy("doc_id", "island").agg(
        F.coalesce(F.max(F.when(head, F.col("line"))), F.lit(BODY)).alias("title"), F.coalesce(F.max("lev"), F.lit(1)).alias("level"), F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"), F.regexp_replace(body, "^\\s+|\\s+$", "").alias("text")
    )
    heads = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("island", "title", "level"))).alias("heads"))
    start = F.struct(F.array().cast("array<array<string>>").alias("all"), F.array().cast("array<string>").alias("now"))

    def step(acc: F.Column, h: F.Column) -> F.Column:
        above = F.slice(acc["now"], 1, F.greatest(h["level"] - 1, F.lit(0)))
        pad = F.coalesce(F.try_element_at(above, F.lit(-1)), F.lit(BODY))
        path = F.when(h["level"] <= 1, F.array(h["title"])).otherwise(F.array_append(F.concat(above, F.array_repeat(pad, F.greatest(h["level"] - 1 - F.size(above), F.lit(0)))), h["title"]))
        return F.struct(F.array_append(acc["all"], path).alias("all"), path.alias("now"))

    paths = heads.select("doc_id", F.posexplode(F.arrays_zip(F.col("heads.island").alias("island"), F.aggregate("heads", start, step, lambda a: a["all"]).alias("path")))).select("doc_id", "col.island", "col.path")
    out = s.join(paths, ["doc_id", "island"]).where("text <> ''").withColumn("section_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("island")))
    return out.withColumn("section_id", key_hash(F.col("doc_id").cast("string"), F.col("section_no").cast("string"), F.col("title"), size=16)).withColumn("chunk_type", chunk_type(F.col("title"))).drop("island")


def pieces(text: F.Column, size: int, separators: tuple[str, ...] = SEPARATORS) -> F.Column:
    """Pieces of a text, each at most ``size`` long: cut after the coarsest separator that helps, at last anywhere."""
    out = F.array(text)
    long_ = lambda p: F.length(p) > size

    def cut(sep: str):  # a function of one argument: a second one would be taken for the index
        return lambda p: F.when(long_(p), F.filter(F.split(p, f"(?<={sep})", -1), lambda x: x != "")).otherwise(F.array(p))

    for sep in separators:
        out = F.flatten(F.transform(out, cut(sep)))
    hard = lambda p: F.transform(F.sequence(F.lit(1), F.length(p), F.lit(size)), lambda i: F.substring(p, i, F.lit(size)))
    return F.flatten(F.transform(out, lambda p: F.when(long_(p), hard(p)).otherwise(F.array(p))))


def pack(parts: F.Column, size: int) -> F.Column:
    """Neighbouring pieces joined from the left while they fit."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    fits = lambda acc, p: F.length(acc["now"]) + F.length(p) <= size
    close = lambda acc: F.when(acc["now"] != "", F.array_append(acc["done"], acc["now"])).otherwise(acc["done"])
    step = lambda acc, p: F.when(fits(acc, p), F.struct(acc["done"].alias("done"), F.concat(acc["now"], p).alias("now"))).otherwise(F.struct(close(acc).alias("done"), p.alias("now")))
    return F.aggregate(parts, start, step, close)


def _trim(text: F.Column) -> F.Column:
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def recursive_chunks(text: F.Column, size: int) -> F.Column:
    """Chunks without overlap, trimmed, none blank."""
    return F.filter(F.transform(pack(pieces(_trim(F.regexp_replace(text, "\n{3,}", "\n\n")), size), size), _trim), lambda c: c != "")


def with_overlap(base: F.Column, overlap: int) -> F.Column:
    """Each chunk after the first with the end of the one before in front."""
    return F.transform(base, lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.right(F.get(base, i - 1), F.lit(overlap)), c)))


def chunk_sections(secs: DataFrame, parent: int = 1800, size: int = 800, overlap: int = 120) -> DataFrame:
    """Child chunks of sections(doc_id, section_id, text, …): parent_no, parent_id, parent_text, child_no, text.

    Parents are packed to ``parent`` characters; a parent of at most ``size`` is its own child, others are cut to size less
    overlap and overlap by ``overlap``. All other columns stay. Columns are cut in steps, so each fold runs once.
    """
    if not 0 <= overlap < size <= parent:
        raise ValueError("sizes must satisfy 0 <= overlap < size <= parent")
    rest = [c for c in secs.columns if c not in ("text", "parent_no", "parent_text", "child_no", "parent_id")]
    p = secs.select(*rest, F.posexplode(recursive_chunks(F.col("text"), parent)).alias("parent_no", "parent_text"))
    base = F.when(F.length("parent_text") <= size, F.array("parent_text")).otherwise(recursive_chunks(F.col("parent_text"), size - overlap))
    c = p.select("*", F.explode(F.array(base)).alias("base")).select(*rest, "parent_no", "parent_text", F.posexplode(with_overlap(F.col("base"), overlap)).alias("child_no", "text"))
    return c.withColumn("parent_id", key_hash(F.col("section_id").cast("string"), F.col("parent_no").cast("string"), F.substring("parent_text", 1, 120), size=16))


def web_chunks(text: F.Column, size: int = 800, overlap: int = 120, most: int = 3) -> F.Column:
    """First chunks of a web text; a chunk that follows another begins with that one's end, cut to ``size`` from the right."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: F.Column, p: F.Column) -> F.Column:
        done = F.when(acc["now"] != "", F.array_append(acc["done"], _trim(acc["now"]))).otherwise(acc["done"])
        tail = F.coalesce(F.right(F.try_element_at(done, F.lit(-1)), F.lit(overlap)), F.lit("")) if overlap else F.lit("")
        return F.when(F.length(acc["now"]) + F.length(p) <= size, F.struct(acc["done"].alias("done"), F.concat(acc["now"], p).alias("now"))).otherwise(F.struct(done.alias("done"), F.right(F.concat(tail, p), F.lit(size)).alias("now")))

    cut = F.aggregate(pieces(text, size), start, step, lambda a: F.when(_trim(a["now"]) != "", F.array_append(a["done"], _trim(a["now"]))).otherwise(a["done"]))
    return F.slice(F.when(F.length(text) <= size, F.filter(F.array(text), lambda t: t != "")).otherwise(F.filter(cut, lambda c: _trim(c) != "")), 1, most)


def attach_metadata(drafts: DataFrame, papers: DataFrame) -> DataFrame:
    """Chunk drafts with their paper's columns, a running index in the document, and chunk_id."""
    i = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_no", "parent_no", "child_no")) - 1
    out = drafts.withColumn("chunk_index", i).join(papers, "doc_id", "left")
    return out.withColumn("chunk_id", key_hash(F.col("doc_id").cast("string"), F.col("parent_id"), F.col("chunk_index").cast("string"), F.substring("text", 1, 120)))


def auxiliary_chunks(tables: DataFrame, caption_rows: DataFrame) -> DataFrame:
    """Tables(doc_id, page_number, title, rows) and captions as chunks of their own."""
    t = tables.select("doc_id", F.coalesce(F.col("title"), F.concat(F.lit("Table on page "), F.col("page_number").cast("string"))).alias("title"), F.array(F.lit("表格")).alias("path"), table_text(F.col("rows")).alias("text"), F.lit("table").alias("chunk_type"), "page_number")
    c = caption_rows.select("doc_id", F.substring("caption", 1, 80).alias("title"), F.array(F.lit("图注")).alias("path"), F.col("caption").alias("text"), F.lit("figure_caption").alias("chunk_type"), "page_number")
    return t.unionByName(c).where("trim(text) <> ''")


def build_chunks(pages: DataFrame, papers: DataFrame, level: F.Column | None = None, **sizes) -> DataFrame:
    """Pages to chunks: noise and cleaning, sections, parents and children, paper metadata."""
    lines = clean_lines(pages, boundary_noise(pages))
    return attach_metadata(chunk_sections(sections(lines, level), **sizes), papers)
