"""Catalogue of papers and analytics of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragmill.functions.text import CJK
from ragmill.operators.evaluate import describe
from ragmill.operators.index import not_deleted
from ragmill.operators.retrieve import ranked

#: Half-open length bins.
BINS = ((0, 50), (50, 100), (100, 200), (200, 300), (300, 500), (500, 800), (800, 1000), (1000, 1500), (1500, 2000), (2000, None))


def papers(chunks: DataFrame, order: str = "chunk_index") -> DataFrame:
    """One row a document over active chunks: the first chunk's title, authors and year, first non-empty abstract and keywords, count."""
    first = lambda c: F.min_by(c, order).alias(c)
    some = lambda c, full: F.min_by(c, F.when(full, F.col(order))).alias(c)
    return chunks.where(not_deleted()).groupBy("doc_id").agg(first("paper_title"), first("authors"), first("year"), some("abstract", F.col("abstract") != ""), some("keywords", F.size("keywords") > 0), F.count("*").alias("chunk_count"))


def search_papers(catalog: DataFrame, keyword: str | None = None, year: int | None = None, sort: str = "title", page: int = 1, size: int = 20) -> DataFrame:
    """A page of matching papers with the total; the word is looked for in title, authors, keywords and abstract, case aside."""
    hit = catalog
    if keyword:
        k = keyword.lower()
        any_ = lambda c: F.coalesce(F.exists(c, lambda x: F.lower(x).contains(k)), F.lit(False))
        hit = hit.where(F.lower(F.coalesce("paper_title", F.lit(""))).contains(k) | any_("authors") | any_("keywords") | F.lower(F.coalesce("abstract", F.lit(""))).contains(k))
    if year is not None:
        hit = hit.where(F.col("year") == year)
    order = {"title": [F.asc("paper_title")], "year_desc": [F.desc_nulls_last("year")], "chunks": [F.desc("chunk_count")]}[sort]
    total = hit.agg(F.count("*").alias("total"))
    return hit.orderBy(*order, "doc_id").offset((page - 1) * size).limit(size).crossJoin(total)


def year_counts(catalog: DataFrame) -> DataFrame:
    return catalog.where("year is not null").groupBy("year").agg(F.count("*").alias("n_papers"), F.sum("chunk_count").alias("n_chunks"))


def top_keywords(catalog: DataFrame, most: int = 30, least: int = 1) -> DataFrame:
    k = catalog.select(F.explode("keywords").alias("keyword")).where(F.length("keyword") >= least).groupBy("keyword").agg(F.count("*").alias("n"))
    return k.orderBy(F.desc("n"), "keyword").limit(most)


def title_words(catalog: DataFrame, stop: DataFrame, most: int = 25) -> DataFrame:
    """CJK runs of 2 to 6 characters in titles, without stop words(word), most frequent first."""
    w = catalog.select(F.explode(F.regexp_extract_all("paper_title", F.lit(f"[{CJK}]{{2,6}}"), F.lit(0))).alias("word")).join(stop, "word", "left_anti")
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most)


def paper_detail(chunks: DataFrame, doc_ids: DataFrame, head: int = 500) -> DataFrame:
    """(doc_id, chunk_count, chunks): the chunks of given documents in order, with the head of their text. For a few documents at a time."""
    c = chunks.where(not_deleted()).join(doc_ids, "doc_id", "left_semi")
    return c.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", F.substring("text", 1, head).alias("head")))).alias("chunks"))


def length_stats(chunks: DataFrame) -> DataFrame:
    """Count, mean, median, extremes, sample deviation and percentiles at index n div 10, 4, … of text lengths."""
    c = chunks.select(F.length("text").alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    w = Window.partitionBy()
    c = c.withColumn("upto", F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))
    at = lambda num, den: F.min(F.when(F.col("upto") > F.floor(F.col("total") * num / den), F.col("v")))
    half = (F.min(F.when(F.col("upto") * 2 >= F.col("total"), F.col("v"))) + F.min(F.when(F.col("upto") * 2 > F.col("total"), F.col("v")))) / 2
    n, s, q = F.sum("n"), F.sum(F.col("v") * F.col("n")), F.sum(F.col("v").cast("double") * F.col("v") * F.col("n"))
    dev = F.sqrt((q - s.cast("double") * s / n) / (n - 1))
    return c.agg(n.alias("n"), F.round(s / n, 4).alias("mean"), half.alias("median"), F.min("v").alias("least"), F.max("v").alias("most"), F.round(dev, 4).alias("stdev"), at(1, 10).alias("p10"), at(1, 4).alias("p25"), at(3, 4).alias("p75"), at(9, 10).alias("p90"))


def length_histogram(chunks: DataFrame, bins: tuple = BINS) -> DataFrame:
    """(bin_no, low, high, n, pct) for all bins; lengths are counted first, so the range join sees distinct lengths only."""
    spark = chunks.sparkSession
    b = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(bins)], "bin_no int, low int, high int")
    c = chunks.groupBy(F.length("text").alias("v")).agg(F.count("*").alias("c"))
    j = b.join(c, (F.col("v") >= F.col("low")) & (F.col("high").isNull() | (F.col("v") < F.col("high"))), "left").groupBy("bin_no", "low", "high").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    return j.withColumn("pct", F.round(F.col("n") * 100 / F.greatest(F.sum("n").over(Window.partitionBy()), F.lit(1)), 2))


def chunks_per_document(chunks: DataFrame) -> DataFrame:
    d = chunks.groupBy("doc_id").agg(F.count("*").alias("c"))
    return d.agg(F.count("*").alias("n_docs"), F.round(F.avg("c"), 4).alias("mean"), F.median("c").alias("median"), F.min("c").alias("least"), F.max("c").alias("most"))


def by_type(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_type").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 4).alias("mean_length"))


def section_totals(chunks: DataFrame, most: int = 15) -> DataFrame:
    s = chunks.groupBy("section").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))
    return s.orderBy(F.desc("n_chars"), "section").limit(most)


def suspicious_heading(title: F.Column) -> F.Column:
    """Headings of private-use or replacement characters, or mostly of signs or of digits and signs."""
    n = F.length(title)
    word = F.length(F.regexp_replace(title, f"[^A-Za-z0-9{CJK}]", ""))
    letters = F.length(F.regexp_replace(title, f"[^A-Za-z{CJK}]", ""))
    return title.rlike("[\\x{E000}-\\x{F8FF}\\x{FFFD}]") | ((n >= 6) & ((n - word) / n >= 0.45)) | ((n >= 8) & ((n - letters) / n >= 0.65))


def audit_sections(children: DataFrame, short: int = 50, long: int = 800) -> DataFrame:
    """Rollup by document (null for all) of child chunks(doc_id, section_id, parent_id, parent_text, text, title).

    Counts of sections, parents and children, mean lengths and fan-outs, the share of a parent that a child holds, short and long
    children and suspicious headings.
    """
    n = F.length("text")
    c = children.select("doc_id", "section_id", "parent_id", n.alias("n"), F.length("parent_text").alias("p"), suspicious_heading(F.col("title")).alias("odd"))
    r = c.rollup("doc_id").agg(
        F.count_distinct("section_id").alias("n_sections"), F.count_distinct("parent_id").alias("n_parents"), F.count("*").alias("n_children"), F.round(F.avg("n"), 4).alias("mean_child"), F.round(F.avg(F.col("n") / F.col("p")), 4).alias("mean_ratio"),
        F.count_if(F.col("n") < short).alias("n_short"), F.count_if(F.col("n") > long).alias("n_long"), F.count_distinct(F.when(F.col("odd"), F.col("section_id"))).alias("n_suspicious"),
    )
    return r.withColumn("children_per_parent", F.round(F.col("n_children") / F.col("n_parents"), 4))


def audit_distributions(children: DataFrame) -> DataFrame:
    """The distribution of child lengths by document."""
    return describe(children.select("doc_id", F.length("text").alias("n_chars")), "n_chars", ["doc_id"])


def audit_lengths(secs: DataFrame, children: DataFrame) -> DataFrame:
    """Distributions by document and ``what``: lengths of sections(doc_id, section_id, text), parents and children, and both fan-outs.

    ``children`` are those of ``chunk_sections``: doc_id, section_id, parent_id, parent_text, text.
    """
    parents = children.groupBy("doc_id", "section_id", "parent_id").agg(F.max(F.length("parent_text")).alias("p"), F.count("*").alias("c"))
    value = lambda df, what, v: df.select("doc_id", F.lit(what).alias("what"), v.cast("long").alias("value"))
    per_section = parents.groupBy("doc_id", "section_id").agg(F.count("*").alias("n"))
    every = value(secs, "section", F.length("text")).unionByName(value(parents, "parent", F.col("p"))).unionByName(value(children, "child", F.length("text")))
    every = every.unionByName(value(parents, "children_per_parent", F.col("c"))).unionByName(value(per_section, "parents_per_section", F.col("n")))
    return describe(every, "value", ["doc_id", "what"])


def audit_samples(children: DataFrame, most: int = 30, short: int = 50) -> DataFrame:
    """Up to ``most`` of the shortest children below ``short`` characters, by document."""
    return ranked(children.withColumn("n", F.length("text")).where(F.col("n") < short), ["doc_id"], ["n", "section_id", "parent_no", "child_no"], most)


def audit_auxiliary(auxiliary: DataFrame) -> DataFrame:
    """Counts and mean lengths of table and caption chunks by document and over all (doc_id null)."""
    return auxiliary.rollup("doc_id").agg(F.count_if(F.col("chunk_type") == "table").alias("n_tables"), F.count_if(F.col("chunk_type") == "figure_caption").alias("n_captions"), F.round(F.avg(F.length("text")), 4).alias("mean_length"))


def audit_lines(audit: DataFrame) -> F.Column:
    """A row of the audit as a line of a Markdown table."""
    return F.concat(F.lit("| "), F.array_join(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in audit.columns)), " | "), F.lit(" |"))


def write_audit(audit: DataFrame, path: str) -> None:
    """The audit as CSV, as JSON lines and as a Markdown table, in folders of ``path``."""
    audit.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    audit.write.mode("overwrite").json(f"{path}/json")
    head = audit.sparkSession.createDataFrame([(0, f"| {' | '.join(audit.columns)} |"), (1, f"|{'---|' * len(audit.columns)}")], "n long, line string")
    body = audit.select(F.lit(2).cast("long").alias("n"), audit_lines(audit).alias("line"))
    head.unionByName(body).repartitionByRange(1, "n").sortWithinPartitions("n", "line").select("line").write.mode("overwrite").text(f"{path}/markdown")
