"""Evidence after reranking: sufficiency, policy, context packing, citations and web evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragmill.functions.text import compress, contains_any, key_hash, tokenize, words_found
from ragmill.operators.ingest import web_chunks
from ragmill.operators.retrieve import ranked, rerank

#: Domain terms and stop words of coverage, keyword lists of the policy.
DOMAIN_TERMS = ("一氧化碳", "烟气控制", "人员疏散", "应急疏散", "风险评估", "火灾", "烟气", "烟雾", "疏散", "逃生", "隧道", "森林", "排烟", "通风", "风险", "预警", "检测", "识别", "蔓延", "温度", "热流", "火焰", "燃烧", "安全", "消防", "应急", "标准", "规范", "法规")
STOP_TERMS = ("的", "了", "和", "与", "及", "或", "在", "中", "对", "是", "有", "请", "问", "什么", "如何", "怎么")
KEYWORDS = {
    "temporal": ("最新", "政策", "标准", "规范", "法规", "事故", "2026", "今年", "最近", "现行", "当前", "近期", "刚发布", "现在"),
    "official": ("标准", "规范", "法规", "政策", "官方", "通报", "统计", "应急管理部", "消防救援局", "GB", "现行版本"),
    "local_scope": ("根据本地知识库", "仅基于知识库", "只看上传文档", "根据这些论文", "这批论文", "根据论文", "仅根据本地"),
    "harmful": ("纵火", "制造火灾", "规避消防", "绕过报警", "破坏灭火", "提高火灾破坏", "如何放火", "怎么纵火"),
    "ambiguous": ("那个", "这个", "这篇", "它", "上述", "前面提到"),
}
PRIORITY_DOMAINS = ("gov.cn", "mem.gov.cn", "119.gov.cn")
DENIALS = ("证据不足", "无法回答", "不能回答")
WEB_TYPES = ("web", "current_web", "official_web")
SCORE, COUNT, COVERAGE = 0.18, 2, 0.30


def query_terms(query: F.Column, domain: tuple[str, ...] = DOMAIN_TERMS) -> F.Column:
    """Domain terms in the query and its ASCII tokens of two or more characters; if none, all longer tokens but stop words."""
    t = tokenize(query)
    stop = F.array(*map(F.lit, STOP_TERMS))
    latin = F.filter(t, lambda x: x.rlike("^[\\x00-\\x7f]{2,}$"))
    first = F.array_distinct(F.concat(words_found(query, domain), latin))
    return F.when(F.size(first) > 0, first).otherwise(F.array_distinct(F.filter(t, lambda x: (F.length(x) > 1) & ~F.array_contains(stop, x))))


def sufficiency_features(queries: DataFrame, candidates: DataFrame, keywords: dict = KEYWORDS, domain: tuple[str, ...] = DOMAIN_TERMS, strict: bool = False) -> DataFrame:
    """One row a query: top score, counts, score gap, matched and missing terms, coverage and keyword hits.

    Terms are matched without regard to case, or with it if ``strict``. Each candidate is held against its query's terms on its
    own and only the terms found are gathered, so no query's evidence is joined into one text.
    """
    q = queries.select("query_id", F.col("text").alias("query"), query_terms(F.col("text"), domain).alias("terms"))
    hay = F.col("text") if strict else F.lower("text")
    needle = (lambda t: t) if strict else F.lower
    c = candidates.select("query_id", "text", "final_score", "doc_id", "source_type").join(q.select("query_id", "terms"), "query_id")
    c = c.withColumn("hit", F.filter("terms", lambda t: F.contains(hay, needle(t))))
    some = lambda name: F.count_distinct(F.when(F.col(name).cast("string") != "", F.col(name)))
    top2 = F.slice(F.sort_array(F.collect_list("final_score"), asc=False), 1, 2)
    g = c.groupBy("query_id").agg(F.max("final_score").alias("top_score"), F.count("*").alias("evidence_count"), some("doc_id").alias("doc_count"), some("source_type").alias("source_type_count"), top2.alias("top2"), F.flatten(F.collect_set("hit")).alias("hits"))
    out = q.join(g, "query_id", "left").withColumns({"top_score": F.coalesce("top_score", F.lit(0.0)), **{n: F.coalesce(n, F.lit(0)) for n in ("evidence_count", "doc_count", "source_type_count")}})
    out = out.withColumn("matched_terms", F.filter("terms", lambda t: F.coalesce(F.array_contains("hits", t), F.lit(False)))).withColumn("missing_terms", F.array_except("terms", "matched_terms"))
    out = out.withColumn("coverage", F.size("matched_terms") / F.greatest(F.size("terms"), F.lit(1)))
    gap = F.when(F.size("top2") > 1, F.get("top2", F.lit(0)) - F.get("top2", F.lit(1))).otherwise(F.coalesce(F.get("top2", F.lit(0)), F.lit(0.0)))
    out = out.withColumn("score_gap", F.round(gap, 4)).drop("top2", "hits")
    return out.withColumns({f"{name}_keywords": words_found(F.col("query"), words) for name, words in keywords.items()})


def has(name: str) -> F.Column:
    return F.size(f"{name}_keywords") > 0


def sufficiency(features: DataFrame, score: float = SCORE, count: int = COUNT, coverage: float = COVERAGE) -> DataFrame:
    """Adds reason, sufficient and needs_web by the first rule that fails: time words, count, top score, coverage."""
    reason = F.when(has("temporal"), "temporal_keyword_detected").when(F.col("evidence_count") < count, "evidence_count_below_threshold").when(F.col("top_score") < score, "top_score_below_threshold")
    reason = reason.when((F.size("terms") > 0) & (F.col("coverage") < coverage), "term_coverage_below_threshold").otherwise("local_evidence_sufficient")
    ok = F.col("reason") == "local_evidence_sufficient"
    return features.withColumn("reason", reason).withColumn("sufficient", ok).withColumn("needs_web", ~ok)


def decide(judged: DataFrame, web: bool = True) -> DataFrame:
    """Adds action, decision_reason, confidence, required_source_type, priority_domains and query_flags by the policy's order of rules."""
    rules = [
        (has("harmful"), "refuse", "harmful_request_detected", 1.0),
        (has("local_scope") & ~F.col("sufficient"), "answer_insufficient", "local_scope_requested_but_evidence_insufficient", 0.95),
        (has("temporal") & F.lit(web), "use_web", "temporal_information_required", 0.9),
        (has("official") & F.lit(web), "use_web", "official_information_required", 0.9),
        (F.col("sufficient"), "answer_local", "local_evidence_sufficient", 0.85),
        (has("ambiguous"), "ask_clarify", "ambiguous_reference_detected", 0.75),
        (F.lit(web), "use_web", "local_evidence_insufficient_and_web_allowed", 0.65),
    ]
    pick = F.lit(None).cast("struct<action:string,reason:string,confidence:double>")
    row = lambda a, r, c: F.struct(F.lit(a).alias("action"), F.lit(r).alias("reason"), F.lit(c).alias("confidence"))
    pick = row("answer_insufficient", "local_evidence_insufficient_and_web_disabled", 0.8)
    for when, action, reason, confidence in reversed(rules):
        pick = F.when(when, row(action, reason, confidence)).otherwise(pick)
    out = judged.withColumn("_d", pick).withColumn("action", F.col("_d.action")).withColumn("decision_reason", F.col("_d.reason")).withColumn("confidence", F.col("_d.confidence")).drop("_d")
    source = F.when(F.col("decision_reason") == "temporal_information_required", "current_web").when(F.col("decision_reason") == "official_information_required", "official_web")
    flags = F.array_compact(F.array(*(F.when(has(n), n) for n in ("temporal", "official", "local_scope", "harmful", "ambiguous"))))
    domains = F.when(source.isNotNull(), F.array(*map(F.lit, PRIORITY_DOMAINS))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("required_source_type", source).withColumn("priority_domains", domains).withColumn("query_flags", flags)


def to_evidence(reranked: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Evidence rows: a chunk's parent text where there is one, else its own."""
    if parents is None:
        return reranked
    joined = reranked.join(parents.select("parent_id", "parent_text"), "parent_id", "left")
    return joined.withColumn("text", F.coalesce(F.when(F.trim("parent_text") != "", F.col("parent_text")), F.col("text"))).drop("parent_text")


def dedupe(evidence: DataFrame, by_text: bool = False) -> DataFrame:
    """One row a chunk of a query, the best; with ``by_text`` also one row a text, white space ignored."""
    out = ranked(evidence, ["query_id", "chunk_id"], [F.desc("final_score")], 1, "_r").drop("_r")
    if by_text:
        out = ranked(out.withColumn("_t", F.sha1(F.regexp_replace("text", "(?U)\\s+", ""))), ["query_id", "_t"], [F.desc("final_score"), "chunk_id"], 1, "_r").drop("_r", "_t")
    return out


def merge_adjacent(evidence: DataFrame, most: int = 1200) -> DataFrame:
    """Chains neighbours of one parent (or section) of a document: next page at most one on, joined length within ``most``.

    Evidence of a query is at most some dozens of rows, so each group is folded in page order. A text that the chain already
    holds adds nothing; scores take the maximum, pages widen, and the ids of merged chunks are kept.
    """
    group = F.coalesce(F.when(F.col("parent_id") != "", F.col("parent_id")), F.col("section_title"), F.lit(""))
    item = F.struct(
        F.coalesce("page_start", F.lit(0)).alias("page_start"), F.coalesce("page_end", F.lit(0)).alias("page_end"), (-F.col("final_score")).alias("neg"), F.col("chunk_id").cast("string").alias("chunk_id"), F.trim("text").alias("text"), F.col("final_score").alias("score"), F.array().cast("array<string>").alias("merged")
    )
    items = evidence.groupBy("query_id", "source_type", "doc_id", group.alias("evidence_group")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = "struct<page_start:int,page_end:int,neg:double,chunk_id:string,text:string,score:double,merged:array<string>>"

    def step(acc: F.Column, x: F.Column) -> F.Column:
        last = F.try_element_at(acc, F.lit(-1))
        end = F.when(last["page_end"] != 0, last["page_end"]).otherwise(last["page_start"])
        start = F.when(x["page_start"] != 0, x["page_start"]).otherwise(x["page_end"])
        fits = last.isNotNull() & (F.length(last["text"]) + F.length(x["text"]) <= most) & (start <= end + 1)
        text = F.when(last["text"] == "", x["text"]).when((x["text"] == "") | F.contains(last["text"], x["text"]), last["text"]).otherwise(F.concat(last["text"], F.lit("\n"), x["text"]))
        low = F.when(x["page_start"] != 0, x["page_start"]).otherwise(last["page_start"])
        both = F.struct(
            F.least(last["page_start"], low).alias("page_start"), F.greatest(last["page_end"], x["page_end"], last["page_start"]).alias("page_end"), last["neg"].alias("neg"), last["chunk_id"].alias("chunk_id"), text.alias("text"), F.greatest(last["score"], x["score"]).alias("score"), F.array_append(last["merged"], x["chunk_id"]).alias("merged")
        )
        return F.when(fits, F.array_append(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), both.cast(kind))).otherwise(F.array_append(acc, x))

    folded = items.select("query_id", "source_type", "doc_id", "evidence_group", F.explode(F.aggregate(F.col("items").cast(f"array<{kind}>"), F.array().cast(f"array<{kind}>"), step)).alias("e"))
    e = lambda n: F.col(f"e.{n}")
    return folded.select("query_id", "source_type", "doc_id", "evidence_group", e("chunk_id").alias("chunk_id"), e("text").alias("text"), e("score").alias("final_score"), e("page_start").alias("page_start"), e("page_end").alias("page_end"), e("merged").alias("merged_chunk_ids"))


def is_web(source_type: F.Column) -> F.Column:
    return F.lower(F.coalesce(source_type, F.lit(""))).contains("web")


def number(evidence: DataFrame) -> DataFrame:
    """Adds evidence_id: L1, L2, … for local and W1, W2, … for web rows, best first."""
    web = is_web(F.col("source_type"))
    n = F.row_number().over(Window.partitionBy("query_id", web).orderBy(F.desc("final_score"), "chunk_id"))
    return evidence.withColumn("evidence_id", F.concat(F.when(web, "W").otherwise("L"), n.cast("string")))


def page_text(start: F.Column, end: F.Column) -> F.Column:
    one = F.concat(F.lit("第"), start.cast("string"), F.lit("页"))
    return F.when(start.isNull() | (start == 0), "页码未知").when(end.isNull() | (end == 0) | (end == start), one).otherwise(F.concat(F.lit("第"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("页")))


def source_label(web: F.Column) -> F.Column:
    """Display name of an evidence row: title and url of web rows; title, authors, year, section and pages of papers."""
    some = lambda c, default: F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c).cast("string")), F.lit(default))
    link = F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit(" ("), F.col("url"), F.lit(")"))).otherwise("")
    names = F.when(F.size("authors") > 0, F.array_join("authors", "、")).otherwise("作者未知")
    paper = F.concat_ws("，", some("paper_title", "题名未知"), names, some("year", "年份未知"), some("section_title", "章节未知"), page_text(F.col("page_start"), F.col("page_end")))
    title = F.coalesce(F.when(F.col("paper_title") != "", F.col("paper_title")), F.when(F.col("url") != "", F.col("url")), F.lit("联网资料"))
    return F.when(web, F.concat(title, link)).otherwise(paper)


def pack_context(evidence: DataFrame, budget: int = 6000, each: int = 1200) -> DataFrame:
    """Numbered blocks of a query in score order up to the budget: the first always, then those before the first that overflows."""
    out = number(evidence).withColumn("text", compress(F.col("text"), each))
    pages = page_text(F.col("page_start"), F.col("page_end"))
    section = F.coalesce(F.when(F.col("section_title") != "", F.col("section_title")), F.lit("未知"))
    block = F.concat(F.lit("["), F.col("evidence_id"), F.lit("]\n来源："), source_label(is_web(F.col("source_type"))), F.lit("\n章节："), section, F.lit("；页码："), pages, F.format_string("；分数：%.4f\n正文：", F.col("final_score")), F.col("text"))
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "chunk_id")
    out = out.withColumn("block", block).withColumn("pos", F.row_number().over(order)).withColumn("used", F.sum(F.length("block")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where((F.col("pos") == 1) | (F.col("used") <= budget))


def context(packed: DataFrame) -> DataFrame:
    """(query_id, context, n_blocks)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"])
    return packed.groupBy("query_id").agg(F.array_join(parts, "\n\n").alias("context"), F.count("*").alias("n_blocks"))


def markers(answer: F.Column) -> F.Column:
    """Citation marks in an answer, distinct, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit("\\[([LW]\\d+)\\]"), F.lit(1)))


def used_citations(answers: DataFrame, citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, marker, use_no, …) of marks with a citation, and (query_id, marker) of those without."""
    m = answers.select("query_id", F.posexplode(markers(F.col("answer"))).alias("use_no", "marker"))
    keys = ["query_id", "marker"]
    return m.join(citations, keys), m.join(citations, keys, "left_anti").select(*keys)


def final_sufficient(raw: F.Column, n_used: F.Column, answer: F.Column) -> F.Column:
    return raw & (n_used > 0) & ~contains_any(answer, DENIALS)


def summary(context_text: F.Column, most: int = 450) -> F.Column:
    """The 正文 lines of a context joined, cut to ``most`` characters."""
    return F.substring(F.array_join(F.regexp_extract_all(context_text, F.lit("正文：([^\\n]*)"), F.lit(1)), "；"), 1, most)


def template_answer(decided: DataFrame) -> DataFrame:
    """A stand-in answer for offline evaluation of rows with action and context."""
    body = F.concat(F.lit("根据检索到的证据："), summary(F.col("context")), F.lit(" "), F.array_join(F.transform(markers(F.col("context")), lambda m: F.concat(F.lit("["), m, F.lit("]"))), ""))
    empty = F.coalesce(F.trim("context"), F.lit("")) == ""
    return decided.withColumn("answer", F.when(F.col("action") == "refuse", "无法回答该请求。").when(F.col("action") == "ask_clarify", "请说明所指的内容。").when(empty, "证据不足，无法回答。").otherwise(body))


def hallucination_flag(intent: F.Column, context_text: F.Column, answer: F.Column) -> F.Column:
    """Whether an answer that needed evidence was given without any and doesn't say so."""
    return ~intent.isin("chat", "reject") & (F.coalesce(F.trim(context_text), F.lit("")) == "") & ~answer.contains("证据不足")


def web_evidence(results: DataFrame, size: int = 800, overlap: int = 120, most: int = 3) -> DataFrame:
    """Chunks of web results(query_id, result_no, url, title, text, score) with ids from url, text and position."""
    c = results.where("trim(text) <> ''").select("*", F.posexplode(web_chunks(F.col("text"), size, overlap, most)).alias("chunk_no", "chunk_text")).drop("text").withColumnRenamed("chunk_text", "text")
    doc = F.coalesce(F.when(F.col("url") != "", F.col("url")), F.concat(F.lit("result-"), F.col("result_no").cast("string")))
    return c.withColumn("doc_id", key_hash(doc, size=16)).withColumn("chunk_id", key_hash(F.coalesce("url", F.lit("")), F.col("text"), F.col("chunk_no").cast("string")))


def web_candidates(chunks: DataFrame) -> DataFrame:
    """Web chunks with fusion_score max(score, 0) / (100 + rank)."""
    out = ranked(chunks, ["query_id"], [F.desc("score"), "chunk_id"], None)
    return out.withColumn("fusion_score", F.greatest("score", F.lit(0.0)) / (100 + F.col("rank"))).drop("rank")


def combine_and_rerank(local: DataFrame, web: DataFrame, k: int = 10) -> DataFrame:
    """Local and web candidates of a query as one lexically reranked list, one row a chunk."""
    both = local.unionByName(web, allowMissingColumns=True)
    best = ranked(both, ["query_id", "chunk_id"], [F.desc("fusion_score")], 1, "_r").drop("_r")
    return rerank(best, k=k)


def web_trigger(judged: DataFrame, count: int = COUNT, score: float = SCORE) -> F.Column:
    """Whether to look on the web: needed, timely, or too little or too weak evidence."""
    return F.col("needs_web") | has("temporal") | (F.col("evidence_count") < count) | (F.col("top_score") < score)
