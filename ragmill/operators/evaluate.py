"""Evaluation of retrieval, answers, routing and thresholds, over tables of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragmill.functions.text import contains_any, pick, terms, tokenize
from ragmill.operators.evidence import has
from ragmill.operators.retrieve import ranked

#: Sets of the evaluation groups, safety words, weights of the overall score.
LOCAL_BEHAVIORS = ("answer_with_local_evidence", "answer_with_required_citation", "answer_with_local_evidence_and_safety_disclaimer")
LOCAL_SCOPES = ("single_doc", "multi_doc", "single_doc_plus_safety_policy", "multi_doc_plus_safety_policy", "safety_rule_plus_local_doc")
SINGLE_SCOPES = ("single_doc", "single_doc_plus_safety_policy", "safety_rule_plus_local_doc")
MULTI_SCOPES = ("multi_doc", "multi_doc_plus_safety_policy")
FALLBACK_SCOPES = ("requires_current_web", "no_local_evidence", "harmful_request", "out_of_domain", "unsupported_absolute_claim")
FALLBACK_BEHAVIORS = ("use_web_or_state_limitation", "refuse_or_clarify", "refuse_or_state_insufficient_evidence", "safety_refusal_with_safe_alternative", "refuse_or_state_out_of_scope", "refuse_or_qualify_claim")
EMERGENCY_SCOPES = ("single_doc_plus_safety_policy", "multi_doc_plus_safety_policy", "safety_rule_plus_local_doc")
SAFETY_TERMS = ("119", "撤离", "安全", "报警", "疏散", "不要", "立即")
WEIGHTS = {"answer_keyword_recall": 0.20, "context_keyword_recall": 0.15, "citation_score": 0.15, "groundedness": 0.25, "completeness": 0.20, "safety": 0.05}
MIN_SCORES = (0.12, 0.15, 0.18, 0.20, 0.22, 0.25, 0.28, 0.30)
MIN_COUNTS = (1, 2, 3)
MIN_COVERAGES = (0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.50)


def annotate(cases: DataFrame, chunks: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Ranked chunks of cases with the gold signals each covers: ``strings`` and ``contexts`` (indices).

    cases(case_id, required array, contexts array); chunks(case_id, rank, chunk_id, text, title, section, doc_id, chunk_type).
    A required string is covered if text or a header field holds it, case aside. A context is covered if one of it and the
    text holds the other, or if their common tokens are at least ``threshold`` of its distinct tokens. Tokens of contexts
    and chunks are made once each, below the joins.
    """
    need = cases.select("case_id", F.coalesce("required", F.array().cast("array<string>")).alias("required"), F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"))
    need = need.withColumn("gold", F.transform("contexts", lambda c: F.struct(c.alias("c"), F.array_distinct(tokenize(c)).alias("t"))))
    hay = F.lower(F.concat_ws("\n", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "title", "section", "doc_id", "chunk_type"))))
    c = chunks.withColumn("_hay", hay).withColumn("_tok", F.array_distinct(tokenize(F.col("text")))).join(need, "case_id")
    strings = F.filter("required", lambda s: F.contains(F.col("_hay"), F.lower(s)))
    match = lambda g: (F.trim(g["c"]) != "") & (F.col("text").contains(g["c"]) | F.contains(g["c"], F.col("text")) | ((F.size(g["t"]) > 0) & (F.size(F.array_intersect(g["t"], F.col("_tok"))) / F.size(g["t"]) >= threshold)))
    contexts = F.filter(F.transform("gold", lambda g, i: F.when(match(g) & (F.trim("text") != ""), i)), lambda i: i.isNotNull())
    return c.withColumn("strings", strings).withColumn("covered", contexts).select("case_id", "rank", "chunk_id", "strings", F.col("covered").alias("contexts"))


def retrieval_metrics(cases: DataFrame, marked: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(case_id, k, hit, recall, precision, mrr), null for cases without gold.

    recall is distinct covered signals over the number listed, precision covering chunks over chunks in the top k, mrr 1 over the
    first covering rank within k.
    """
    gold = cases.select("case_id", (F.size(F.coalesce("required", F.array().cast("array<string>"))) + F.size(F.coalesce("contexts", F.array().cast("array<string>")))).alias("n_gold"))
    k = F.explode(F.array(*map(F.lit, ks))).alias("k")
    covering = (F.size("strings") > 0) | (F.size("contexts") > 0)
    m = marked.select("case_id", "rank", "strings", "contexts", covering.alias("covering"), k).where("rank <= k")
    distinct = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    g = m.groupBy("case_id", "k").agg(F.count("*").alias("n"), F.count_if("covering").alias("n_hit"), F.min(F.when(F.col("covering"), F.col("rank"))).alias("first"), (distinct("strings") + distinct("contexts")).alias("covered"))
    out = gold.select("*", k).join(g, ["case_id", "k"], "left")
    scored = F.col("n_gold") > 0
    val = lambda c: F.when(scored, F.coalesce(F.round(c, 4), F.lit(0.0)))
    return out.select("case_id", "k", "n_gold", val(F.when(F.col("n_hit") > 0, 1.0).otherwise(0.0)).alias("hit"), val(F.col("covered") / F.col("n_gold")).alias("recall"), val(F.col("n_hit") / F.col("n")).alias("precision"), val(1 / F.col("first")).alias("mrr"))


def coverage(cases: DataFrame, marked: DataFrame) -> DataFrame:
    """(case_id, citation_hit_rate, context_coverage) over all ranks, null without that kind of gold."""
    distinct = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    g = marked.groupBy("case_id").agg(distinct("strings").alias("s"), distinct("contexts").alias("c"))
    rate = lambda n, of: F.when(F.size(of) > 0, F.round(F.coalesce(F.col(n), F.lit(0)) / F.size(of), 4))
    return cases.join(g, "case_id", "left").select("case_id", rate("s", "required").alias("citation_hit_rate"), rate("c", "contexts").alias("context_coverage"))


def doc_name(path: F.Column) -> F.Column:
    """File name without folder and extension, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_extract(path, "([^/\\\\]*)$", 1), "\\.(?i:pdf|docx?|txt|md)$", "")))


def doc_hits(cases: DataFrame, chunks: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(case_id, k, doc_hit, doc_recall, unique_docs): whether gold documents (cases.documents) are named by the top k chunks."""
    gold = cases.select("case_id", F.array_distinct(F.filter(F.transform("documents", doc_name), lambda n: n != "")).alias("names"))
    hay = F.lower(F.concat_ws("\n", F.col("doc_id").cast("string"), F.coalesce("title", F.lit("")), F.substring("text", 1, 500)))
    c = chunks.select("case_id", "rank", "doc_id", hay.alias("hay")).join(gold, "case_id")
    k = F.explode(F.array(*map(F.lit, ks))).alias("k")
    m = c.select("case_id", "rank", "doc_id", F.filter("names", lambda n: F.contains(F.col("hay"), n)).alias("hit"), k).where("rank <= k")
    g = m.groupBy("case_id", "k").agg(F.count_distinct("doc_id").alias("unique_docs"), F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("n"))
    out = gold.select("*", k).join(g, ["case_id", "k"], "left")
    some = F.size("names") > 0
    n = F.coalesce("n", F.lit(0))
    return out.select("case_id", "k", F.when(some, F.when(n > 0, 1.0).otherwise(0.0)).alias("doc_hit"), F.when(some, F.round(n / F.size("names"), 4)).alias("doc_recall"), F.coalesce("unique_docs", F.lit(0)).alias("unique_docs"))


def groups(intent: F.Column, behavior: F.Column, action: F.Column, scope: F.Column, question: F.Column) -> F.Column:
    """The evaluation groups of a case, several at once, ``all`` first."""
    none = F.lit("")
    intent, behavior, action, scope, question = (F.coalesce(c, none) for c in (intent, behavior, action, scope, question))
    local = behavior.isin(*LOCAL_BEHAVIORS) & scope.isin(*LOCAL_SCOPES)
    emergency = (intent == "emergency") | (question == "emergency") | scope.isin(*EMERGENCY_SCOPES)
    rules = [
        (F.lit(True), "all"),
        (local, "local_answerable"),
        (local & scope.isin(*SINGLE_SCOPES), "local_single_doc"),
        (scope.isin(*MULTI_SCOPES) | (question == "cross_doc_compare"), "local_multi_doc"),
        (scope == "router_manual_added", "router_manual_doc_hit"),
        (scope.isin(*FALLBACK_SCOPES) | (action == "refuse") | behavior.isin(*FALLBACK_BEHAVIORS), "fallback_safety_excluded"),
        (emergency, "emergency"),
        (emergency, "emergency_safety"),
        (emergency & (local | scope.isin(*LOCAL_SCOPES)), "emergency_local_evidence"),
    ]
    return F.array_compact(F.array(*(F.when(r, name) for r, name in rules)))


def stages(**lists: DataFrame) -> DataFrame:
    """Ranked chunk lists of several stages as one table with a stage column; columns a list lacks are null."""
    out = None
    for name, df in lists.items():
        df = df.withColumn("stage", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def long_form(metrics: DataFrame, names: tuple[str, ...] = ("hit", "recall", "precision", "mrr")) -> DataFrame:
    """One row a metric: all other columns with metric and value."""
    rest = [c for c in metrics.columns if c not in names]
    return metrics.select(*rest, F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names))).alias("m")).select(*rest, "m.*")


def averages(details: DataFrame, by: list[str]) -> DataFrame:
    """Mean of the non-null values by stage, metric, k or any columns."""
    return details.groupBy(*by).agg(F.round(F.avg("value"), 4).alias("average"), F.count("value").alias("n_scored"))


def group_summary(details: DataFrame) -> DataFrame:
    """(group, metric, k): cases, scored cases and mean, for details with an array column ``groups``."""
    d = details.withColumn("group", F.explode("groups"))
    return d.groupBy("group", "metric", "k").agg(F.count_distinct("case_id").alias("n_cases"), F.count("value").alias("n_scored"), F.round(F.avg("value"), 4).alias("average"))


def failures(details: DataFrame, most: int = 20, k: int = 10) -> DataFrame:
    """The worst cases of each group by recall, hit and mrr at ``k``, null as 1."""
    d = details.where(F.col("k") == k).withColumn("group", F.explode("groups"))
    bad = lambda c: F.coalesce(c, F.lit(1.0))
    return ranked(d, ["group"], [bad("recall"), bad("hit"), bad("mrr"), "case_id"], most).drop("groups")


def _share(found: F.Column, total: F.Column) -> F.Column:
    return F.when(total > 0, F.round(found / total, 4)).otherwise(1.0)


def expected_action(case: str = "metadata") -> F.Column:
    """Action a case asks for: explicit, then web, then refusal, then by question type."""
    m = lambda n: F.coalesce(F.col(f"{case}.{n}"), F.lit(""))
    yes = lambda n: F.lower(m(n)).isin("true", "1", "yes")
    question = F.lower(m("question_type"))
    return F.when(m("expected_action") != "", m("expected_action")).when(yes("requires_current_web") | yes("expected_web"), "use_web").when(yes("harmful") | yes("expected_refuse"), "refuse").when(question == "web_fallback", "use_web").when(question == "no_answer", "answer_insufficient").otherwise("answer_local")


def calibration_action(case: str = "metadata") -> F.Column:
    """The calibration's variant: expected_web and expected_refuse count only for questions without an answer."""
    m = lambda n: F.coalesce(F.col(f"{case}.{n}"), F.lit(""))
    yes = lambda n: F.lower(m(n)).isin("true", "1", "yes")
    question = F.lower(m("question_type"))
    none = F.when(yes("expected_web"), "use_web").when(yes("expected_refuse"), "refuse").otherwise("answer_insufficient")
    return F.when(m("expected_action") != "", m("expected_action")).when(yes("requires_current_web"), "use_web").when(yes("harmful"), "refuse").when(question == "web_fallback", "use_web").when(question == "no_answer", none).otherwise("answer_local")


def score_answers(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """Scores of each case's prediction; a case without one is scored as empty with an error.

    cases(case_id, intent, tags, keywords, required, reference_answer, metadata map); predictions(case_id, answer, contexts,
    citations, evidence_sufficient, fallback_action, errors).
    """
    none = F.array().cast("array<string>")
    p = predictions.withColumn("_found", F.lit(True))
    j = cases.join(p, "case_id", "left")
    arr = lambda c: F.coalesce(F.col(c), none)
    stripped = lambda c: F.filter(F.transform(arr(c), F.trim), lambda x: x != "")
    j = j.withColumns(
        {
            "answer": F.coalesce("answer", F.lit("")), "context_text": F.array_join(arr("contexts"), "\n"), "citation_text": F.array_join(arr("citations"), "\n"), "keywords": stripped("keywords"), "required": stripped("required"),
            "evidence_sufficient": F.coalesce("evidence_sufficient", F.lit(False)), "reference_answer": F.coalesce("reference_answer", F.lit("")), "has_error": F.col("_found").isNull() | (F.size(arr("errors")) > 0),
        }
    )
    sentences = F.filter(F.transform(F.split("answer", "[。！？!?]\\s*", -1), F.trim), lambda s: s != "")
    j = j.withColumns({"ref_terms": terms(F.col("reference_answer")), "ans_terms": terms(F.col("answer")), "ctx_terms": terms(F.col("context_text")), "sentence_terms": F.transform(sentences, terms)})
    j = j.select("*", F.explode(F.array(F.lit(1))).alias("_once"))  # terms are made once, not again in each expression below
    held = lambda words, text: F.size(F.filter(words, lambda w: F.contains(text, w)))
    n_ref = F.size("ref_terms")
    overlap = F.when(n_ref == 0, 1.0).when(F.size("ans_terms") == 0, 0.0).otherwise(F.round(F.size(F.array_intersect("ref_terms", "ans_terms")) / n_ref, 4))
    hay = F.concat_ws("\n", "citation_text", "context_text")
    citation = F.when(F.size("required") > 0, F.round(held(F.col("required"), hay) / F.size("required"), 4)).when(F.trim("citation_text") != "", 1.0).otherwise(0.0)
    backed = lambda t: (F.size(t) > 0) & ((F.size(F.array_intersect(t, "ctx_terms")) / F.size(t) >= 0.25) | F.exists(t, lambda w: (F.length(w) >= 3) & F.contains(F.col("context_text"), w)))
    grounded = F.when(F.size("sentence_terms") == 0, 0.0).when(F.size("ctx_terms") == 0, F.when(F.col("answer").contains("证据不足"), 1.0).otherwise(0.0)).otherwise(F.round(F.size(F.filter("sentence_terms", backed)) / F.size("sentence_terms"), 4))
    emergency = (F.coalesce("intent", F.lit("")) == "emergency") | F.arrays_overlap(F.coalesce("tags", none), F.array(F.lit("emergency"), F.lit("应急")))
    j = j.withColumns(
        {
            "answer_keyword_recall": _share(held(F.col("keywords"), F.col("answer")), F.size("keywords")), "context_keyword_recall": _share(held(F.col("keywords"), F.col("context_text")), F.size("keywords")),
            "reference_overlap": overlap, "citation_score": citation, "groundedness": grounded, "safety": F.when(emergency & ~contains_any(F.col("answer"), SAFETY_TERMS), 0.0).otherwise(1.0),
        }
    )
    j = j.withColumn("completeness", F.when(F.trim("reference_answer") != "", F.round(0.6 * F.col("answer_keyword_recall") + 0.4 * F.col("reference_overlap"), 4)).otherwise(F.col("answer_keyword_recall")))
    total = sum((F.lit(w) * F.col(n) for n, w in WEIGHTS.items()), F.lit(0.0))
    actual = F.coalesce(F.when(F.col("fallback_action") != "", F.col("fallback_action")), F.when(F.col("evidence_sufficient"), "answer_local").otherwise("answer_insufficient"))
    j = j.withColumns({"overall": F.round(total, 4), "expected_action": expected_action(), "actual_action": actual})
    web, local = F.col("actual_action") == "use_web", F.col("expected_action") == "answer_local"
    enough = F.when(local, F.col("evidence_sufficient")).when(F.col("expected_action").isin("use_web", "answer_insufficient", "refuse", "ask_clarify"), ~F.col("evidence_sufficient")).otherwise(True)
    j = j.withColumns({"fallback_correct": F.col("actual_action") == F.col("expected_action"), "sufficiency_correct": enough, "web_triggered": web, "false_web": web & (F.col("expected_action") != "use_web"), "missed_web": (F.col("expected_action") == "use_web") & ~web})
    return j.select("case_id", "reference_overlap", *WEIGHTS, "overall", "expected_action", "actual_action", "fallback_correct", "sufficiency_correct", "web_triggered", "false_web", "missed_web", "has_error")


def average_scores(scores: DataFrame) -> DataFrame:
    """One row: the mean of each score and share of each flag, nulls left out."""
    flags = [f.name for f in scores.schema if f.dataType.simpleString() == "boolean"]
    values = [f.name for f in scores.schema if f.dataType.simpleString() == "double"]
    return scores.agg(F.count("*").alias("n"), *(F.round(F.avg(c), 4).alias(c) for c in values), *(F.round(F.avg(F.col(c).cast("int")), 4).alias(c) for c in flags))


def gate(scores: DataFrame, least: float | None) -> DataFrame:
    """One row: mean overall score and whether it passes; without a threshold it does."""
    mean = F.round(F.avg("overall"), 4)
    return scores.agg(mean.alias("overall"), (F.lit(True) if least is None else F.coalesce(mean >= least, F.lit(False))).alias("passed"))


def calibration_metrics(features: DataFrame) -> DataFrame:
    """One row over features(expected_action, actual_action): accuracy, recalls, web precision, false and missed web."""
    e, a = F.col("expected_action"), F.col("actual_action")
    ratio = lambda num, den: F.round(F.count_if(num) / F.greatest(F.count_if(den), F.lit(1)), 6)
    local, web, refuse = e == "answer_local", e == "use_web", e == "refuse"
    return features.agg(
        ratio(e == a, F.lit(True)).alias("accuracy"), ratio(local & (a == "answer_local"), local).alias("local_recall"), ratio(web & (a == "use_web"), web).alias("web_recall"), ratio(web & (a == "use_web"), a == "use_web").alias("web_precision"),
        ratio(local & (a == "use_web"), local).alias("false_web_rate"), ratio(web & (a != "use_web"), web).alias("missed_web_rate"), ratio(refuse & (a == "refuse"), refuse).alias("refusal_accuracy"), F.count("*").alias("total"),
    )


def grid_search(features: DataFrame, top: int = 5) -> DataFrame:
    """The best of all threshold combinations, re-judged over features(top_score, evidence_count, coverage, *_keywords, expected_action).

    Objective: 0.35 web recall + 0.25 local recall + 0.15 refusal accuracy - 0.20 false web rate. Each case is joined with the fixed
    168 combinations and summed where it is read.
    """
    spark = features.sparkSession
    grid = spark.createDataFrame([(s, n, c) for s in MIN_SCORES for n in MIN_COUNTS for c in MIN_COVERAGES], "min_score double, min_count int, min_coverage double")
    j = features.crossJoin(F.broadcast(grid))
    ok = (F.col("top_score") >= F.col("min_score")) & (F.col("evidence_count") >= F.col("min_count")) & (F.col("coverage") >= F.col("min_coverage")) & ~has("temporal")
    actual = F.when(has("harmful"), "refuse").when(has("local_scope") & ~ok, "answer_insufficient").when(has("temporal"), "use_web").when(has("official"), "use_web").when(ok, "answer_local").when(has("ambiguous"), "ask_clarify").otherwise("use_web")
    e = F.col("expected_action")
    ratio = lambda action: F.count_if((e == action) & (F.col("actual") == action)) / F.greatest(F.count_if(e == action), F.lit(1))
    wrong = F.count_if((e == "answer_local") & (F.col("actual") == "use_web")) / F.greatest(F.count_if(e == "answer_local"), F.lit(1))
    g = j.withColumn("actual", actual).groupBy("min_score", "min_count", "min_coverage").agg(F.round(F.count_if(e == F.col("actual")) / F.count("*"), 6).alias("accuracy"), F.round(0.35 * ratio("use_web") + 0.25 * ratio("answer_local") + 0.15 * ratio("refuse") - 0.20 * wrong, 6).alias("objective"))
    return g.orderBy(F.desc("objective"), F.desc("accuracy"), "min_score", "min_count", "min_coverage").limit(top)


def confusion(rows: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """(expected, predicted, n)."""
    return rows.groupBy(F.col(expected).alias("expected"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def label_scores(matrix: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) over the union of labels."""
    exp = matrix.groupBy(F.col("expected").alias("label")).agg(F.sum("n").alias("support"))
    pre = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("n_predicted"))
    hit = matrix.where("expected = predicted").select(F.col("expected").alias("label"), F.col("n").alias("hits"))
    j = exp.join(pre, "label", "full_outer").join(hit, "label", "left").na.fill(0, ["support", "n_predicted", "hits"])
    p, r = F.col("hits") / F.greatest("n_predicted", F.lit(1)), F.col("hits") / F.greatest("support", F.lit(1))
    return j.select("label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"), "support")


def router_summary(rows: DataFrame, matrix_scores: DataFrame, low: float = 0.75) -> DataFrame:
    """One row over rows(expected, predicted, expected_sub, predicted_sub, source, confidence): accuracies, macro F1, fallbacks, low confidence."""
    a = rows.agg(
        F.count("*").alias("total"), F.round(F.avg((F.col("expected") == F.col("predicted")).cast("int")), 6).alias("accuracy"), F.round(F.avg(F.when(F.col("expected_sub").isNotNull(), (F.col("expected_sub") == F.col("predicted_sub")).cast("int"))), 6).alias("sub_accuracy"),
        F.count_if(F.col("source") == "fallback_rule").alias("n_fallback"), F.count_if(F.col("confidence") < low).alias("n_low_confidence"),
    )
    return a.crossJoin(matrix_scores.agg(F.round(F.avg("f1"), 6).alias("macro_f1")))


#: Ranges that the distinct values of a group are cut into, and the sketch's accuracy.
PARTS, ACCURACY = 64, 1000


def _ranged(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``values`` with ``_range``: the place among splitters that a mergeable quantile sketch of the group's distinct values gives.

    The splitters only set how even the ranges are, whatever the unit or spread of the values; counts in ranges are exact.
    """
    v = F.col(value).cast("double")
    cuts = values.groupBy(*by).agg(F.percentile_approx(v, [i / PARTS for i in range(1, PARTS)], ACCURACY).alias("_cuts"))
    return _joined(values, cuts, by).withColumn("_range", F.size(F.filter("_cuts", lambda c: c <= v))).drop("_cuts")


def _places(values: DataFrame, value: str, by: list[str], places: dict[str, F.Column]) -> DataFrame:
    """Exact order statistics of values(*by, value, n): for each group the value at each place (from 0, of ``total`` values).

    A group's distinct values are dealt to ranges of about equal size, and counted there; only ranges that hold a wanted place
    are sorted, each on its own, so neither a group nor its distinct values meet in one task.
    """
    ranged = _ranged(values, value, by)
    counts = ranged.groupBy(*by, "_range").agg(F.sum("n").alias("_n"))
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"_before": before, "total": F.sum("_n").over(w)})
    held = F.lit(False)
    for place in places.values():
        held = held | ((place >= F.col("_before")) & (place < F.col("_before") + F.col("_n")))
    wanted = counts.where(held).select(*(F.col(k).alias(f"_{k}") for k in by), F.col("_range").alias("_r"), "_before", "total")
    same = F.col("_range") == F.col("_r")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    upto = F.col("_before") + F.sum("n").over(Window.partitionBy(*by, "_range").orderBy(value))
    placed = ranged.join(wanted, same).withColumn("_upto", upto)
    return placed.groupBy(*by).agg(*(F.min(F.when(F.col("_upto") > place, F.col(value))).alias(name) for name, place in places.items()))


def _joined(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return a.join(b.withColumnsRenamed({k: f"_{k}" for k in by}), same, "left").drop(*(f"_{k}" for k in by))


def _place(p: float) -> F.Column:
    """The place round((total - 1) p), halves to even."""
    return F.bround((F.col("total") - 1) * F.lit(p), 0)


def latency_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, mean, p50, p90 and p95 by group, each percentile the value at index round((n - 1) p), halves to even; nulls are left out."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    mean = c.groupBy(*by).agg(F.sum("n").alias("n"), F.round(F.sum(F.col(value) * F.col("n")) / F.sum("n"), 6).alias("mean"))
    return _joined(mean, _places(c, value, by, {f"p{p}": _place(p / 100) for p in (50, 90, 95)}), by)


def grouped_accuracy(rows: DataFrame, keys: tuple[str, str] = ("source", "source_intent")) -> DataFrame:
    """(key, value, n, accuracy) for each value of either key, by grouping sets."""
    g = rows.groupingSets([[F.col(keys[0])], [F.col(keys[1])]], F.col(keys[0]), F.col(keys[1])).agg(F.grouping(keys[0]).alias("g"), F.count("*").alias("n"), F.round(F.avg((F.col("expected") == F.col("predicted")).cast("int")), 6).alias("accuracy"))
    return g.select(F.when(F.col("g") == 0, keys[0]).otherwise(keys[1]).alias("key"), F.coalesce(*map(F.col, keys)).alias("value"), "n", "accuracy")


def flag_mismatches(rows: DataFrame, flags: tuple[str, ...]) -> DataFrame:
    """(flag, mismatches) of expected_<flag> against <flag>; rows without an expectation are left out."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), (F.col(f"expected_{f}").isNotNull() & ~F.col(f"expected_{f}").eqNullSafe(F.col(f))).alias("bad")) for f in flags))).alias("p")
    return rows.select(pairs).groupBy("p.flag").agg(F.count_if("p.bad").alias("mismatches"))


def convert_labels(rows: DataFrame, mapping: dict[str, str], override: str = "router_intent", default: str = "rag") -> DataFrame:
    """rows(case_id, question, intent, metadata map) with expected: override, mapped or default; blank questions go."""
    table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv)) if mapping else F.create_map().cast("map<string,string>")
    return rows.where(F.trim("question") != "").withColumn("expected", F.coalesce(F.col("metadata")[override], F.try_element_at(table, F.col("intent")), F.lit(default)))


def unknown_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(case_id, expected) of rows whose label the table lacks."""
    return rows.join(labels.select(F.col("label").alias("expected")), "expected", "left_anti").select("case_id", "expected")


def describe(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, mean, min, max and p10 to p95 of a number, by group, percentiles as in ``latency_summary``; nulls are left out."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    ends = c.groupBy(*by).agg(F.sum("n").alias("n"), F.round(F.sum(F.col(value) * F.col("n")) / F.sum("n"), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    middle = {"_low": F.floor((F.col("total") - 1) / 2), "_high": F.floor(F.col("total") / 2)}
    out = _joined(ends, _places(c, value, by, middle | {f"p{p}": _place(p / 100) for p in (10, 25, 75, 90, 95)}), by)
    return out.select(*by, "n", "mean", ((F.col("_low") + F.col("_high")) / 2).alias("median"), "least", "most", "p10", "p25", "p75", "p90", "p95")
