"""Sessions, short-term state and long-term memories from conversation logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragmill.functions.text import clip, contains_any, squeeze
from ragmill.operators.retrieve import dense_within, ranked
from ragmill.operators.route import RULES

#: Signals of importance, action words, constraints and decisions; weights stand beside each signal.
PREFERENCE = "(以后|以后都|默认|我希望|我不想|以后.*也|固定采用|一直用|始终|一律|统一|全部|偏好)"
LANGUAGE = "(以后|默认|一律|统一|全部|始终).{0,30}(中文|英文|中英文|语言|笔记|回答|输出)"
PROJECT = "(这个项目|本项目).{0,20}(使用|采用|不用|不做|基于|部署在)"
REUSE = "(以后其他项目|复用|通用|模板|标准做法|最佳实践|检查清单)"
NEGATIVE = "(不要|不需要|不做|禁止|避免|不允许|暂不|先不).{2,30}"
SENSITIVE = "(?i)(api[_ ]?key|token|密码|password|secret|身份证|银行卡|手机号|住址|ssh-rsa|-----BEGIN)"
TRANSIENT = "(?i)(报错了|报错|error|failed|临时|这次|刚才|debug|stacktrace|traceback|exception)"
SIGNALS = {"preference": PREFERENCE, "language": LANGUAGE, "project": PROJECT, "workflow": REUSE, "constraint": NEGATIVE, "sensitive": SENSITIVE, "transient": TRANSIENT}
WEIGHTS = {"preference": 0.55, "language": 0.25, "project": 0.25, "workflow": 0.20, "constraint": 0.20, "sensitive": -0.70, "transient": -0.40}
#: Display texts of reasons and prefixes.
REASONS = {"preference": "明确偏好表达", "language": "持续语言偏好", "project": "项目事实", "workflow": "可复用流程", "constraint": "明确约束", "sensitive": "疑似敏感信息", "transient": "疑似临时信息"}
PREFIXES = {"preference": "用户偏好：", "project": "项目事实：", "workflow": "工作流程：", "constraint": "约束："}
ACTION = "(实现|修改|检查|继续|下一步|按照文档|编写|创建|新增|删除|重构|优化|修复|部署)"
CONSTRAINT = "(?:不要|不需要|以后再做|暂不|先不|不做)(.{2,20})"
DECISION = "(?i)(?:完成|已决定|结论|确定|约束|要求|不要|必须|最终).{4,}"
HALF_LIFE = {"semantic": 365.0, "episodic": 90.0, "preference": 365.0, "procedural": 180.0}
LABELS = {"user": "用户", "assistant": "助手"}


def list_sessions(sessions: DataFrame, most: int = 50) -> DataFrame:
    """Each user's sessions that are not deleted, newest first."""
    return ranked(sessions.where("deleted_at is null"), ["user_id"], [F.desc("updated_at"), "session_id"], most)


def recent_messages(messages: DataFrame, most: int = 8, order: str = "created_at") -> DataFrame:
    """Each session's last messages with ``pos`` ascending from 1."""
    last = ranked(messages, ["session_id"], [F.desc(order), F.desc("message_id")], most, "_r")
    return last.withColumn("pos", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("_r")))).drop("_r")


def messages_by_ids(requests: DataFrame, messages: DataFrame) -> DataFrame:
    """requests(request_id, ids array) with their messages, in the order asked for."""
    return requests.select("request_id", F.posexplode("ids").alias("pos", "message_id")).join(messages, "message_id")


def label(role: F.Column) -> F.Column:
    out = role
    for k, v in LABELS.items():
        out = F.when(role == k, v).otherwise(out)
    return out


def recent_context(messages: DataFrame, most: int = 8, order: str = "created_at") -> DataFrame:
    """(session_id, context): the last messages as labelled lines, each cut to 500 characters."""
    line = F.concat(label(F.col("role")), F.lit("："), clip(F.col("content"), 500))
    m = recent_messages(messages, most, order).select("session_id", F.struct("pos", line.alias("line")).alias("x"))
    return m.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("context"))


def token_estimate(text: F.Column) -> F.Column:
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 2).cast("int")))


def touch_sessions(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with updated_at raised to their last message, and token estimates."""
    m = messages.groupBy("session_id").agg(F.max("created_at").alias("_last"), F.sum(token_estimate(F.col("content"))).alias("tokens"))
    return sessions.join(m, "session_id", "left").withColumn("updated_at", F.greatest("updated_at", "_last")).drop("_last").withColumn("tokens", F.coalesce("tokens", F.lit(0)))


def upsert_states(states: DataFrame, updates: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """States with the latest update of each session put in, and the updates of sessions that are missing."""
    known = updates.join(sessions.where("deleted_at is null").select("session_id"), "session_id", "left_semi")
    latest = ranked(known, ["session_id"], [F.desc("updated_at")], 1, "_r").drop("_r")
    out = states.join(latest.select("session_id"), "session_id", "left_anti").unionByName(latest, allowMissingColumns=True)
    return out, updates.join(sessions.where("deleted_at is null").select("session_id"), "session_id", "left_anti")


def append_bounded(items: F.Column, item: F.Column, most: int = 8) -> F.Column:
    """The last ``most`` of an array after an item is added."""
    both = F.array_append(items, item)
    return F.slice(both, F.greatest(F.size(both) - most + 1, F.lit(1)), most)


def delete_sessions(sessions: DataFrame, states: DataFrame, ids: DataFrame, at: F.Column) -> tuple[DataFrame, DataFrame]:
    """Sessions marked as deleted at a time, and states without theirs."""
    hit = sessions.join(ids.select("session_id").distinct().withColumn("_hit", F.lit(True)), "session_id", "left")
    marked = hit.withColumn("deleted_at", F.when(F.col("_hit") & F.col("deleted_at").isNull(), at).otherwise(F.col("deleted_at"))).drop("_hit")
    return marked, states.join(ids, "session_id", "left_anti")


def session_state(messages: DataFrame, order: str = "created_at", action: str = ACTION, constraint: str = CONSTRAINT) -> DataFrame:
    """(session_id, current_goal, current_step, constraints) after all user turns.

    Goal: the first question, 60 characters. Step: the last question with an action word, 50. Constraints: each turn's first
    constraint phrase, distinct, in order of first use.
    """
    u = messages.where("role = 'user'").select("session_id", F.col(order).alias("o"), squeeze(F.col("content")).alias("q"), F.trim(F.regexp_extract("content", constraint, 0)).alias("c"))
    g = u.groupBy("session_id").agg(F.substring(F.min_by("q", "o"), 1, 60).alias("current_goal"), F.substring(F.max_by("q", F.when(F.col("q").rlike(action), F.col("o"))), 1, 50).alias("current_step"))
    c = u.where("c <> ''").groupBy("session_id", "c").agg(F.min("o").alias("o")).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "c"))), lambda x: x["c"]).alias("constraints"))
    return g.join(c, "session_id", "left").withColumn("constraints", F.coalesce("constraints", F.array().cast("array<string>")))


def rolling_summary(messages: DataFrame, at_least: int = 20, keep: int = 16, most: int = 1500, order: str = "created_at", window: int = 500, decision: str = DECISION) -> DataFrame:
    """(session_id, summary) of sessions with ``at_least`` messages: over all of the last ``window`` but the last ``keep``.

    The first question (80 characters), the last 8 others (60 each), the last 5 decision sentences (100 each, distinct by their
    first 20 characters), cut to ``most``. Sessions are bounded by ``window`` messages here.
    """
    m = ranked(messages, ["session_id"], [F.desc(order), F.desc("message_id")], window, "_r").withColumn("_n", F.count("*").over(Window.partitionBy("session_id")))
    old = m.where((F.col("_n") >= at_least) & (F.col("_r") > keep))
    q = squeeze(F.col("content"))
    item = F.struct((-F.col("_r")).alias("i"), F.when((F.col("role") == "user") & (q != ""), q).alias("q"), F.regexp_extract_all("content", F.lit(decision), F.lit(0)).alias("d"))
    s = old.groupBy("session_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    s = s.select("session_id", F.filter(F.transform("x", lambda x: x["q"]), lambda x: x.isNotNull()).alias("qs"), F.transform(F.flatten(F.transform("x", lambda x: x["d"])), lambda d: clip(F.trim(d), 100)).alias("ds"))
    rest = F.slice("qs", 2, F.greatest(F.size("qs") - 1, F.lit(0)))
    s = s.withColumn("rest", F.transform(rest, lambda r: clip(r, 60))).withColumn("ds", F.filter("ds", lambda d, i: (d != "") & ~F.exists(F.slice("ds", 1, i), lambda e: F.substring(e, 1, 20) == F.substring(d, 1, 20))))
    tail = lambda c, n: F.slice(c, F.greatest(F.size(c) - n + 1, F.lit(1)), n)
    lines = F.array_compact(
        F.array(
            F.when(F.size("qs") > 0, F.concat(F.lit("最初目标："), clip(F.get("qs", F.lit(0)), 80))),
            F.when(F.size("rest") > 0, F.concat(F.lit("历史问题："), F.array_join(tail(F.col("rest"), 8), "；"))),
            F.when(F.size("ds") > 0, F.concat(F.lit("关键决定："), F.array_join(tail(F.col("ds"), 5), "；"))),
        )
    )
    return s.select("session_id", clip(F.array_join(lines, "\n"), most).alias("summary"))


#: Titles of the parts of a short-term context, in order.
CONTEXT_TITLES = ("当前任务目标", "当前步骤", "当前约束", "待完成事项", "已完成事项", "滚动摘要", "中间结果", "关键消息", "最近对话")


def _items(values: F.Column) -> F.Column:
    """Items that are not blank as lines of a list."""
    return F.array_join(F.transform(F.filter(values, lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("- "), x)), "\n")


def _message_line() -> F.Column:
    return F.concat(label(F.col("role")), F.lit("："), clip(F.col("content"), 500))


def context_sections(states: DataFrame, messages: DataFrame, recent: int = 8, pinned: int = 5, order: str = "created_at") -> DataFrame:
    """(session_id, pos, title, body): the parts of each session's short-term context, in order.

    states(session_id, current_goal, current_step, constraints, pending_items, completed_items, rolling_summary,
    intermediate_results array of (step, status, summary), pinned_message_ids) give the first seven parts; the first ``pinned``
    messages asked for, in that order, and the last ``recent`` ones follow. Sessions without a state have their recent messages
    only; those without messages have no such part; null parts are left out.
    """
    joined = lambda x: F.array_join(F.filter(F.array(x["step"], x["status"], x["summary"]), lambda v: v.isNotNull() & (v != "")), "：")
    results = F.array_join(F.transform(F.filter("intermediate_results", lambda x: joined(x) != ""), lambda x: F.concat(F.lit("- "), joined(x))), "\n")
    bodies = [F.col("current_goal"), F.col("current_step"), _items(F.col("constraints")), _items(F.col("pending_items")), _items(F.col("completed_items")), F.col("rolling_summary"), results]
    parts = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(t).alias("title"), b.alias("body")) for i, (t, b) in enumerate(zip(CONTEXT_TITLES, bodies))))
    out = states.select("session_id", F.explode(parts).alias("p")).select("session_id", "p.*")
    asked = states.select(F.col("session_id").alias("request_id"), F.slice("pinned_message_ids", 1, pinned).alias("ids"))
    kept = messages_by_ids(asked, messages.withColumnRenamed("session_id", "of")).where("of = request_id").select(F.col("request_id").alias("session_id"), "pos", _message_line().alias("line"))
    last = recent_messages(messages, recent, order).select("session_id", "pos", _message_line().alias("line"))
    for i, lines in ((7, kept), (8, last)):
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
        out = out.unionByName(lines.groupBy("session_id").agg(body.alias("body")).select("session_id", F.lit(i).alias("pos"), F.lit(CONTEXT_TITLES[i]).alias("title"), "body"))
    return out.where("body is not null")


def fit_sections(sections: DataFrame, most: int = 3500) -> DataFrame:
    """(session_id, text, truncated) of sections(session_id, pos, title, body) in order, up to the budget.

    Blocks go in while they fit; of the first that does not, a part goes in if over 200 characters are left; then it stops.
    """
    s = sections.where("trim(body) <> ''").withColumn("block", F.concat(F.lit("# "), F.col("title"), F.lit("\n"), F.trim("body"), F.lit("\n")))
    w = Window.partitionBy("session_id").orderBy("pos")
    s = s.withColumn("upto", F.sum(F.length("block")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("over", F.coalesce(F.sum((F.col("upto") > most).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    left = most - (F.col("upto") - F.length("block"))
    block = F.when(F.col("over") == 0, F.col("block")).when((F.col("over") == 1) & (left > 200), F.concat(F.rtrim(F.expr(f"substring(block, 1, cast({most} - (upto - length(block)) as int))")), F.lit("\n[已截断]\n")))
    parts = F.transform(F.array_sort(F.collect_list(F.when(block.isNotNull(), F.struct("pos", block.alias("b"))))), lambda x: x["b"])
    return s.groupBy("session_id").agg(F.trim(F.regexp_replace(F.array_join(parts, "\n"), "^\\s+|\\s+$", "")).alias("text"), (F.max("over") > 0).alias("truncated"))


def score_importance(df: DataFrame, text: str = "content", signals: dict = SIGNALS) -> DataFrame:
    """Adds importance, confidence, memory_type, tags and reason by regex signals; a text under 6 characters has none."""
    t = F.trim(F.col(text))
    hit = {n: t.rlike(p) for n, p in signals.items()}
    long_ = F.length(t) >= 6
    any_ = F.lit(False)
    score = F.lit(0.0)
    for n, h in hit.items():
        any_ = any_ | h
        score = score + F.when(h, WEIGHTS[n]).otherwise(0.0)
    conf = F.greatest(F.when(hit["preference"], 0.82).otherwise(0.6), F.when(hit["language"], 0.85).otherwise(0.0), F.when(hit["project"], 0.75).otherwise(0.0), F.when(hit["workflow"] | hit["constraint"], 0.7).otherwise(0.0))
    tag = lambda on, name: F.when(on, name)
    tags = F.array_compact(F.array(tag(hit["preference"] | hit["language"], "preference"), tag(hit["language"], "language"), tag(hit["project"], "project"), tag(hit["workflow"], "workflow"), tag(hit["constraint"], "constraint")))
    reason = F.concat_ws("；", *(F.when(h, REASONS[n]) for n, h in hit.items()))
    none = F.array().cast("array<string>")
    return df.withColumns(
        {
            "importance": F.when(long_, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)).otherwise(0.0), "confidence": F.when(~long_, 0.0).when(any_, conf).otherwise(0.3), "memory_type": F.when(long_ & hit["workflow"], "procedural").otherwise("semantic"),
            "tags": F.when(long_, tags).otherwise(none), "reason": F.when(~long_, "文本过短").when(any_, reason).otherwise("无明确高价值信号"),
        }
    )


def extract_candidates(turns: DataFrame, most: int = 2, signals: dict = SIGNALS) -> DataFrame:
    """Memory candidates of user turns(turn_id, …, content): scored sentences with a prefix for their first tag, the best ``most`` a turn."""
    rest = [c for c in turns.columns if c != "content"]
    s = turns.select(*rest, F.posexplode(F.split("content", "[。！？!?\\n；;]")).alias("sentence_no", "content")).withColumn("content", F.trim("content")).where(F.length("content") >= 6)
    s = score_importance(s, "content", signals).where("importance > 0")
    clean = F.regexp_replace("content", "[。！？!?. ]+$", "")
    prefix = F.coalesce(*(F.when(F.array_contains("tags", t), p) for t, p in PREFIXES.items()), F.when(F.col("memory_type") == "procedural", "流程：").otherwise("记忆："))
    return ranked(s.withColumn("content", F.concat(prefix, clean)), ["turn_id"], [F.desc("importance"), "sentence_no"], most)


def dedupe_memories(candidates: DataFrame, memories: DataFrame, importance: float = 0.72, confidence: float = 0.65, near: float = 0.88) -> tuple[DataFrame, DataFrame]:
    """Candidates good enough, as (to insert, to merge); those near an active memory of the same user are merged into the nearest.

    A user's candidates and memories meet block by block; of equal cosines the larger memory_id counts. candidate_id is unique.
    """
    good = candidates.where((F.col("importance") >= importance) & (F.col("confidence") >= confidence))
    m = memories.where("status = 'active'").select("user_id", F.col("memory_id").alias("chunk_id"), "vector")
    s = dense_within(good.select("user_id", F.col("candidate_id").alias("query_id"), "vector"), m, "user_id", 1, near).select(F.col("query_id").alias("candidate_id"), F.col("chunk_id").alias("memory_id"), F.col("score").alias("cosine"))
    best = s.groupBy("candidate_id").agg(F.max_by("memory_id", F.struct("cosine", "memory_id")).alias("memory_id"), F.max("cosine").alias("cosine"))
    return good.join(best, "candidate_id", "left_anti"), good.join(best, "candidate_id")


def merge_memories(memories: DataFrame, merges: DataFrame) -> DataFrame:
    """Memories with the higher importance and confidence and the union of tags of what is merged into them."""
    g = merges.groupBy("memory_id").agg(F.max("importance").alias("_i"), F.max("confidence").alias("_c"), F.array_distinct(F.flatten(F.collect_set("tags"))).alias("_t"))
    j = memories.join(g, "memory_id", "left")
    return j.withColumns({"importance": F.greatest("importance", "_i"), "confidence": F.greatest("confidence", "_c"), "tags": F.array_sort(F.array_union("tags", F.coalesce("_t", F.array().cast("array<string>"))))}).drop("_i", "_c", "_t")


def search_memories(queries: DataFrame, memories: DataFrame, as_of: F.Column, k: int = 5, least: float = 0.35, half_life: dict = HALF_LIFE) -> DataFrame:
    """(query_id, memory_id, cosine, score, rank): the 3 k nearest active memories of a query's user, aged and weighted, the best ``k``.

    score = cosine x 0.5^(age / half-life) x (0.75 + 0.5 importance); ``as_of`` is the time that ages are counted to.
    """
    m = memories.where("status = 'active'")
    near = dense_within(queries, m.select("user_id", F.col("memory_id").alias("chunk_id"), "vector"), "user_id", 3 * k).select("query_id", F.col("chunk_id").alias("memory_id"), F.col("score").alias("cosine"))
    near = ranked(near, ["query_id"], [F.desc("cosine"), "memory_id"], 3 * k, "_r").drop("_r").join(m.drop("vector", "user_id"), "memory_id").join(queries.drop("vector"), "query_id")
    days = F.greatest(F.lit(0.0), (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros("created_at")) / 86_400_000_000)
    half = F.coalesce(*(F.when(F.col("memory_type") == t, F.lit(d)) for t, d in half_life.items()), F.lit(365.0))
    score = F.round(F.col("cosine") * F.pow(F.lit(0.5), F.coalesce(days, F.lit(0.0)) / half) * (0.75 + 0.5 * F.col("importance")), 6)
    return ranked(near.withColumn("score", score).where(F.col("score") >= least), ["query_id"], [F.desc("score"), "memory_id"], k)


def memory_prompt(hits: DataFrame, most: int = 1200) -> DataFrame:
    """(query_id, prompt): lines of type, score and content in rank order."""
    line = F.concat(F.lit("- ["), F.col("memory_type"), F.format_string("|%.2f] ", F.col("score")), F.col("content"))
    g = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("p"))
    return g.select("query_id", F.substring("p", 1, most).alias("prompt"))


#: What a question about memories is on, and the words of memories that answer it.
MEMORY_TOPICS, MEMORY_WORDS = ("火灾", "笔记"), ("火灾", "笔记", "中文", "英文", "标题", "格式")


def memory_lines(prompts: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, pos, memory): the memories in prompts(query_id, query, prompt) that answer a question about them, the first ``most``.

    A line loses its mark of type and score; blank ones go. For a question on one of MEMORY_TOPICS, lines with one of
    MEMORY_WORDS are taken, if there are any. pos counts from 1.
    """
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), "^-\\s*\\[[^\\]]+\\]\\s*", ""), "^[- ]+", ""))
    p = prompts.select("query_id", contains_any(F.coalesce("query", F.lit("")), MEMORY_TOPICS).alias("on"), F.filter(F.transform(F.split("prompt", "\n"), clean), lambda x: x != "").alias("lines"))
    focused = F.filter("lines", lambda x: contains_any(x, MEMORY_WORDS))
    lines = F.when(F.col("on") & (F.size(focused) > 0), focused).otherwise(F.col("lines"))
    return p.select("query_id", F.posexplode(F.slice(lines, 1, most)).alias("pos", "memory")).withColumn("pos", F.col("pos") + 1)


def user_questions(messages: DataFrame, topic: str | None = None, most: int = 8, order: str = "created_at") -> DataFrame:
    """Each session's last questions, on a topic if given, none of them about the history itself."""
    u = messages.where("role = 'user'")
    for w in RULES["history"]:
        u = u.where(~F.col("content").contains(w))
    return recent_messages(u.where(F.col("content").contains(topic)) if topic else u, most, order)
