"""Intent routing of a query table by rules, with an optional table of model predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.functions.text import contains_any

#: Word lists and patterns of the guardrails.
RULES = {
    "chat": ("你好", "您好", "hello", "hi", "你是谁", "谢谢", "感谢"),
    "preference": ("默认", "我希望", "我不想", "固定采用", "一直用", "始终", "一律", "统一", "全部用", "都用", "偏好是", "偏好设置"),
    "memory": ("我的偏好", "偏好有什么", "偏好是什么", "长期记忆", "记住了什么", "你记得什么", "我设置过", "我之前设置", "应该用什么格式", "用什么格式", "用什么语言", "标题前缀", "标题前加"),
    "history": ("之前问过", "刚才问过", "前面问过", "上次问过", "上一条问题", "历史问题", "问过什么", "刚才的问题"),
    "paper": ("总结", "综述", "概括", "对比", "比较", "论文", "文献", "作者", "摘要"),
    "emergency": ("怎么办", "如何逃生", "应急", "报警", "疏散路线", "自救", "逃生", "灭火器", "被困"),
    "domain": ("火灾", "消防", "烟气", "烟雾", "浓烟", "火焰", "燃烧", "疏散", "排烟", "森林火", "隧道", "防火", "灭火", "火警"),
    "harmful": ("纵火", "制造火灾", "规避消防", "绕过报警", "破坏灭火", "如何放火", "怎么纵火"),
}
#: Patterns that count as words of a list do.
PATTERNS = {
    "preference": "(以后|默认|始终|一律|统一|全部|都).{0,30}(笔记|回答|输出|语言|中文|英文|格式)",
    "memory": "(笔记|回答|输出|标题|格式|语言).{0,20}(应该|需要|用什么|怎么|如何|是什么)",
}
#: The guardrails in order, as list of words, route and what it needs.
GUARDRAILS = (
    ("history", "chat", "history_query", ()),
    ("preference", "chat", "preference_write", ("memory",)),
    ("memory", "chat", "memory_query", ("memory",)),
    ("harmful", "reject", "harmful_fire_request", ()),
    ("chat", "chat", "greeting", ()),
    ("emergency", "emergency", "emergency_escape", ("rag", "safety")),
)
#: Fixed value: a greeting is no longer than this.
GREETING = 30
ROUTE = "struct<intent:string,sub_intent:string,need_rag:boolean,need_memory:boolean,need_safety_notice:boolean,source:string>"


def _row(intent: str, sub: str, source: str, needs: tuple[str, ...] = ()) -> F.Column:
    flags = {"need_rag": "rag", "need_memory": "memory", "need_safety_notice": "safety"}
    return F.struct(F.lit(intent).alias("intent"), F.lit(sub).alias("sub_intent"), *(F.lit(n in needs).alias(f) for f, n in flags.items()), F.lit(source).alias("source"))


def _applies(q: F.Column, name: str, rules: dict) -> F.Column:
    """Whether a question holds a word or the pattern of a list; greetings must be short, emergencies also of the domain."""
    if name == "chat":
        low = F.lower(F.trim(q))
        return contains_any(low, rules[name]) & (F.length(low) <= GREETING)
    found = contains_any(q, rules[name])
    if name in PATTERNS:
        found = found | q.rlike(PATTERNS[name])
    return found & contains_any(q, rules["domain"]) if name == "emergency" else found


def guardrails(q: F.Column, rules: dict = RULES, source: str = "hard_rule") -> F.Column:
    """A route where one of the certain rules applies, in their order, else null; an empty question is small talk."""
    out = F.when(F.coalesce(F.trim(q), F.lit("")) == "", _row("chat", "empty_input", source))
    for name, intent, sub, needs in GUARDRAILS:
        out = out.when(_applies(q, name, rules), _row(intent, sub, source, needs))
    return out


def route_rules(q: F.Column, rules: dict = RULES) -> F.Column:
    """Guardrails, then papers and the domain; anything else is out of it."""
    domain = contains_any(q, rules["domain"])
    s = "fallback_rule"
    rest = F.when(contains_any(q, rules["paper"]) & domain, _row("paper", "paper_summary", s, ("rag",))).when(domain, _row("rag", "knowledge_qa", s, ("rag",))).otherwise(_row("reject", "out_of_domain", s))
    return F.coalesce(guardrails(q, rules, s), rest)


def route(queries: DataFrame, predictions: DataFrame | None = None, threshold: float = 0.75, shadow: bool = False, rules: dict = RULES) -> DataFrame:
    """queries with intent, sub_intent, the three needs and source.

    Guardrails stand; else a prediction(query_id, intent, sub_intent, need_rag, need_memory, need_safety_notice, confidence) of at
    least ``threshold`` counts, else the rules; in shadow mode the rules always count.
    """
    hard, soft = guardrails(F.col("text"), rules), route_rules(F.col("text"), rules)
    if predictions is None or shadow:
        out = queries.withColumn("_r", F.coalesce(hard, soft))
    else:
        named = ("intent", "sub_intent", "need_rag", "need_memory", "need_safety_notice")
        p = predictions.select("query_id", F.struct(*named, F.lit("llm").alias("source")).cast(ROUTE).alias("_p"), F.col("confidence").alias("_c"))
        out = queries.join(p, "query_id", "left").withColumn("_r", F.coalesce(hard, F.when(F.col("_c") >= threshold, F.col("_p")), soft)).drop("_p", "_c")
    return out.select("*", "_r.*").drop("_r")


def parse_json_object(text: F.Column, schema: str) -> F.Column:
    """The record between the outermost braces of a model's output; null where there is none or it can't be read."""
    body = F.regexp_extract(F.regexp_replace(text, "```(?:json)?", ""), "(?s)\\{.*\\}", 0)
    return F.when(body != "", F.from_json(body, schema))
