"""Readers of file manifests, layout JSON, JSON lines, web results and traces; writers of their tables."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ragmill.functions.text import squeeze
from ragmill.operators.ingest import table_rows

#: Block types that carry no text of their own.
AUXILIARY = ("header", "footer", "page_number", "aside_text", "page_header", "page_footer", "page_aside_text")
FIGURES = ("image", "chart")
#: Where a block has its text, and where a nested piece has it, the first that is not empty.
TEXT_KEYS = ("title_content", "paragraph_content", "text", "content", "list_items", "list_content", "math_content", "equation", "code_content", "html")
PIECE_KEYS = ("text", "content", "title_content", "paragraph_content", "caption", "table_body", "image_caption", "chart_caption", "math_content")


def manifest(spark: SparkSession, folder: str, pattern: str = "*.pdf", most: int | None = None) -> DataFrame:
    """(path, length, modified, sha256) of the files that match, in path order; raises if there are none."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    out = f.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256")).orderBy("path")
    if not f.select("path").head(1):
        raise FileNotFoundError(f"no {pattern} under {folder}")
    return out.limit(most) if most else out


def layout_blocks(docs: DataFrame, max_pages: int | None = None) -> DataFrame:
    """(doc_id, page_number, pos, block) of docs(doc_id, variant, json) in one of three shapes; ``block`` is a variant, of any fields.

    ``pages``: a list of pages, each a list of blocks; ``flat``: a list of blocks with page_idx from 0; ``middle``: pdf_info with
    blocks by page. Of several shapes of a document the first in this order counts. Pages beyond ``max_pages`` are left out.
    JSON that is malformed, or of another shape, gives no block.
    """
    order = F.when(F.col("variant") == "pages", 0).when(F.col("variant") == "flat", 1).otherwise(2)
    best = docs.groupBy("doc_id").agg(F.min_by(F.struct("variant", "json"), order).alias("b")).select("doc_id", "b.variant", F.try_parse_json("b.json").alias("v"))
    many = lambda v, path="$": F.try_variant_get(v, path, "array<variant>")
    number = lambda v: F.coalesce(F.try_variant_get(v, "$.page_idx", "int"), F.lit(0)) + 1
    pages = best.where("variant = 'pages'").select("doc_id", F.posexplode(many(F.col("v"))).alias("p", "blocks")).select("doc_id", (F.col("p") + 1).alias("page_number"), F.posexplode(many(F.col("blocks"))).alias("pos", "block"))
    flat = best.where("variant = 'flat'").select("doc_id", F.posexplode(many(F.col("v"))).alias("pos", "block")).select("doc_id", number(F.col("block")).alias("page_number"), "pos", "block")
    middle = best.where("variant = 'middle'").select("doc_id", F.explode(many(F.col("v"), "$.pdf_info")).alias("p")).select("doc_id", number(F.col("p")).alias("page_number"), F.posexplode(many(F.col("p"), "$.para_blocks")).alias("pos", "block"))
    out = pages.unionByName(flat).unionByName(middle)
    return out.where(F.col("page_number") <= max_pages) if max_pages else out


def _flat_text(value) -> str:
    """The text of a nested value: pieces of a list one after the other, of a piece the first text that is not empty."""
    if isinstance(value, str):
        return " ".join(re.sub("<[^>]+>", " ", value).split())
    if isinstance(value, bool) or value is None:
        return ""
    if isinstance(value, list):
        return " ".join(filter(None, map(_flat_text, value)))
    if isinstance(value, dict):
        return next(filter(None, (_flat_text(value.get(k)) for k in PIECE_KEYS)), "")
    return str(value)


@F.pandas_udf(StringType())
def _rich_text(values: pd.Series) -> pd.Series:
    """The first text that is not empty of a JSON list of values."""
    return values.map(lambda v: None if v is None else next(filter(None, map(_flat_text, json.loads(v))), ""))


def _first_text(block: str, keys: tuple[str, ...]) -> F.Column:
    """The first text, of any depth, that is not empty under the keys of a variant column; empty if there is none."""
    held = F.array_compact(F.array(*(F.to_json(F.try_variant_get(F.col(block), f"$.{k}", "variant")) for k in keys)))
    return F.coalesce(_rich_text(F.concat(F.lit("["), F.array_join(held, ","), F.lit("]"))), F.lit(""))


def block_text(block: str = "block") -> F.Column:
    """The first non-empty text of a block, however deep its content is nested."""
    return _first_text(block, TEXT_KEYS)


def route_blocks(blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(text, tables, captions) of a document's blocks; headers, footers, numbers and asides are dropped."""
    field = lambda k, kind="string": F.try_variant_get(F.col("block"), f"$.{k}", kind)
    b = blocks.withColumn("kind", F.lower(F.coalesce(field("type"), field("block_type"), F.lit("text")))).where(~F.col("kind").isin(*AUXILIARY))
    given = F.coalesce(field("text_level", "int"), field("level", "int"))
    level = F.when(F.col("kind") == "title", F.greatest(F.coalesce(given, F.lit(1)), F.lit(1))).when(F.coalesce(given, F.lit(0)) > 0, given)
    text = b.where(~F.col("kind").isin("table", *FIGURES)).select("doc_id", "page_number", "pos", squeeze(block_text()).alias("line"), F.when(level.isNotNull(), F.least(level, F.lit(6))).alias("level")).where("line <> ''")
    body = F.coalesce(F.nullif(field("table_body"), F.lit("")), F.nullif(field("html"), F.lit("")), field("text"))
    tables = b.where("kind = 'table'").select("doc_id", "page_number", "pos", F.nullif(_first_text("block", ("table_caption", "caption")), F.lit("")).alias("title"), table_rows(body).alias("rows"))
    captions = b.where(F.col("kind").isin(*FIGURES)).select("doc_id", "page_number", "pos", _first_text("block", ("image_caption", "chart_caption", "caption", "text")).alias("caption")).where("caption <> ''")
    return text, tables, captions


def read_jsonl(spark: SparkSession, path: str, schema: str, most: int | None = None) -> DataFrame:
    """Records of a JSON-lines file; blank lines and those that begin with # are skipped, a malformed one fails the read."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')")
    out = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return out.limit(most) if most else out


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines without null fields."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def review_table(cases: DataFrame, predictions: DataFrame, scores: DataFrame) -> DataFrame:
    """Cases with predictions and scores for review by hand, arrays as text."""
    j = cases.join(predictions, "case_id", "left").join(scores, "case_id", "left")
    joined = {"contexts": "\n---\n", "citations": "\n", "errors": "；", "keywords": "；", "required": "；", "tags": "；"}
    return j.withColumns({c: F.array_join(c, sep) for c, sep in joined.items() if c in j.columns}).drop("metadata")


def write_chunks(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Chunk rows with content_hash and status defaulted, in folders by status."""
    have = set(chunks.columns)
    out = chunks.withColumns({c: F.coalesce(F.col(c), F.lit(d)) if c in have else F.lit(d) for c, d in (("content_hash", ""), ("status", "active"))})
    out.write.mode(mode).partitionBy("status").parquet(path)


def web_results(responses: DataFrame) -> DataFrame:
    """Rows of search responses(query_id, json): typed fields defaulted, unknown ones kept in ``extra``."""
    known = ("title", "url", "content", "raw_content", "score", "published_date")
    r = responses.select("query_id", F.from_json("json", "struct<query:string,answer:string,results:array<map<string,string>>>").alias("r"))
    e = r.select("query_id", F.col("r.answer").alias("answer"), F.posexplode_outer("r.results").alias("result_no", "m"))
    get = lambda k: F.coalesce(F.col("m")[k], F.lit(""))
    text = F.coalesce(F.nullif(get("raw_content"), F.lit("")), get("content"))
    return e.select("query_id", "answer", "result_no", get("title").alias("title"), get("url").alias("url"), text.alias("text"), F.coalesce(F.expr("try_cast(m['score'] as double)"), F.lit(0.0)).alias("score"), F.col("m")["published_date"].alias("published_date"), F.map_filter("m", lambda k, v: ~k.isin(*known)).alias("extra"))


TRACE = "trace_id string, session_id string, intent string, goal string, start_time string, end_time string, final_status string, steps array<struct<step_id:int,step_type:string,status:string,latency_ms:bigint,error:string>>"


def read_traces(spark: SparkSession, folder: str) -> DataFrame:
    """Traces kept as <date>/<trace_id>.json, with the date of their folder."""
    t = spark.read.schema(TRACE).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)
    return t.withColumn("date", F.regexp_extract(F.col("_metadata.file_path"), "/(\\d{4}-\\d{2}-\\d{2})/[^/]*$", 1))


def write_traces(traces: DataFrame, path: str, index: str | None = None) -> None:
    """Traces as JSON in folders by the day they began; with ``index`` also one row a trace there, as JSON lines."""
    traces.withColumn("date", F.to_date("start_time")).write.mode("append").partitionBy("date").json(path)
    if index:
        from ragmill.operators.traces import trace_index

        trace_index(traces).write.mode("append").json(index)
