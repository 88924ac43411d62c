"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination and tokenisation of the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's
docs. All stages but the last return the columns of documents. Extra columns, of whatever name, pass through all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.llm.common import materialize
from ragmill.llm.decontam import drop_contaminated
from ragmill.llm.langid import held_out, keep_identified, profiles
from ragmill.llm.linededup import drop_repeated_runs
from ragmill.llm.pieces import encode_documents
from ragmill.llm.shingles import keep_dissimilar

MIN_LANGUAGE_SCORE = 0.05


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language: ``und``, or a rank-order score under MIN_LANGUAGE_SCORE.

    Profiles are learned from the labelled rows that are not held out. Null and empty texts and those without a letter are
    ``und`` and go; rows with null or shared doc_ids are judged by their own texts; repeated rows stay alike; an empty table
    gives none. No row is shuffled.
    """
    return keep_identified(docs, profiles(docs.where(~held_out())), MIN_LANGUAGE_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines; documents of which nothing but blank lines is left go, the others keep their columns.

    n_chars is counted again where lines went. Null texts and rows with null doc_id stay as they are; equal rows stay alike;
    of rows of one doc_id with unlike texts each is a document; an empty table gives none.
    """
    deleted = "_deleted_9f3c"
    out = drop_repeated_runs(docs, counts=("_lines_9f3c", deleted))
    out = out.where((F.col(deleted) == 0) | (F.trim(F.replace("text", F.lit("\n"), F.lit(" "))) != ""))
    return out.withColumn("n_chars", F.when(F.col(deleted) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that with the smallest doc_id: five-word shingles, Jaccard 0.8 or more.

    SimHash with multi-index hashing, as in op2, finds pairs first, which are verified by their shingles; prefix filtering then
    finds all that fingerprints miss.

    Null, empty and wordless texts are one group. Of equal rows one stays, of rows of one doc_id with unlike texts each is a
    document; rows with null doc_id all stay; an empty table gives none.
    """
    return keep_dissimilar(docs, width=5).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within its edit budget.

    Null and empty texts hold none and stay; rows with null or shared doc_ids are judged by their own texts; repeated rows go
    or stay alike; with an empty benchmark all stay. No row is shuffled.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip of each document that is left; null texts give null ids, empty ones no ids."""
    return encode_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontam", decontaminate),
    ("sentencepiece", tokenize),
]

#: Encoding is not expressible in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
