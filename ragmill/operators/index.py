"""Index tables: postings, corpus statistics, sparse and hashed dense vectors, and their maintenance."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragmill.functions.text import HASH_SIZE, term_index, tokenize
from ragmill.sources.store import scratch

K1, B = 1.5, 0.75
#: Texts whose tokens are counted at a time, and tokens of which a task keeps what was found out.
ROWS, KNOWN = 2048, 500_000


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if it has fewer splits than there are cores, as a table of one file part has; else as it is.

    So at most one split for each core is shuffled, however large the cluster; larger tables are never.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def tokens_of(chunks: DataFrame, text: str = "text") -> DataFrame:
    """(chunk_id, tokens), with the tokens made once however often they are used: the generator keeps them from being inlined."""
    return spread(chunks.select("chunk_id", text)).select("chunk_id", F.explode(F.array(tokenize(F.col(text)))).alias("tokens"))


def hashed_index(term: str, size: int = HASH_SIZE) -> int:
    """``functions.text.term_index`` of one term."""
    return int.from_bytes(hashlib.md5(term.encode()).digest()[:8], "big") % size


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again; where the cluster names none, ``df`` itself, made again for each use."""
    try:
        path = scratch(df.sparkSession, tag)
    except ValueError:
        return df
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def coded(batches: Iterator[pa.RecordBatch], known: Callable[[str], object]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array, list]]:
    """Slices of batches whose last column has tokens: with the row and the code of each token, the tokens by code, and ``known`` of each."""
    memo: dict[str, object] = {}
    for big in batches:
        for at in range(0, big.num_rows, ROWS):
            b = big.slice(at, ROWS)
            lists = b.column(b.num_columns - 1)
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            codes = lists.flatten().dictionary_encode()
            found = []
            for t in codes.dictionary.to_pylist():
                if t not in memo:
                    if len(memo) >= KNOWN:
                        memo.clear()
                    memo[t] = known(t)
                found.append(memo[t])
            yield b, row, codes.indices.to_numpy().astype(np.int64), codes.dictionary, found


def counted(chunks: DataFrame, wanted: Callable[[str], bool], text: str = "text") -> DataFrame:
    """(chunk_id, length, terms, counts): a row for each chunk, with those of its terms that are ``wanted``, counted in its own task.

    So no token is shuffled. The rows are written; a chunk without such terms has empty arrays.
    """
    tokens = tokens_of(chunks, text).select("chunk_id", F.size("tokens").alias("length"), "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, row, code, names, found in coded(batches, wanted):
            keep = np.array(found, bool)[code] if len(found) else np.zeros(0, bool)
            n = max(1, len(names))
            cell, count = np.unique(row[keep] * n + code[keep], return_counts=True)
            offsets = pa.array(np.searchsorted(cell // n, np.arange(b.num_rows + 1)).astype(np.int32))
            terms = pa.ListArray.from_arrays(offsets, names.take(pa.array(cell % n)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), terms, pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int32)))], names=["chunk_id", "length", "terms", "counts"])

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return written(tokens.mapInArrow(run, f"chunk_id {kind}, length int, terms array<string>, counts array<int>"), "counted")


def repeated(rows: DataFrame) -> DataFrame | None:
    """The chunk_ids that several rows have, or None if no two rows share one."""
    found = written(rows.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select("chunk_id"), "repeated")
    return found if found.head(1) else None


def same_chunk(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``rows`` whose chunk_id is among ``ids`` (left_semi) or not (left_anti); null is an id like others."""
    return rows.join(ids.withColumnRenamed("chunk_id", "_id"), F.col("chunk_id").eqNullSafe(F.col("_id")), how)


def postings(chunks: DataFrame, text: str = "text") -> DataFrame:
    """(chunk_id, term, tf, length): one row for each term of a chunk. Chunks without tokens give none."""
    return tokens_of(chunks, text).select("chunk_id", F.size("tokens").alias("length"), F.explode("tokens").alias("term")).groupBy("chunk_id", "length", "term").agg(F.count("*").alias("tf")).select("chunk_id", "term", "tf", "length")


def corpus_stats(chunks: DataFrame, text: str = "text") -> DataFrame:
    """One row: number of chunks and their mean token count, 1 at least."""
    return tokens_of(chunks, text).select(F.size("tokens").alias("length")).agg(F.count("*").alias("n_chunks"), F.greatest(F.coalesce(F.avg("length"), F.lit(1.0)), F.lit(1.0)).alias("avg_length"))


def idf(n: F.Column, df: F.Column) -> F.Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_stats(posting: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf)."""
    df = posting.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(stats.select("n_chunks")).select("term", "df", idf(F.col("n_chunks"), F.col("df")).alias("idf"))


def saturation(tf: F.Column, length: F.Column, mean: F.Column) -> F.Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def sparse_vectors(posting: DataFrame, stats: DataFrame) -> DataFrame:
    """(chunk_id, index, value): hashed BM25 document weights; terms that share an index add up."""
    weighted = posting.join(term_stats(posting, stats), "term").crossJoin(stats.select("avg_length"))
    return weighted.select("chunk_id", term_index(F.col("term")).alias("index"), (F.col("idf") * saturation(F.col("tf"), F.col("length"), F.col("avg_length"))).alias("v")).groupBy("chunk_id", "index").agg(F.sum("v").alias("value"))


def sparse_query(queries: DataFrame, stats_by_term: DataFrame) -> DataFrame:
    """(query_id, index, value): idf times 1 + ln(1 + tf); a term the corpus lacks has idf 1."""
    q = queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("tf"))
    q = q.join(stats_by_term, "term", "left").select("query_id", term_index(F.col("term")).alias("index"), (F.coalesce("idf", F.lit(1.0)) * (1 + F.log(1 + F.col("tf")))).alias("v"))
    return q.groupBy("query_id", "index").agg(F.sum("v").alias("value"))


def hashed_dense(chunks: DataFrame, dim: int = 64, text: str = "text") -> DataFrame:
    """(chunk_id, vector): signed feature hashing of the tokens, scaled to unit length; all zero without tokens.

    Index and sign come from a token's MD5: the first four bytes modulo ``dim``, and the parity of the fifth. A chunk's tokens
    are hashed and summed in its own task; only chunk_ids are shuffled, and the rows of those that several rows share.
    """
    def place(token: str) -> int:
        digest = hashlib.md5(token.encode()).digest()
        return int.from_bytes(digest[:4], "big") % dim * 2 + digest[4] % 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, row, code, _, found in coded(batches, place):
            at = np.array(found, np.int64)[code] if len(found) else np.zeros(0, np.int64)
            cells = np.bincount(row * dim + at // 2, weights=1 - 2 * (at % 2), minlength=b.num_rows * dim).astype(np.int64)
            offsets = pa.array((np.arange(b.num_rows + 1) * dim).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(cells))], names=["chunk_id", "cells"])

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    out = written(tokens_of(chunks, text).mapInArrow(run, f"chunk_id {kind}, cells array<long>"), "cells")
    twice = repeated(out)
    if twice is not None:
        many = same_chunk(out, twice, "left_semi")
        sums = many.select("chunk_id", F.posexplode("cells").alias("i", "v")).groupBy("chunk_id", "i").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
        whole = sums.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("cells"), F.first("n").alias("n"))
        each = whole.select("chunk_id", "cells", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_")).drop("_")
        out = same_chunk(out, twice, "left_anti").unionByName(each)
    norm = F.sqrt(F.aggregate("cells", F.lit(0.0), lambda a, v: a + v * v))
    out = out.select("chunk_id", F.explode(F.array(F.struct("cells", norm.alias("norm")))).alias("c"))
    return out.select("chunk_id", F.transform("c.cells", lambda v: F.when(F.col("c.norm") > 0, v / F.col("c.norm")).otherwise(0.0)).alias("vector"))


def sanitize(text: F.Column, most: int = 1000) -> F.Column:
    """Text made safe for a model: control characters and U+FFFD as spaces, white space squeezed, cut to ``most``."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, "[\\x00-\\x1f\\x7f�]", " "), "\\s+", " ")), 1, most)


def preview(text: F.Column) -> F.Column:
    """Text made safe for a report: control characters but tab and line ends go."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]", "")


def embed(chunks: DataFrame, model: Callable[[list[str]], list[list[float]]], batch: int = 32) -> tuple[DataFrame, DataFrame]:
    """Vectors by a user's model, and the quarantine of chunks it failed on.

    ``model`` takes a list of texts. A batch that fails is taken row by row; a row that fails is tried once more with its
    sanitized text. Returns (chunk_id, vector, status) and (chunk_id, status, detail, original_length, sanitized_length, truncated).
    """

    def one(text: str, clean: str) -> tuple[list[float] | None, str, str]:
        for status, t in (("ok", text), ("recovered", clean)):
            try:
                return list(map(float, model([t])[0])), status, ""
            except Exception as e:  # noqa: BLE001  a model's failure is data here
                detail = str(e)[:200]
        return None, "failed", detail

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch].copy()
                try:
                    rows = [(list(map(float, v)), "ok", "") for v in model(part["text"].tolist())]
                except Exception:  # noqa: BLE001
                    rows = [one(t, c) for t, c in zip(part["text"], part["clean"])]
                part["vector"], part["status"], part["detail"] = ([r[i] for r in rows] for i in range(3))
                yield part[["chunk_id", "vector", "status", "detail", "original_length", "sanitized_length"]]

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    ready = chunks.select("chunk_id", text.alias("text"), sanitize(text).alias("clean"), F.length(text).alias("original_length"), F.length(sanitize(text)).alias("sanitized_length"))
    out = ready.mapInPandas(run, f"chunk_id {kind}, vector array<double>, status string, detail string, original_length int, sanitized_length int")
    bad = out.where("status <> 'ok'").select("chunk_id", "status", "detail", "original_length", "sanitized_length", (F.col("original_length") > 1000).alias("truncated"))
    return out.where("vector is not null").select("chunk_id", "vector", "status"), bad


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id", order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; of several new rows of a key one counts, the last by ``order`` if given."""
    if not order:
        new = new.dropDuplicates([key])
    else:
        new = new.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def not_deleted() -> F.Column:
    """Rows whose status is not deleted; a missing status passes."""
    return ~F.col("status").eqNullSafe("deleted")


def ingest_decision(incoming: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, decision): skipped where an active chunk has the same content hash, replace where another, insert where none."""
    have = chunks.where(not_deleted()).groupBy("doc_id").agg(F.max("content_hash").alias("_have"))
    decision = F.when(F.col("_have").isNull(), "insert").when(F.col("_have") == F.col("content_hash"), "skipped").otherwise("replace")
    return incoming.join(have, "doc_id", "left").select("doc_id", decision.alias("decision"))


def soft_delete(chunks: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """``chunks`` with status deleted for those of the given documents, and ``changed`` true where that is new."""
    hit = chunks.join(doc_ids.select("doc_id").distinct().withColumn("_hit", F.lit(True)), "doc_id", "left")
    gone = F.col("_hit").isNotNull()
    return hit.withColumn("changed", gone & not_deleted()).withColumn("status", F.when(gone, "deleted").otherwise(F.col("status"))).drop("_hit")


def counts_by_doc(chunks: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, content_hash) over active chunks."""
    return chunks.where(not_deleted()).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max("content_hash").alias("content_hash"))


def backfill_status(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``chunks`` with a missing status set to active, and one row of counts."""
    counts = chunks.agg(F.count("*").alias("scanned"), F.count_if(F.col("status").isNull()).alias("migrated"))
    return chunks.fillna({"status": "active"}), counts


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """Totals by document and over all (doc_id null) of (doc_id, ok, chunks), with the run's status."""
    t = outcomes.rollup("doc_id").agg(F.count_if("ok").alias("parsed"), F.count_if(~F.col("ok")).alias("failed"), F.sum("chunks").alias("chunks"))
    return t.withColumn("status", F.when(F.col("failed") == 0, "ok").otherwise("partial_failed"))
