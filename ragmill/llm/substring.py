"""Substring dedup by hashing runs of sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.llm.common import materialize, tidy

MIN_WORDS = 20
#: A sentence runs up to and over its end marks, the blanks after them and a line break; sentences cover the text.
SENTENCE = re.compile(r"[^.!?\n]*[.!?]*[ \t]*\n?")
PART_ROWS = 500_000


def _units(text: str, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, stops and digests (two longs a row) of a text's units: see ``units``."""
    plain = text.replace("\t", " ").replace("\n", " ")
    spans, digests, words = [], [], []
    for m in SENTENCE.finditer(text):
        s, e = m.span()
        norm = " ".join(filter(None, plain[s:e].lower().split(" ")))
        if norm:
            spans.append((s, e)), digests.append(xxhash.xxh3_128_digest(norm.encode("utf-8", "replace"))), words.append(norm.count(" ") + 1)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    if sum(words) < min_words:
        return none
    total = np.r_[0, np.cumsum(words)]
    n = len(words)
    to = np.searchsorted(total, total[:-1] + min_words)  # shortest run from each sentence on, and up to each
    since = np.searchsorted(total, total[1:] - min_words, "right") - 1
    first = np.concatenate([np.arange(n)[to <= n], since[since >= 0]])
    last = np.concatenate([to[to <= n], np.arange(1, n + 1)[since >= 0]])
    key = np.unique(first * (n + 1) + last)
    first, last = key // (n + 1), key % (n + 1)
    joined, at = b"".join(digests), np.array(spans, np.int64)
    digest = xxhash.xxh3_128_digest
    keys = b"".join([digest(joined[16 * i : 16 * j]) for i, j in zip(first.tolist(), last.tolist())])
    return at[first, 0], at[last - 1, 1], np.frombuffer(keys, np.int64).reshape(-1, 2)


def units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, d, start, stop, k1, k2): the shortest runs of whole sentences with ``min_words`` words, from and up to each one.

    A run may go over line ends; sentences are lower-cased, with single blanks; those without words are passed over. Offsets
    are characters in the original text, ``d`` is a digest of it, and the two digests of a run are 64 bits each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, parts, held = [], [], 0
            for row, text in enumerate(b.column(2)):
                part = _units(text.as_py() or "", min_words)
                rows.append(np.full(len(part[0]), row)), parts.append(part)
                held += len(part[0])
                if held >= PART_ROWS or row == b.num_rows - 1:
                    row_at = pa.array(np.concatenate(rows))
                    start, stop, k = (np.concatenate(c) for c in zip(*parts))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(row_at), b.column(1).take(row_at), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy())],
                        names=["doc_id", "d", "start", "stop", "k1", "k2"],
                    )
                    rows, parts, held = [], [], 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("d"), "text")
    return named.mapInArrow(tidy(run), f"doc_id {kind}, d long, start int, stop int, k1 long, k2 long")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, d, start, stop) of the units that an earlier unit equals.

    Units are made once and written. Digests are grouped with map-side minima, so a unit that a third of all documents share
    costs each task one row; the join back is with the repeated digests only, one row each.
    """
    u = materialize(units(docs, min_words), "units")
    at = F.struct("doc_id", "d", "start")
    first = u.groupBy("k1", "k2").agg(F.min(at).alias("f"), F.max(at).alias("l")).where("f <> l").select("k1", "k2", "f")
    return u.join(materialize(first, "repeats"), ["k1", "k2"]).where(at != F.col("f")).select("doc_id", "d", "start", "stop")


def _merge(spans: list[dict]) -> list[list[int]]:
    merged: list[list[int]] = []
    for x in spans:
        if merged and x["start"] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], x["stop"])
        else:
            merged.append([x["start"], x["stop"]])
    return merged


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text, n_removed, removed: each text without its repeated passages, and the original spans that went.

    A passage goes if it is a run of whole sentences of ``min_words`` words or more that occurs at an earlier (doc_id, text
    digest, start), lower-cased and with blanks and line ends alike; sentences end at ., !, ? or a line's end, so lines and
    paragraphs are such runs too, and short ones count together with their neighbours. Of equal passages the first stays.
    ``removed`` is the merged spans as "start-stop" in characters of the original, joined by commas; n_removed is their count.

    Rows of one doc_id with unlike texts are documents of their own; equal ones count as one and stay alike. Null texts stay
    null, empty and shorter ones as they are, as do rows with null doc_id; an empty table gives none; extra columns are ignored.
    """
    spans = repeated_spans(docs, min_words).groupBy("doc_id", "d").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, removed = [], [], []
            for text, found in zip(b.column(1), b.column(2)):
                text, merged = text.as_py(), _merge(found.as_py() or [])
                edges = [0, *(e for m in merged for e in m), None]
                texts.append(text if not merged or text is None else "".join(text[i:j] for i, j in zip(edges[::2], edges[1::2])))
                counts.append(len(merged))
                removed.append(",".join(f"{i}-{j}" for i, j in merged))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(removed, pa.string())], names=["doc_id", "text", "n_removed", "removed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("d"), "text").join(spans, ["doc_id", "d"], "left")
    return keyed.select("doc_id", "text", "spans").mapInArrow(tidy(cut), f"doc_id {kind}, text string, n_removed int, removed string")


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SUBSTRING_SQL = rf"""
WITH every AS (
  SELECT doc_id, i, s, (sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) - length(s))::BIGINT AS start,
    lower(trim(regexp_replace(s, '[ \t\n]+', ' ', 'g'), ' ')) AS norm FROM (
    SELECT doc_id, unnest(xs) AS s, unnest(range(len(xs))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]*[.!?]*[ \t]*\n?') AS xs FROM documents))
  WHERE s <> ''),
sents AS (
  SELECT doc_id, start, start + length(s) AS stop, norm, row_number() OVER w AS k, sum(len(string_split(norm, ' '))) OVER w AS total, len(string_split(norm, ' ')) AS c
  FROM every WHERE norm <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
runs AS (
  SELECT a.doc_id, a.k AS i, b.k AS j FROM sents a ASOF JOIN sents b ON a.doc_id = b.doc_id AND a.total - a.c + {MIN_WORDS} <= b.total
  UNION SELECT b.doc_id, a.k, b.k FROM sents b ASOF JOIN sents a ON a.doc_id = b.doc_id AND b.total - {MIN_WORDS} >= a.total - a.c),
units AS (
  SELECT r.doc_id, min(s.start) AS start, max(s.stop) AS stop, string_agg(s.norm, chr(10) ORDER BY s.k) AS body
  FROM runs r JOIN sents s ON s.doc_id = r.doc_id AND s.k BETWEEN r.i AND r.j GROUP BY r.doc_id, r.i, r.j),
later AS (SELECT doc_id, start, stop FROM units QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, start) > 1),
marked AS (
  SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM later),
merged AS (
  SELECT doc_id, min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM marked) GROUP BY doc_id, g),
gone AS (SELECT DISTINCT s.doc_id, s.i FROM every s JOIN merged m ON m.doc_id = s.doc_id AND s.start >= m.start AND s.start < m.stop),
kept AS (SELECT doc_id, string_agg(s, '' ORDER BY i) AS text FROM every ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, CASE WHEN m.n IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text, coalesce(m.n, 0)::INTEGER AS n_removed, coalesce(m.removed, '') AS removed
FROM documents d LEFT JOIN kept k USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(start || '-' || stop, ',' ORDER BY start) AS removed FROM merged GROUP BY 1) m USING (doc_id)
"""
