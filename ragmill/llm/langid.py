"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragmill.llm.common import tidy

TOP = 300
PAD = 1
MAX_LANGUAGES = 2_000
STARTS = 250_000
HELD = 400_000


@cache
def _letters() -> np.ndarray:
    """Code point of each letter, PAD for all else."""
    return np.array([i if unicodedata.category(chr(i))[0] == "L" else PAD for i in range(0x110000)], np.uint32)


def _fold(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums counts of equal grams over several (grams, counts)."""
    if len(parts) == 1:
        return parts[0]
    grams, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(grams)).astype(np.int64)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of 1 to 3 characters with their counts, for one lower-cased text.

    Words are runs of letters; 2- and 3-grams may begin or end with a pad that stands for a word's border, none crosses it.
    A gram is one number of 21 bits a character, so that numeric order is by length, then by code points. Grams are made for
    STARTS places at a time, so a long text needs little more memory than itself.
    """
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not text:
        return none
    c = _letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)]
    c = c[np.r_[True, (c[1:] != PAD) | (c[:-1] != PAD)]]
    if len(c) < 2:
        return none
    shift, parts = np.uint64(21), []
    for at in range(0, len(c), STARTS):
        x = c[at : at + STARTS + 2].astype(np.uint64)
        n = min(STARTS, len(c) - at)  # grams that begin in this slice
        two = (x[:-1] << shift) | x[1:]
        three = ((two[:-1] << shift) | x[2:])[:n][x[1:-1][:n] != PAD]
        parts.append(np.unique(np.concatenate([x[:n][x[:n] != PAD], two[:n], three]), return_counts=True))
    return _fold(parts)


def top_ranked(grams: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The ``top`` most frequent grams, most frequent first, ties in gram order."""
    return grams[np.argsort(-counts, kind="stable")[:top]]


def profiles(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, gram long, place int from 0): each language's ``top`` most frequent n-grams over all rows with a lang."""

    def rows(by: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang, parts in by.items():
            grams, n = _fold(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, list] = {}  # sums so far and texts not yet added to them, HELD grams in all
        held = 0
        for b in batches:
            for lang, text in zip(b.column(0), b.column(1)):
                found = ngrams(text.as_py())
                by.setdefault(lang.as_py(), []).append(found)
                held += len(found[0])
                if held > HELD:
                    by = {k: [_fold(parts)] for k, parts in by.items()}
                    held = sum(len(p[0][0]) for p in by.values())
                    if held > HELD // 2:  # else each text would fold again
                        yield from rows(by)
                        by, held = {}, 0
        yield from rows(by)

    counts = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string"), "text").mapInArrow(tidy(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("place", place - 1).where(F.col("place") < top).select("lang", "gram", "place")


class RankOrder:
    """Learned profiles as one sorted gram list and a table of places, ``top`` where a language lacks the gram."""

    def __init__(self, rows: list[tuple[str, int, int]], top: int = TOP):
        self.top, self.langs = top, sorted({r[0] for r in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        self.grams = np.unique(np.array([r[1] for r in rows], np.uint64))
        self.places = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        for lang, gram, place in rows:
            self.places[np.searchsorted(self.grams, np.uint64(gram)), at[lang]] = place

    def predict(self, text: str | None) -> tuple[str, float]:
        grams, counts = ngrams(text)
        if not len(grams) or not self.langs:
            return "und", 0.0
        mine = top_ranked(grams, counts, self.top)
        i = np.searchsorted(self.grams, mine)
        i[(i == len(self.grams)) | (self.grams[np.minimum(i, len(self.grams) - 1)] != mine)] = len(self.grams)
        theirs = self.places[i]
        apart = np.where(theirs < 0, self.top, np.abs(theirs - np.arange(len(mine))[:, None])).sum(axis=0)
        best = int(apart.argmin())
        return self.langs[best], 1.0 - float(apart[best]) / float(len(mine) * self.top)


def _shared(learned: DataFrame, top: int):
    """The profile table as a broadcast: ``top`` rows a language; more than MAX_LANGUAGES languages are refused, so it stays small."""
    rows = [tuple(r) for r in learned.select("lang", "gram", "place").limit(MAX_LANGUAGES * top + 1).collect()]
    if len(rows) > MAX_LANGUAGES * top:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return learned.sparkSession.sparkContext.broadcast(rows)


def predict(docs: DataFrame, learned: DataFrame, top: int = TOP) -> DataFrame:
    """doc_id, lang_pred, score for each row of ``docs``.

    The distance of a text to a language is the sum over its ``top`` most frequent n-grams of |own place - profile's place|,
    or ``top`` where the profile lacks the gram; the nearest language wins, ties go to the first by name; score is 1 minus
    distance over the largest possible. Null texts and texts without a letter give ``und`` and 0, as does an empty profile
    table.
    """
    shared = _shared(learned, top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = RankOrder(shared.value, top)
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, learned: DataFrame, min_score: float, top: int = TOP) -> DataFrame:
    """The rows of ``docs`` whose text is predicted (see ``predict``) with ``min_score`` or more; columns and repeated rows stay.

    Each row is judged where it lies, without a shuffle, so null and shared doc_ids and extra columns of any name do no harm.
    """
    shared, at = _shared(learned, top), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = RankOrder(shared.value, top)
        for b in batches:
            found = (model.predict(t.as_py()) for t in b.column(at))
            yield b.filter(pa.array([lang != "und" and score >= min_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def held_out() -> F.Column:
    """True for documents that training never sees."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def identify(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Learns profiles from the rows that are not held out and have a lang, then predicts every row. See ``predict``.

    Repeated rows each give a row, an empty table none; a null doc_id counts as not held out for its flag and is never learned from.
    """
    learned = profiles(docs.where(~held_out()), top)
    return predict(docs, learned, top).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: CRC-32 of short texts in DuckDB: the byte table, then a fold over the bytes.
CRC_TABLE = """(SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) FROM range(256) t(i))"""

LANGID_SQL = f"""
WITH crc AS (SELECT {CRC_TABLE} AS tab),
docs AS (
  SELECT d.doc_id, d.lang, d.text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(d.doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: xor(c >> 8, crc.tab[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0 AS held_out,
    regexp_extract_all(lower(coalesce(d.text, '')), '\\p{{L}}+') AS words
  FROM documents d, crc),
spelt AS (SELECT doc_id, lang, held_out, chr(1) || word || chr(1) AS s, count(*) AS n FROM (SELECT doc_id, lang, held_out, unnest(words) AS word FROM docs) GROUP BY ALL),
grams AS (
  SELECT doc_id, lang, held_out, gram, sum(n) AS n FROM (
    SELECT doc_id, lang, held_out, n, unnest(list_transform(range(1, length(s) + 1 - k), lambda i: substr(s, i::INTEGER, k::INTEGER + 1))) AS gram
    FROM spelt, range(0, 3) g(k))
  WHERE gram <> chr(1) GROUP BY ALL),
prof AS (
  SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(gram), gram) - 1 AS place FROM (
    SELECT lang, gram, sum(n) AS n FROM grams WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL)
  QUALIFY place < {TOP}),
mine AS (
  SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(gram), gram) - 1 AS place
  FROM grams QUALIFY place < {TOP}),
apart AS (
  SELECT m.doc_id, l.lang, count(*) AS m, sum(CASE WHEN p.place IS NULL THEN {TOP} ELSE abs(m.place - p.place) END) AS d
  FROM mine m CROSS JOIN (SELECT DISTINCT lang FROM prof) l LEFT JOIN prof p ON p.lang = l.lang AND p.gram = m.gram GROUP BY ALL),
best AS (
  SELECT doc_id, lang, 1.0::DOUBLE - d::DOUBLE / (m * {TOP})::DOUBLE AS score FROM apart
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d, lang) = 1)
SELECT d.doc_id, d.held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(b.score, 0.0::DOUBLE) AS score FROM docs d LEFT JOIN best b USING (doc_id)
"""
