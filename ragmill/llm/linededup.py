"""Line dedup by winnowing over line hashes; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.llm.common import materialize

WINDOW = 3
WORDS = 50


def _lines(text) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, d, n, h1, h2, c): a digest of each text, its number of lines, and two hashes and the word count of each line.

    A line is compared lower-cased and without blanks at its ends; its words are what blanks part.
    """
    lines = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("d"), F.transform(_lines("text"), lambda x: F.lower(F.trim(x))).alias("x"))
    words = F.transform("x", lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1)
    return lines.select("doc_id", "d", F.size("x").alias("n"), F.transform("x", lambda x: F.xxhash64(x)).alias("h1"), F.transform("x", lambda x: F.xxhash64(F.lit(1), x)).alias("h2"), words.alias("c"))


def fingerprints(hashed: DataFrame, window: int = WINDOW, words: int = WORDS) -> DataFrame:
    """(doc_id, d, start, size, h, pos, k1, k2): the smallest runs that may count as repeats, each with its selected minimum.

    A run of lines counts from ``window`` lines or ``words`` words on. Of those of up to ``window`` lines only such are kept
    as shorter ones do not cover: a run of ``size`` lines is left out where both runs of one line less in it count by their
    words. A text that does not count as a whole is one run. ``h`` is the smallest line hash of the run and ``pos`` its place,
    the last of equal ones: equal runs select equal hashes at the same place of the run. k1, k2 digest the run's lines.
    """
    def counts(start: str, size: int) -> str:
        return f"aggregate(slice(c, {start} + 1, {size}), 0, (a, x) -> a + x) >= {words}"

    spans = []
    for size in range(1, window + 1):
        rules = [counts("s", size) if size < window else "true"]
        if size > 1:
            rules.append(f"not ({counts('s', size - 1)} and {counts('s + 1', size - 1)})")
        keep = " and ".join(rules)
        if size < window:
            keep = f"{keep} or (n = {size} and not {counts('s', size)})"
        spans.append(f"transform(filter(sequence(0, greatest(n - {size}, 0)), s -> n >= {size} and ({keep})), s -> struct(s as start, {size} as size))")
    runs = F.explode(F.expr(f"concat({', '.join(spans)})")).alias("r")
    spread = hashed.select("doc_id", "d", "h1", "h2", runs).select("doc_id", "d", F.slice("h1", F.col("r.start") + 1, F.col("r.size")).alias("a"), F.slice("h2", F.col("r.start") + 1, F.col("r.size")).alias("b"), "r.start", "r.size")
    last = F.size("a") - F.array_position(F.reverse("a"), F.array_min("a")).cast("int")
    return spread.select("doc_id", "d", "start", "size", F.array_min("a").alias("h"), (F.col("start") + last).alias("pos"), F.xxhash64("a").alias("k1"), F.xxhash64("b").alias("k2"))


def repeated_runs(docs: DataFrame, window: int = WINDOW, words: int = WORDS) -> DataFrame:
    """(doc_id, d, start, size) of the runs whose lines occur at an earlier (doc_id, d, start).

    Winnowing: each run selects its smallest line hash. Selected positions are joined by hash: those whose hash is selected
    nowhere else drop out, before any lines are compared. Around a position that is left the match is extended to both sides
    over its runs, by their digests: a run goes if an earlier position with the same hash has the same lines around it. All
    earlier positions count, not the first one alone, whose neighbours may differ; digests are grouped, so no pairs are made.
    Both tables of keys are small and written first, so adaptive execution may split the joins at a very common line.
    """
    runs = materialize(fingerprints(materialize(line_hashes(docs), "lines"), window, words), "runs")
    place = F.struct("doc_id", "d", "pos")
    selected = runs.groupBy("h").agg(F.min(place).alias("p"), F.max(place).alias("q")).where("p <> q").select("h")
    joined = materialize(runs.join(materialize(selected, "selected"), "h", "left_semi").drop("h", "pos"), "joined")
    at = F.struct("doc_id", "d", "start")
    first = joined.groupBy("k1", "k2").agg(F.min(at).alias("f"), F.max(at).alias("l")).where("f <> l").select("k1", "k2", "f")
    return joined.join(materialize(first, "first"), ["k1", "k2"]).where(at != F.col("f")).select("doc_id", "d", "start", "size")


def drop_repeated_runs(docs: DataFrame, window: int = WINDOW, words: int = WORDS, counts: tuple[str, str] = ("n_lines", "n_deleted")) -> DataFrame:
    """``docs`` with later repeated runs of lines deleted from ``text``; adds two counts of lines, in place of columns of their names.

    A line goes exactly if it lies in a run of ``window`` lines or ``words`` words, or more, that also occurs at an earlier
    (doc_id, text digest, line); of a text that is shorter than both, all lines go if an earlier text is the same. Overlapping
    repeats count: of one line repeated throughout, the first stays. All rows and other columns stay, of whatever name. Rows
    of one doc_id with unlike texts are documents of their own; equal ones count as one and stay alike. Null texts stay null
    with 0 lines, an empty text has one empty line; rows with null doc_id stay as they are; an empty table gives none.
    """
    d, mask, pos = (f"_{x}_9f3c" for x in ("d", "mask", "pos"))
    found = repeated_runs(docs, window, words).groupBy("doc_id", F.col("d").alias(d)).agg(F.collect_set(F.struct("start", "size")).alias(pos))
    found = found.withColumn(pos, F.array_sort(F.array_distinct(F.flatten(F.transform(pos, lambda r: F.sequence(r["start"], r["start"] + r["size"] - 1))))))
    before = F.concat(F.array(F.lit(-1)), F.col(pos))
    pieces = F.zip_with(pos, before, lambda p, b: F.when(p.isNotNull(), F.concat(F.repeat(F.lit("k"), p - b - 1), F.lit("d"))))
    gone = materialize(found.select("doc_id", d, F.array_join(pieces, "").alias(mask)), "gone")
    # a written table of masks may be far larger in memory than on disk: never broadcast by its file size
    n_lines, n_deleted = counts
    out = docs.drop(*counts).withColumn(d, F.xxhash64("text")).join(gone.hint("merge"), ["doc_id", d], "left")
    whole = F.rpad(F.col(mask), F.col(n_lines), F.lit("k"))
    kept = F.array_join(F.zip_with(_lines("text"), F.split(whole, ""), lambda x, m: F.when(m == "k", x)), "\n")
    deleted = F.coalesce(F.length(mask) - F.length(F.replace(mask, F.lit("d"))), F.lit(0))
    out = out.withColumn(n_lines, F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines("text")))).withColumn(n_deleted, deleted)
    return out.withColumn("text", F.when(F.col(mask).isNotNull() & F.col("text").isNotNull(), kept).otherwise(F.col("text"))).select(*(c for c in docs.columns if c not in counts), *counts)


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_runs(docs).select("doc_id", "text", "n_lines", "n_deleted")


def line_dedup_sql(source: str = "documents", window: int = WINDOW, words: int = WORDS) -> str:
    """CTEs up to ``deduped(doc_id, text, n_lines, n_deleted)``."""
    return f"""
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos,
    len(string_split(text, chr(10))) AS n FROM {source} WHERE text IS NOT NULL),
counted AS (SELECT *, lower(trim(line, ' ')) AS x, length(lower(trim(line, ' '))) - length(replace(lower(trim(line, ' ')), ' ', '')) + 1 AS c FROM lines),
runs AS (
  SELECT doc_id, pos, n, size, string_agg(x, chr(10)) OVER w AS body, sum(c) OVER w AS total FROM (SELECT *, unnest(range(1, {window} + 1)) AS size FROM counted)
  WINDOW w AS (PARTITION BY doc_id, size ORDER BY pos ROWS BETWEEN CURRENT ROW AND size - 1 FOLLOWING)),
later AS (
  SELECT doc_id, pos, size FROM runs WHERE pos + size <= n AND (size = {window} OR total >= {words} OR size = n)
  QUALIFY row_number() OVER (PARTITION BY size, body, CASE WHEN size < {window} AND total < {words} THEN 1 ELSE 0 END ORDER BY doc_id, pos) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS pos FROM later),
deduped AS (
  SELECT d.doc_id, coalesce(k.text, CASE WHEN d.text IS NULL THEN NULL ELSE '' END) AS text,
    CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::INTEGER AS n_lines, coalesce(g.n, 0)::INTEGER AS n_deleted
  FROM {source} d
  LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM lines ANTI JOIN gone USING (doc_id, pos) GROUP BY 1) k USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g USING (doc_id))"""


LINEDEDUP_SQL = f"WITH {line_dedup_sql()} SELECT doc_id, text, n_lines, n_deleted FROM deduped"
