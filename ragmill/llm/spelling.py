"""Spelling variants by a variable-length gram index: near words share the grams that an edit leaves as they are."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.llm.common import materialize, tidy

MIN_CHARS = 6
MIN_COUNT = 5
RATIO = 5
DELETE_EVERY = 199
#: Lengths of grams; a shorter one is extended where it is in more than SHARE of all words.
SHORT, LONG = 2, 3
SHARE = 0.001
#: Bound of the gram dictionary that is broadcast. Results do not depend on which grams it holds.
MAX_GRAMS = 100_000
PIECE = 1 << 20
HELD = 300_000
#: Longer words go through the index by their digests.
NAME_CHARS = 64
#: Runs that can become words; shorter ones can't, so they are passed over.
RUN = re.compile("[a-zÀ-ÿ]{%d,}" % MIN_CHARS)
NOT_RUN = re.compile("[^A-Za-zÀ-ÿ]")
_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def count_runs(prefix: str, text: str | None, counts: Counter) -> None:
    """Adds the words of one text to ``counts``: runs lower-cased in A-Z, one code point less where the CRC-32 of prefix and run asks for it.

    Long texts are read in pieces that end beside a run, so a text's list of runs is never held as a whole.
    """
    begin, crc, text = 0, zlib.crc32(prefix.encode()), text or ""
    found: Counter = Counter()
    while begin < len(text):
        stop = NOT_RUN.search(text, begin + PIECE) if begin + PIECE < len(text) else None
        end = stop.start() if stop else len(text)
        found.update(RUN.findall(text[begin:end].encode().lower().decode()))
        begin = end
    for run, n in found.items():
        h = zlib.crc32(run.encode(), crc)
        if h % DELETE_EVERY == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1 :]
        if len(run) >= MIN_CHARS:
            counts[run] += n


class Grams:
    """A word's variable-length grams under a set of frequent grams.

    From each place the gram is SHORT code points long and grows by one while it is frequent, up to LONG or the word's end;
    it is taken unless an earlier one reaches as far. ``starts`` and ``ends`` are those of the grams taken, both ascending.
    """

    def __init__(self, word: str, frequent: frozenset[str], short: int = SHORT, long: int = LONG):
        self.word, self.long = word, long
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.open = False  # the last gram would grow if the word went on
        reach, size = 0, len(word)
        for p in range(size - short + 1):
            e = p + short
            while e - p < long and word[p:e] in frequent:
                if e == size:
                    self.open = self.open or e > reach
                    break
                e += 1
            if e > reach:
                self.starts.append(p)
                self.ends.append(e)
                reach = e
        self.head, self.tail = [0], [0]
        for c in word:
            self.head.append((self.head[-1] * _BASE + ord(c) + 1) % _PRIME)
        for c in reversed(word):
            self.tail.append((self.tail[-1] * _BASE + ord(c) + 1) % _PRIME)

    def _key(self, e: int, tail: int, size: int) -> int:
        """Name of the words of ``size`` code points that begin with the first e and end with the last ``tail`` ones of this word."""
        x = ((self.head[e] * 31 + e) * 0x9E3779B97F4A7C15 ^ (self.tail[tail] * 31 + tail) * 0xC2B2AE3D27D4EB4F ^ size * 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF
        x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 32)) - (1 << 63)

    def listed(self) -> set[int]:
        """The lists this word is in: each gram end with each gram start that may come next to it beyond one edit.

        That is less than twice LONG away: up to LONG - 1 code points before the edit and LONG behind it may be in affected grams.
        """
        n, out = len(self.word), set()
        begins = [*self.starts, n]
        for e in (0, *self.ends):
            for b in begins:
                if e < b < e + 2 * self.long:
                    out.add(self._key(e, n - b, n))
        return out

    def merged(self) -> set[int]:
        """The lists that hold every word of this length or one more within one edit of this word.

        For each place of an edit: the grams it may affect are those that overlap it, and to its right those that a gram
        which overlaps it could come to cover (it reaches ``long`` code points at most). The others are grams of the other
        word too, at the same distance from its begin or end; the nearest of them on both sides name the two lists to merge.
        """
        n, out = len(self.word), set()
        left = right = 0
        for i in range(n + 1):
            while left < len(self.ends) and self.ends[left] <= i:
                left += 1
            e = self.ends[left - 1] if left else 0
            if i < n:  # another code point at i
                r = right
                while r < len(self.starts) and (self.starts[r] <= i or self.ends[r] <= i + self.long):
                    r += 1
                out.add(self._key(e, n - self.starts[r] if r < len(self.starts) else 0, n))
            while right < len(self.starts) and (self.starts[right] < i or self.ends[right] + 1 <= i + self.long):
                right += 1
            if i == n and self.open and left:  # one more code point at the end lets the last gram grow
                e = self.ends[left - 2] if left > 1 else 0
            out.add(self._key(e, n - self.starts[right] if right < len(self.starts) else 0, n + 1))
        return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of at least MIN_CHARS code points in ``docs``, counted in tasks before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for prefix, text in zip(b.column(0), b.column(1)):
                count_runs(prefix.as_py(), text.as_py(), counts)
                if len(counts) > HELD:
                    yield pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())})
                    counts.clear()
        if counts:
            yield pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())})

    prefix = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))
    found = docs.where("text is not null").select(prefix.alias("prefix"), "text").mapInArrow(tidy(run), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def gram_dictionary(words: DataFrame, share: float = SHARE) -> frozenset[str]:
    """The grams of SHORT to LONG - 1 code points that are in more than ``share`` of all words.

    They are few: a word has as many grams as code points, so at most (mean word length / share) of one length can be that
    frequent; MAX_GRAMS, the most frequent, holds even for words of any length.
    """
    total = words.count()
    sizes = ", ".join(f"transform(sequence(1, greatest(length(word) - {q - 1}, 1)), i -> substring(word, i, {q}))" for q in range(SHORT, LONG))
    grams = words.select(F.explode(F.array_distinct(F.expr(f"concat({sizes})"))).alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("c")).where(F.col("c") > share * total).orderBy(F.desc("c"), "gram").limit(MAX_GRAMS)
    return frozenset(r.gram for r in often.collect())


def near_words(words: DataFrame, share: float = SHARE) -> DataFrame:
    """(word, n, other, m): all ordered pairs of ``words(word, n)`` that differ by one inserted, deleted or replaced code point.

    The index lists words under pairs of grams (see ``Grams.listed``); each word merges the lists that its own affected-gram
    bound leaves (see ``Grams.merged``), for words as long as itself or longer by one. Members are verified by edit distance.
    Any gram dictionary gives the same pairs. A list's members share begin and end but for a few code points. Words of more
    than NAME_CHARS go by a digest until they are verified, so that a word is not written once for each of its lists.
    """
    shared = words.sparkSession.sparkContext.broadcast(gram_dictionary(words, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: tuple[list, list, list, list] = ([], [], [], [])

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.bool_()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.int64())], names=["key", "asks", "word", "n"])
            for column in rows:
                column.clear()
            return out

        for b in batches:
            for word, n, name in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                grams = Grams(word.as_py(), shared.value)
                for asks, keys in ((False, grams.listed()), (True, grams.merged())):
                    rows[0].extend(keys)
                    for column, value in zip(rows[1:], (asks, name, n)):
                        column.extend([value] * len(keys))
                if len(rows[0]) > 1 << 16:
                    yield flush()
        if rows[0]:
            yield flush()

    long, digest = F.length("word") > NAME_CHARS, F.concat(F.lit("#"), F.sha2("word", 256))
    named = words.select("word", "n", F.when(long, digest).otherwise(F.col("word")).alias("name"))
    keys = materialize(named.mapInArrow(tidy(run), "key long, asks boolean, name string, n long"), "gramlists")
    asking = keys.where("asks").select("key", F.struct("name", "n").alias("a"))
    listed = keys.where("not asks").select("key", F.struct("name", "n").alias("b"))
    x, y = F.col("a.name"), F.col("b.name")
    near = F.when(x.startswith("#") | y.startswith("#"), x != y).otherwise(((F.length(x) < F.length(y)) | (x < y)) & (F.levenshtein(x, y, 1) == 1))
    found = materialize(asking.join(listed, "key").where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near")
    told = named.where(long)
    for side in "ab":
        of = told.select(F.col("name").alias(f"{side}_name"), F.col("word").alias(f"{side}_long"))
        found = found.withColumn(f"{side}_name", F.col(side)["name"]).join(of, f"{side}_name", "left").withColumn(f"{side}_word", F.coalesce(f"{side}_long", f"{side}_name"))
    is_long = F.col("a_long").isNotNull() | F.col("b_long").isNotNull()
    found = found.where(~is_long | (F.levenshtein("a_word", "b_word", 1) == 1))
    both = (found.select(F.col(f"{x}_word").alias("word"), F.col(x)["n"].alias("n"), F.col(f"{y}_word").alias("other"), F.col(y)["n"].alias("m")) for x, y in ("ab", "ba"))
    return next(both).unionByName(next(both))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each row of forms(word, form), root the last form reached; a form's n is RATIO times larger at each step, so no step leads back.

    The way is doubled in each round, so a few rounds do; one row of each tells the driver whether another is needed.
    """
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not now.join(on, "root", "left_semi").head(1):
            return now
        now = materialize(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def spelling_groups(docs: DataFrame, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of ``docs`` with ``min_count`` occurrences or more.

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z only, of whole texts; where 199 divides
    the CRC-32 of ``<doc_id>:<run>`` one code point is deleted. A word's form is its near word (one edit) of largest n, the
    smallest of ties, if that n is ``ratio`` times its own at least; root follows forms to the last. Null and empty texts give
    no words; a null doc_id counts as an empty one; repeated rows count again; an empty table gives no row; extra columns are
    ignored, of whatever name. Words of any length are compared.
    """
    words = materialize(word_counts(docs).where(F.col("n") >= min_count), "words")
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("other")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("_n"), best.alias("b"))
    good = -F.col("b.m") >= ratio * F.col("_n")
    near = materialize(near.select("word", "n_near", F.when(good, F.col("b.other")).alias("form"), F.when(good, -F.col("b.m")).alias("form_n")), "forms")
    roots = _roots(near.where("form is not null"))
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    from ragmill.llm.langid import CRC_TABLE
    from ragmill.llm.sharding import crc32_sql

    return f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {CRC_TABLE} AS tab),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents WHERE text IS NOT NULL),
hashed AS MATERIALIZED (
  SELECT run, k, ({crc32_sql("doc_id::VARCHAR || ':' || run")})::BIGINT AS h
  FROM (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= {MIN_CHARS} GROUP BY ALL), crc),
spelt AS (SELECT CASE WHEN h % {DELETE_EVERY} = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM spelt WHERE length(word) >= {MIN_CHARS} GROUP BY 1 HAVING sum(k) >= {MIN_COUNT}),
less AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON w.word = l.rest
  UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON w.word = l.rest),
best AS (SELECT word, count(*) AS n_near, first(struct_pack(other := other, m := m) ORDER BY m DESC, other) AS b FROM near GROUP BY 1),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN b.m >= {RATIO} * w.n THEN b.other END AS form, CASE WHEN b.m >= {RATIO} * w.n THEN b.m END AS form_n
  FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS reached, form FROM formed UNION ALL SELECT k.word, f.word, f.form FROM walk k JOIN formed f ON f.word = k.form)
SELECT f.word, f.form, k.reached AS root, f.n, f.n_near, f.form_n FROM formed f JOIN walk k ON k.word = f.word AND k.form IS NULL
"""


SPELLING_SQL = _sql()
