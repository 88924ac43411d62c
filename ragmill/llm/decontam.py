"""Benchmark decontamination: q-gram lemma filter over diagonal bands, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ragmill.llm.common import materialize, tidy

Q = 10
RATE = 0.08
BLOCK_CHARS = 1_000_000
PIECE = 1_000_000
TABLE_BITS = 23
#: Blocks searched in one scan; matches counted at once; rows handled at once; cells aligned at once.
MAX_BLOCKS = 8
MATCHES = 1 << 20
SLICE = 1_000
CELLS = 8_000_000
OUT = np.uint32(0xFFFFFFFF)


@cache
def _fold() -> np.ndarray:
    """Lower-case form of each letter and digit of one code point, 0 for all else."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        ch = chr(i)
        if ch.isalnum():
            low = ch.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def normalise(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters, runs of others as one 0 between them, and each one's place in the text."""
    c = _fold()[np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)]
    at = np.flatnonzero((c != 0) | np.r_[False, c[:-1] != 0])
    if len(at) and c[at[-1]] == 0:
        at = at[:-1]
    return c[at], at


def gram_hashes(c: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of every q-gram, by doubling."""
    if len(c) < q:
        return np.zeros(0, np.uint64)
    mul, turn = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
    join = lambda a, b: (a * mul) ^ (b + (a >> turn))
    by, n = {1: (c.astype(np.uint64) + np.uint64(1)) * mul}, 1
    while n * 2 <= q:
        by[2 * n] = join(by[n][:-n], by[n][n:])
        n *= 2
    out, at = by[n], n
    for step in sorted(by, reverse=True):
        if step < n and (q - at) & step:
            size = len(c) - at - step + 1
            out, at = join(out[:size], by[step][at : at + size]), at + step
    return out


def budget(length: int, q: int = Q, rate: float = RATE, most: int | None = None) -> int:
    """Edits allowed for an item: ``rate`` of its length, at most as many as the q-gram lemma can filter, and ``most`` if given; -1 if it is shorter than q."""
    k = min(int(rate * length), length // q - 1)
    return k if most is None else min(k, most)


def _cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about ``most``; a row is never divided."""
    edges = np.searchsorted(np.cumsum(sizes), np.arange(most, int(sizes.sum()), most), "right")
    edges = np.unique(np.r_[0, edges, len(sizes)]).tolist()
    yield from zip(edges[:-1], edges[1:])


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of all parts, and the sums of their counts."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(at, np.concatenate([n for _, n in parts]), len(key)).astype(np.int64)


class Index:
    """The q-grams of benchmark items, sorted, with their items and positions: 16 bytes a q-gram; items without one by their text."""

    def __init__(self, items: list[tuple[object, str | None]], q: int = Q, rate: float = RATE, most: int | None = None):
        self.q = q
        folded = [(item_id, normalise(text)[0]) for item_id, text in items]
        long = [x for x in folded if len(x[1]) >= q]
        short = [x for x in folded if 0 < len(x[1]) < q]
        self.ids, self.chars = [i for i, _ in [*long, *short]], [c for _, c in long]
        self.short: dict[bytes, list[int]] = {}
        for n, (_, c) in enumerate(short, len(long)):
            self.short.setdefault(c.tobytes(), []).append(n)
        self.sizes = np.array([len(c) for c in self.chars], np.int64)
        self.edits = np.array([budget(n, q, rate, most) for n in self.sizes.tolist()], np.int64)
        every = np.concatenate([np.zeros(0, np.uint64), *(gram_hashes(c, q) for c in self.chars)])
        item = np.repeat(np.arange(len(self.chars), dtype=np.int32), self.sizes - q + 1)
        place = np.concatenate([np.zeros(0, np.int32), *(np.arange(n - q + 1, dtype=np.int32) for n in self.sizes.tolist())])
        order = np.argsort(every, kind="stable")
        self.grams, item, place = every[order], item[order], place[order].astype(np.int64)
        new = np.r_[True, (self.grams[1:] != self.grams[:-1]) | (item[1:] != item[:-1])][: len(item)]
        # a run: the places of one gram in one item, in order
        start = np.flatnonzero(new)
        self.run_gram, self.run_item = self.grams[start], item[start].astype(np.int64)
        self.run_low, self.run_high = place[start], place[np.r_[start[1:], len(place)] - 1] if len(place) else place
        self.at = ((np.cumsum(new) - 1) << 32) + place
        self.seen = np.zeros(1 << TABLE_BITS, bool)
        self.seen[(self.grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def width(self, item: int) -> int:
        """Diagonals that an alignment of the item looks at."""
        return int(4 * self.edits[item] + 2)

    def bands(self, c: np.ndarray) -> np.ndarray:
        """(item, first diagonal) of each band that holds as many q-grams as an occurrence within the budget must.

        An occurrence with at most k edits keeps length + 1 - (k + 1) q grams, on diagonals no more than k apart. Bands are
        2 (k + 1) diagonals wide and begin every k + 1, so one of two neighbours holds them all.
        """
        h = gram_hashes(c, self.q)
        p = np.flatnonzero(self.seen[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        if not len(p) or not len(self.grams):
            return np.zeros((0, 2), np.int64)
        first = np.searchsorted(self.run_gram, h[p])
        n = np.searchsorted(self.run_gram, h[p], "right") - first
        found = [self._counted(p[s:e], first[s:e], n[s:e]) for s, e in _cuts(n, MATCHES)]
        key, n = _added([x for part in found for x in part])
        item = key >> 40
        key, item = key[enough := n >= self.sizes[item] + 1 - (self.edits[item] + 1) * self.q], item[enough]
        return np.stack([item, ((key & ((1 << 40) - 1)) - (1 << 39)) * (self.edits[item] + 1)], axis=1)

    def _counted(self, p: np.ndarray, first: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(band key, q-grams) of text places ``p`` whose grams have ``n`` runs from ``first``.

        Of a gram that an item has many times the places are not matched one by one: those on a band's diagonals are a range
        of the run, whose size is read off. So a place costs the bands of an item, not its length, however repetitive both are.
        """
        run = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p, item = np.repeat(p, n), self.run_item[run]
        step = self.edits[item] + 1
        b = np.floor_divide(p - self.run_high[run], step)
        many = np.floor_divide(p - self.run_low[run], step) - b + 1
        out = []
        for s, e in _cuts(many, MATCHES):
            m = many[s:e]
            again = lambda x: np.repeat(x[s:e], m)  # noqa: E731, B023
            band = again(b) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            high = again(p) - band * again(step)
            base = again(run) << 32
            held = np.searchsorted(self.at, base + high, "right") - np.searchsorted(self.at, base + np.maximum(high - again(step) + 1, 0))
            of = (again(item) << 40) + (1 << 39) + band
            out.append(_added([(of, held), (of - 1, held)]))
        return out

    def align(self, cases: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int, int]]:
        """For (item, first diagonal, text): least edits of the whole item against any part of the text on the band's diagonals
        widened by the budget on both sides, and that part's begin and end. Cases are aligned side by side."""
        if not cases:
            return []
        items = np.array([x[0] for x in cases])
        k, m = self.edits[items], self.sizes[items]
        width = int((4 * k + 2).max())
        longest = int(m.max())
        low = np.array([x[1] for x in cases]) - k
        text = np.full((len(cases), longest + width), OUT, np.uint32)
        want = np.zeros((len(cases), longest), np.uint32)
        for r, (item, _, c) in enumerate(cases):
            want[r, : m[r]] = self.chars[item]
            a, b = max(0, low[r]), min(len(c), low[r] + longest + width)
            if b > a:
                text[r, a - low[r] : b - low[r]] = c[a:b]
        one = 1 << 20
        d = np.arange(width, dtype=np.int64)
        best, result = np.tile(d, (len(cases), 1)), [None] * len(cases)
        ends: dict[int, list[int]] = {}
        for r, size in enumerate(m.tolist()):
            ends.setdefault(size, []).append(r)
        for j in range(longest):
            new = best + np.where(text[:, j : j + width] == want[:, j : j + 1], 0, one)
            np.minimum(new[:, :-1], best[:, 1:] + one, out=new[:, :-1])
            best = np.minimum.accumulate(new - d * one, axis=1) + d * one
            for r in ends.get(j + 1, ()):
                at = int(best[r].argmin())
                value = int(best[r, at])
                result[r] = (value // one, int(low[r]) + value % one, int(low[r]) + at + j + 1)
        return result

    def search(self, c: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, int]]:
        """Cases for ``align`` with the offset of their text; long texts go in overlapping pieces."""
        if not len(self.chars):
            return
        over = int((self.sizes + 4 * self.edits).max()) + 4
        for at in range(0, max(len(c), 1), PIECE):
            part = c[max(0, at - over) : at + PIECE]
            for item, low in self.bands(part).tolist():
                yield item, low, part, max(0, at - over)


def _query_sets(benchmark: DataFrame) -> Iterator[list]:
    """The benchmark's texts as broadcasts of about BLOCK_CHARS characters, MAX_BLOCKS of them (8 M characters) at a time.

    The corpus is scanned once for each such set. A block's size is known before the driver reads it, and a set is only made
    when the one before has been used, so the driver holds one set of any benchmark.
    """
    rows = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    for s in range(0, n, MAX_BLOCKS):
        yield [benchmark.sparkSession.sparkContext.broadcast([tuple(r) for r in rows.where(block == b).collect()]) for b in range(s, min(s + MAX_BLOCKS, n))]


def _each_set(benchmark: DataFrame, use) -> None:
    """Calls ``use(shared, written)`` for each query set; all results but the last are to be written, then their broadcasts go."""
    before = None
    for shared in _query_sets(benchmark):
        if before:
            use(before, True)
            for s in before:
                s.destroy()
        before = shared
    if before:
        use(before, False)


def _search(column: pa.Array, index: Index) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(row, item) -> (edits, start, stop) of all items held by the texts of a column; aligned in groups of bounded size."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    cases, widest = [], 0

    def flush() -> None:
        for (row, item, _, _, at, offset), (edits, a, b) in zip(cases, index.align([x[1:4] for x in cases])):
            if edits <= index.edits[item]:
                a, b = max(0, a + offset), min(len(at), b + offset)
                found = (edits, int(at[a]), int(at[b - 1]) + 1)
                best[row, item] = min(best.get((row, item), found), found)

    for row, text in enumerate(column):
        c, at = normalise(text.as_py())
        if 0 < len(c) < index.q:
            best |= {(row, item): (0, int(at[0]), int(at[-1]) + 1) for item in index.short.get(c.tobytes(), ())}
        for item, low, part, offset in index.search(c):
            size = int(index.sizes[item]) + index.width(item)
            if (len(cases) + 1) * max(widest, size) > CELLS or len(cases) >= 256:
                flush()
                cases, widest = [], 0
            cases.append((row, item, low, part, at, offset))
            widest = max(widest, size)
    flush()
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, max_edits: int | None = None) -> DataFrame:
    """(doc_id, item_id, edits, start, stop): each document with each benchmark item it holds within the edit budget.

    Texts and items are compared as lower-case letters and digits with one space for all between. A document holds an item if
    some part of its text is within min(rate x length, length / q - 1) edits of the whole item (or ``max_edits``, if that is
    given and less: alignment costs an item's length times its budget); for each pair the part with
    the fewest edits is returned, the first such, in characters of the original text. Items of fewer than q folded characters
    have no q-gram; a document holds one only if its whole folded text equals it. The benchmark is a query set held against
    all rows: blocks of bounded size are broadcast, and each MAX_BLOCKS of them are one index for one scan of the documents.

    Null and empty texts or items match nothing; repeated rows and items each give their rows; an empty table on either side
    gives none; extra columns are ignored; item_id may have any type that Arrow carries.
    """
    spark = docs.sparkSession
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, edits int, start int, stop int"
    item_arrow = to_arrow_type(benchmark.schema["item_id"].dataType)

    def run_with(shared: list):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index([x for s in shared for x in s.value], q, rate, max_edits)
            for big in batches:
                for at in range(0, big.num_rows, SLICE):
                    b = big.slice(at, SLICE)
                    best = _search(b.column(1), index)
                    cols = list(zip(*best.values())) or [[]] * 3
                    ids = [b.column(0).take(pa.array([r for r, _ in best], pa.int64())), pa.array([index.ids[i] for _, i in best], item_arrow)]
                    yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c, pa.int32()) for c in cols)], names=["doc_id", "item_id", "edits", "start", "stop"])

        return tidy(run)

    parts: list[DataFrame] = []

    def use(shared: list, written: bool) -> None:
        found = docs.select("doc_id", "text").mapInArrow(run_with(shared), schema)
        parts.append(materialize(found, "contaminated") if written else found)

    _each_set(benchmark, use)
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, max_edits: int | None = None) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item (see ``contaminated``). All columns stay, of whatever name.

    Each row is judged where it lies, without a shuffle: rows with null or shared doc_ids are judged by their own texts.
    """
    column, kept = docs.columns.index("text"), [docs]

    def run_with(shared: list):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index([x for s in shared for x in s.value], q, rate, max_edits)
            for big in batches:
                for at in range(0, big.num_rows, SLICE):
                    b = big.slice(at, SLICE)
                    hit = np.ones(b.num_rows, bool)
                    hit[[r for r, _ in _search(b.column(column), index)]] = False
                    yield b.filter(pa.array(hit))

        return tidy(run)

    def use(shared: list, written: bool) -> None:
        left = kept[-1].mapInArrow(run_with(shared), docs.schema)
        kept.append(materialize(left, "clean") if written else left)

    _each_set(benchmark, use)
    return kept[-1]


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
