"""Near-duplicates by exact Jaccard similarity of word shingles; candidates by SimHash, the rest by prefix filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.llm.common import materialize, star_components, tidy, whole_groups
from ragmill.llm.simhash import SEED, links, vote

#: Sets of which one in SAMPLE is looked at for common shingles: those in more than COMMON of them, MOST of them at most.
SAMPLE, COMMON, MOST = 16, 8, 200_000
SLICE = 256
#: Nodes of a key that are compared in one task.
BLOCK = 1024
#: Keys, the smallest ones, that a node carries to know at which key it meets another first.
KEYS = 16
#: Bits a shingle of the parities that stand for a set where many sets are compared.
ROOM = 4


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles of one text; words and short texts as in simhash.fingerprint, none for no words."""
    words = (text or "").encode().lower().split()
    take = min(width, len(words))
    found = {xxhash.xxh64_intdigest(b" ".join(words[i : i + take]), SEED) for i in range(len(words) - take + 1)} if words else ()
    return np.sort(np.fromiter(found, np.uint64, len(found))).view(np.int64)


def _late(h: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which of the shingles are common."""
    return common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h if len(common) else np.zeros(len(h), bool)


def _parity(h: np.ndarray, room: int = 1) -> bytes:
    """Parities of the shingles by their low bits: two sets differ in at least as many shingles as their parities in bits.

    There are ``room`` to 2 ``room`` bits a shingle, up to a bound: the more, the less often two differences cancel out.
    """
    bits = max(64, min(room << max(len(h) - 1, 1).bit_length(), max(1 << 15, room << 13)))
    return np.packbits((np.bincount(h & (bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """Bits in which two parities differ, the longer one folded to the shorter."""
    x, y = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _node(h: np.ndarray) -> int:
    """Name of a set: equal sets have equal names, and only they but for 64-bit collisions."""
    x = xxhash.xxh3_64_intdigest(h.tobytes())
    return x - (1 << 64) if x >> 63 else x


def _map(docs: DataFrame, columns: list[str], row, schema: str) -> DataFrame:
    """One output row per row of ``docs``, made by ``row`` from its values; in slices, so long texts need little memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                out = [row(*x) for x in zip(*(c.to_pylist() for c in b.slice(at, SLICE).columns))]
                kinds = kinds or [pa.int64() if isinstance(v, int) else pa.binary() for v in out[0]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(*columns).mapInArrow(tidy(run), schema)


def _spread(sets: DataFrame, array: str, *rest: str) -> DataFrame:
    """(h, *rest): a row for each shingle in the binary column ``array``; the other columns are longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                sizes = [len(x.as_py()) // 8 for x in part.column(0)]
                h = np.frombuffer(b"".join(x.as_py() for x in part.column(0)), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), *(pa.array(np.repeat(c.to_numpy(), sizes)) for c in part.columns[1:])], names=["h", *rest])

    return sets.select(array, *rest).mapInArrow(tidy(run), ", ".join(f"{c} long" for c in ("h", *rest)))


def _common(docs: DataFrame, width: int) -> np.ndarray:
    """Sorted shingles that many sets of a sample have. They only set the order, which may be any: results do not depend on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                sets = [shingle_set(t, width) for t in b.column(0).slice(at, SLICE).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets))], names=["h"])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    many = some.mapInArrow(tidy(run), "h long").groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > COMMON).orderBy(F.desc("c"), "h").limit(MOST)
    return np.sort(np.array([r.h for r in many.select("h").collect()], np.int64))


def shingle_marks(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, d, node, n, fp, parity, wide, prefix) for each row of ``docs``: a digest of its text, name, size, SimHash, parities
    and parities with more room of its set, and the set's first shingles."""
    common = _common(docs, width)

    def row(i: int, d: int, text: str | None) -> tuple:
        h = shingle_set(text, width)
        late = _late(h, common)
        prefix = np.concatenate([h[~late], h[late]])[: len(h) - (4 * len(h) + 4) // 5 + 1]
        return i, d, _node(h), len(h), vote([h], len(h)), _parity(h), _parity(h, ROOM), prefix.tobytes()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _map(docs.select("doc_id", F.xxhash64("text").alias("d"), "text"), ["doc_id", "d", "text"], row, f"doc_id {kind}, d long, node long, n long, fp long, parity binary, wide binary, prefix binary")


def _similar(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """The rows of pairs(a, b) whose sets have a Jaccard similarity of 0.8 or more.

    That is so if they differ in at most a ninth of their added sizes. Parities rule out most others; the rest is counted.
    """

    def run(near):
        def batches_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = [near(*x) for x in zip(*(c.to_pylist() for c in b.columns[2:]))]
                yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return tidy(batches_)

    def both(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
        return 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))

    def sided(frame: DataFrame, by: DataFrame, *columns: str) -> DataFrame:
        for x in "ab":
            frame = frame.join(by.select(F.col("node").alias(x), *(F.col(c).alias(c + x) for c in columns)), x)
        return frame.select("a", "b", *(c + x for c in columns for x in "ab"))

    may = sided(pairs, nodes, "n", "parity").mapInArrow(run(lambda n, m, x, y: 9 * _apart(x, y) <= n + m), "a long, b long")
    may = materialize(may, "may")
    wanted = may.select(F.col("a").alias("node")).unionByName(may.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(nodes.select("node", "rep").join(wanted, "node", "left_semi"), "wanted")

    def row(text: str | None) -> tuple:
        h = shingle_set(text, width)
        return _node(h), h.tobytes()

    texts = docs.join(wanted.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sets = materialize(_map(texts, ["text"], row, "node long, hashes binary").dropDuplicates(["node"]), "sets")
    return materialize(sided(may, sets, "hashes").mapInArrow(run(both), "a long, b long"), "similar")


def _fold(x: np.ndarray, words: int) -> np.ndarray:
    """Parities of one width (rows of 64-bit words), folded to ``words`` words."""
    while x.shape[1] > words:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def _near_pairs(node: np.ndarray, root: np.ndarray, n: np.ndarray, side: np.ndarray, parities: list[bytes]) -> Iterator[tuple[int, list[int]]]:
    """Each row with those of unlike components and unlike sides (all, if there is one side) that their parities let be similar."""
    widths = np.array([len(p) // 8 for p in parities])
    both = side.any() and not side.all()
    for w in np.unique(widths):
        x = np.flatnonzero(widths == w)
        mine = np.frombuffer(b"".join(parities[i] for i in x), np.uint64).reshape(len(x), -1)
        y = np.flatnonzero((widths >= w) & (widths <= 2 * w))  # similar sets are of like sizes
        theirs = np.concatenate([_fold(np.frombuffer(parities[i], np.uint64)[None], w) for i in y])
        for k, i in enumerate(x.tolist()):
            fits = (root[y] != root[i]) & ((widths[y] > w) | (node[y] > node[i])) & (5 * np.minimum(n[y], n[i]) >= 4 * np.maximum(n[y], n[i]))
            if both:
                fits &= side[y] != side[i]
            at = np.flatnonzero(fits)
            apart = np.bitwise_count(theirs[at] ^ mine[k]).sum(axis=1, dtype=np.int64)
            yield i, y[at[9 * apart <= n[y[at]] + n[i]]].tolist()


def _rest(left: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) of nodes of one key in ``left(h, node, n, root)`` and of unlike components that may be similar.

    The nodes of a key are dealt to blocks of about BLOCK; each two blocks meet in a task of their own and are compared there
    by their parities, so that only pairs which those leave open become rows. Such a pair is left to a smaller key where the
    KEYS smallest keys of both have one in common, so it is a row once, or a few times where they have not.
    """
    keys = left.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("h")), 1, KEYS).alias("keys"))
    sizes = left.groupBy("h").agg(F.count("*").alias("c")).select("h", F.expr(f"cast((c + {BLOCK - 1}) div {BLOCK} as int)").alias("blocks"))
    member = left.join(sizes, "h").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    dealt = dealt.select(F.xxhash64("h", i, j).alias("g"), "h", "node", "n", "root", (F.col("block") == i).alias("side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 1024):
            g, h, *columns = (t[c].to_numpy() for c in ("g", "h", "node", "root", "n", "side"))
            lists, parities = t["keys"].combine_chunks(), t["parity"]
            starts, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            edges = [*np.flatnonzero(np.r_[True, g[1:] != g[:-1]]).tolist(), len(g)]
            for s, e in zip(edges[:-1], edges[1:]):
                held = [set(values[starts[x] : starts[x + 1]].tolist()) for x in range(s, e)]
                near = ((x, y) for x, others in _near_pairs(*(c[s:e] for c in columns), parities.slice(s, e - s).to_pylist()) for y in others)
                found = [(s + x, s + y) for x, y in near if min(held[x] & held[y], default=h[s]) >= h[s]]
                pairs = np.array(found, np.int64).reshape(-1, 2)
                if len(pairs):
                    pairs = np.sort(columns[0][pairs], axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    rows = dealt.join(nodes.select("node", F.col("wide").alias("parity")), "node").join(keys, "node").repartition("g").sortWithinPartitions("g", "node")
    return rows.select("g", "h", "node", "root", "n", "side", "parity", "keys").mapInArrow(tidy(run), "a long, b long").distinct()


def close_pairs(nodes: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b), a < b: candidates among nodes(node, fp) by SimHash, those whose fingerprints differ in at most ``distance`` bits.

    Unlike fingerprints meet by multi-index hashing, each stands by its smallest node; its other nodes are paired with that one.
    """
    fps = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fps")
    found = links(fps.select("fp"), distance)
    for x in "ab":
        found = found.join(fps.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}")), x)
    found = found.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    same = nodes.select("node", "fp").join(fps, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return materialize(found.unionByName(same).distinct(), "close")


def similar_links(docs: DataFrame, marks: DataFrame, nodes: DataFrame, width: int = 5) -> DataFrame:
    """Edges (a, b) between nodes, each of Jaccard similarity 0.8 or more; components are those of all such pairs.

    The pairs that SimHash finds are verified first; that leaves similar sets whose fingerprints differ in more bits. Two such
    sets share at least four fifths of either's shingles, so in any one order of shingles their prefixes of a fifth (and one)
    have a shingle in common. So each node is then compared with the smallest one at each of its keys, unless they are
    connected by now; then, at keys whose nodes those links leave in several components, all nodes across components by their
    parities, in blocks. No pair at a key is left out but those already connected; at a key of many nodes that stay apart,
    comparisons (not rows) are quadratic.
    """
    close = close_pairs(nodes)
    near = _similar(close, docs, nodes, width)
    known = materialize(star_components(near), "known")
    keys = _spread(marks, "prefix", "node", "n")
    shared = keys.groupBy("h").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub <> top").select("h", "hub")
    at = materialize(keys.join(shared, "h").distinct(), "keys")
    hubs = nodes.join(known, "node", "left").select(F.col("node").alias("hub"), F.col("n").alias("m"), F.coalesce("root", "node").alias("hub_root"))
    pairs = at.where("node <> hub").select("hub", "node", "n").distinct().join(known, "node", "left").join(hubs, "hub")
    pairs = pairs.where((F.coalesce("root", "node") != F.col("hub_root")) & (5 * F.least("n", "m") >= 4 * F.greatest("n", "m")))
    stars = materialize(pairs.select(F.col("hub").alias("a"), F.col("node").alias("b")).join(close, ["a", "b"], "left_anti"), "tried")
    tried = stars.unionByName(close)
    found = near.unionByName(_similar(stars, docs, nodes, width))
    named = materialize(at.join(star_components(found), "node", "left").select("h", "node", "n", F.coalesce("root", "node").alias("root")), "named")
    split = named.groupBy("h").agg(F.min("root").alias("r"), F.max("root").alias("z"), F.count("*").alias("c")).where("r <> z and c > 2").select("h")
    rest = materialize(_rest(materialize(named.join(split, "h", "left_semi"), "left"), nodes).join(tried, ["a", "b"], "left_anti"), "rest")
    return found.unionByName(_similar(rest, docs, nodes, width))


def keep_dissimilar(docs: DataFrame, width: int = 5) -> DataFrame:
    """One row of ``docs`` for each component, the one with the smallest (doc_id, text digest); all columns stay.

    Components link rows whose sets of ``width``-word shingles have a Jaccard similarity of 0.8 or more. Null and empty texts
    and those without words count as equal. Of rows that are alike in doc_id and text one stays. Rows with null doc_id all
    stay and stand for no component; an empty table gives none; extra columns may have any name.
    """
    named, d = docs.where("doc_id is not null"), "_d_9f3c"
    marks = materialize(shingle_marks(named, width), "marks")
    nodes = materialize(marks.groupBy("node").agg(F.min(F.struct("doc_id", "d")).alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("parity").alias("parity"), F.first("wide").alias("wide")).select("node", F.col("first.doc_id").alias("rep"), F.col("first.d").alias("d"), "n", "fp", "parity", "wide"), "nodes")
    roots = star_components(similar_links(named, marks.select("node", "n", "prefix"), nodes, width))
    member = nodes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), F.struct("rep", "d").alias("r"))
    least = member.groupBy("root").agg(F.min("r").alias("r")).select(F.col("r.rep").alias("doc_id"), F.col("r.d").alias(d))
    kept = named.withColumn(d, F.xxhash64("text")).join(least, ["doc_id", d], "left_semi").dropDuplicates(["doc_id", d])
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))
