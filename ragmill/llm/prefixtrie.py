"""Trie of conversation prefixes: prefix digests in minimal-perfect-hash slots, counts in flat arrays, sums along parent slots."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.llm.common import materialize, tidy

#: Conversations share the first turns of the first of each GROUP ids, up to HEAD - 1 turns.
GROUP, HEAD = 20, 4
#: Rows of one shard's table of slots.
SHARD_ROWS = 1 << 16
#: Ids that are joined to one piece of text, by ranges of ids.
ID_BITS = 12
_LOCAL = "shard long, k1 long, k2 long, p1 long, p2 long, depth long, words long, n long, conv long, ends array<long>"
_SUMS = "up boolean, shard long, k1 long, k2 long, children long, leaves long, saved long, parent long, conv long, depth long, n long, n_ends long, first_end long"


class Slots:
    """Minimal perfect hash of distinct 128-bit digests, in flat arrays.

    A level has two bits a key; a key that is alone at its bit stays there, the others go to the next level, hashed anew. A
    key's slot is the rank of its bit. Each slot keeps its digest, which verifies every look-up.
    """

    def __init__(self, k1: np.ndarray, k2: np.ndarray):
        slot = np.empty(len(k1), np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, base = np.arange(len(k1)), 0
        while len(left):
            at = self._place(k1[left], k2[left], len(self.levels), 2 * len(left))
            bits = np.bincount(at, minlength=2 * len(left)) == 1
            rank = np.cumsum(bits) - 1 + base
            alone = bits[at]
            slot[left[alone]] = rank[at[alone]]
            self.levels.append((bits, rank))
            base += int(alone.sum())
            left = left[~alone]
        self.k1, self.k2 = np.empty_like(k1), np.empty_like(k2)
        self.k1[slot], self.k2[slot] = k1, k2

    @staticmethod
    def _place(k1: np.ndarray, k2: np.ndarray, level: int, width: int) -> np.ndarray:
        x = k1.view(np.uint64) ^ (k2.view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + k2.view(np.uint64)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(width)).astype(np.int64)

    def find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """The slots of digests, -1 for those that are not in the table."""
        slot, left = np.full(len(k1), -1, np.int64), np.arange(len(k1))
        for level, (bits, rank) in enumerate(self.levels):
            at = self._place(k1[left], k2[left], level, len(bits))
            slot[left[bits[at]]] = rank[at[bits[at]]]
            left = left[~bits[at]]
        return np.where((slot >= 0) & (self.k1[slot] == k1) & (self.k2[slot] == k2), slot, -1) if len(self.k1) else slot


def _pairs(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return np.ascontiguousarray(x[:, 0]), np.ascontiguousarray(x[:, 1])


class _Shard:
    """Rows of one run of rebuilt conversations: a row is a conversation at a depth."""

    def __init__(self, name: int):
        self.name = name
        self.conv: list[int] = []
        self.depth: list[int] = []
        self.digest: list[bytes] = []
        self.parent: list[bytes] = []
        self.words: list[int] = []
        self.counts: list[int] = []
        self.ends: list[tuple[int, int]] = []

    def add(self, conv: int, depth: int, digest: bytes, parent: bytes, words: int, counts: int) -> None:
        for column, value in ((self.conv, conv), (self.depth, depth), (self.digest, digest), (self.parent, parent), (self.words, words), (self.counts, counts)):
            column.append(value)

    def batch(self) -> pa.RecordBatch:
        """One row for each distinct prefix: its members here, the smallest, and those that end at it."""
        k1, k2 = _pairs(self.digest)
        p1, p2 = _pairs(self.parent)
        order = np.lexsort((k2, k1))
        new = np.r_[True, (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])]
        slots = Slots(k1[order[new]], k2[order[new]])
        slot = slots.find(k1, k2)
        size = len(slots.k1)
        n, conv = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
        np.add.at(n, slot, np.array(self.counts, np.int64))
        np.minimum.at(conv, slot, np.array(self.conv, np.int64))
        scattered = []
        for values in (p1, p2, np.array(self.depth, np.int64), np.array(self.words, np.int64)):
            flat = np.zeros(size, np.int64)
            flat[slot] = values
            scattered.append(flat)
        at, ids = (np.array(x, np.int64) for x in zip(*self.ends)) if self.ends else (np.zeros(0, np.int64),) * 2
        by = np.argsort(slot[at], kind="stable")
        offsets = np.r_[0, np.cumsum(np.bincount(slot[at], minlength=size))].astype(np.int32)
        ends = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[by]))
        columns = [np.full(size, self.name), slots.k1, slots.k2, *scattered, n, conv]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), ends], names=[x.split()[0] for x in _LOCAL.split(", ")])


def _turns(batches: Iterator[pa.RecordBatch], group: int, head: int) -> Iterator[tuple[int, bytes | None, int]]:
    """(conv_id, turn digest, words) of rebuilt conversations, from rows sorted by their base, the base conversation first.

    Each conversation begins with a row whose digest is None.
    """
    base = conv = None
    first: list[tuple[bytes, int]] = []
    seen = skip = 0
    for b in batches:
        for g, c, t, w in zip(*(b.column(x).to_pylist() for x in ("base", "conv_id", "t", "words"))):
            if g != base:
                base, first = g, []
            if c != conv:
                conv, seen = c, 0
                skip = zlib.crc32(str(c).encode()) % head if c != base else 0
                yield c, None, 0
                for x in first[:skip]:
                    yield c, *x
            if c == base and len(first) < head - 1:
                first.append((t, w))
            if seen >= skip:
                yield c, t, w
            seen += 1


def local_tries(conversations: DataFrame, group: int = GROUP, head: int = HEAD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each shard and distinct prefix of the rebuilt conversations in it (columns of _LOCAL).

    Turns are cut down to a digest of 128 bits and a word count before they are shuffled. A shard is a run of about
    ``shard_rows`` rows; of a conversation that goes on in the next shard, the last prefix is there too, with count 0.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.unhex(F.substring(digest, 1, 32)).alias("t"), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words")
    ).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    dealt = turns.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", "turn", "role", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, task = bytes(16), TaskContext.get().partitionId() << 32
        shard, conv, depth, digest = _Shard(task), None, 0, root
        for c, t, w in _turns(batches, group, head):
            if t is None and conv is not None:
                shard.ends.append((len(shard.conv) - 1, conv))
            if len(shard.conv) >= shard_rows:
                yield shard.batch()
                before, shard = shard, _Shard(shard.name + 1)
                if t is not None:
                    shard.add(conv, depth, digest, before.parent[-1], before.words[-1], 0)
            parent = digest
            conv, depth, digest = (c, 0, root) if t is None else (c, depth + 1, hashlib.sha256(digest + t).digest()[:16])
            shard.add(c, depth, digest, parent if depth else root, w, 1)
        if conv is not None:
            shard.ends.append((len(shard.conv) - 1, conv))
            yield shard.batch()

    return dealt.select("base", "conv_id", "t", "words").mapInArrow(tidy(run), _LOCAL)


def _accumulate(rows: DataFrame) -> DataFrame:
    """Sums of children, leaves and saved over each node's subtree in its shard, as rows of _SUMS.

    ``rows`` are local nodes with what the shard adds at each. A shard's nodes are put in slots, parents looked up as slots,
    and sums added from parent slot to parent slot, deepest first. The node above which the shard knows nothing (a
    conversation was cut there) gives a row ``up`` for the shard before.
    """
    names = [x.split()[0] for x in _SUMS.split(", ")]

    def one(t: pa.Table) -> pa.RecordBatch:
        c = {x: t[x].to_numpy() for x in t.column_names if x not in ("own", "parent")}
        slots = Slots(c["k1"], c["k2"])
        slot, size = slots.find(c["k1"], c["k2"]), len(t)
        flat = {}
        for x in ("depth", "children", "leaves", "saved", "n", "g_conv", "n_ends", "first_end", "own", "p1", "p2"):
            flat[x] = np.zeros(size, np.int64)
            flat[x][slot] = c[x] if x != "own" else t[x].to_numpy().astype(np.int64)
        depth, own = flat["depth"], flat["own"] > 0
        parent = np.where(depth > 0, slots.find(flat["p1"], flat["p2"]), -1)
        has = parent >= 0
        np.add.at(flat["children"], parent[own & has], 1)
        order = np.argsort(-depth, kind="stable")
        for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
            level = level[has[level]]
            for x in ("leaves", "saved"):
                np.add.at(flat[x], parent[level], flat[x][level])
        up = ~has & (depth > 0)
        above = np.where(has, flat["g_conv"][parent], 0)
        shown = [pa.array(flat[x], mask=~own) for x in ("g_conv", "depth", "n", "n_ends", "first_end")]
        return pa.RecordBatch.from_arrays(
            [pa.array(up), pa.array(c["shard"] - up.astype(np.int64)), *(pa.array(x) for x in (slots.k1, slots.k2)), *(pa.array(flat[x]) for x in ("children", "leaves", "saved")), pa.array(above, mask=~(own & has)), *shown], names=names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            cuts = [0, *(np.flatnonzero(np.diff(b.column(0).to_numpy())) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:]):
                part = b.slice(s, e - s)
                if held and part.num_rows and held[0].column(0)[0] != part.column(0)[0]:
                    yield one(pa.Table.from_batches(held))
                    held = []
                if part.num_rows:
                    held.append(part)
        if held:
            yield one(pa.Table.from_batches(held))

    columns = ("shard", "k1", "k2", "p1", "p2", "depth", "children", "leaves", "saved", "own", "n", "g_conv", "n_ends", "first_end")
    return rows.select(*columns).repartition("shard").sortWithinPartitions("shard").mapInArrow(tidy(run), _SUMS)


def _ends_digests(local: DataFrame, nodes: DataFrame) -> DataFrame:
    """(k1, k2, sha) of the nodes at which several conversations end.

    Ids are joined to texts by ranges of 2^ID_BITS ids in any number of tasks; one task then runs the digest over a node's
    few texts in order, as a digest of a sequence has to be, and holds one of them at a time.
    """
    ids = local.where(F.size("ends") > 0).select("k1", "k2", F.explode("ends").alias("id")).withColumn("range", F.shiftright("id", ID_BITS))
    texts = ids.groupBy("k1", "k2", "range").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))
    texts = texts.join(nodes.where("n_ends > 1").select("k1", "k2"), ["k1", "k2"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([digest.hexdigest()])], names=["k1", "k2", "sha"])

        for b in batches:
            for k1, k2, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if (k1, k2) != key:
                    if key:
                        yield row()
                    key, digest = (k1, k2), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.as_py().encode())
        if key:
            yield row()

    return texts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "range").select("k1", "k2", "ids").mapInArrow(tidy(run), "k1 long, k2 long, sha string")


def prefix_trie(conversations: DataFrame, group: int = GROUP, head: int = HEAD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The trie of all rebuilt conversations, one row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), role, and a digest of role and text; null role or text counts as empty; repeated
    rows are turns like others. Rows with null conv_id belong to no conversation and are left out. Conversation c is the
    first h turns of conversation c - c % ``group`` and its own turns after its first h, with h = crc32(c) % ``head``. An
    empty table gives no row; extra columns are ignored, of whatever name.

    Shards are runs of conversations, not of nodes, so a prefix that all share is one row in each shard. A node counts
    in one shard only, that of its smallest member, which holds all its ancestors; sums of shards are added by digest. A
    task holds one shard; the turns of one conversation, as digests, stream through one task.
    """
    local = materialize(local_tries(conversations, group, head, shard_rows), "tries")
    keys = ["k1", "k2"]
    nodes = local.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min(F.struct("conv", "shard")).alias("first"), F.sum(F.size("ends")).alias("n_ends"), F.min(F.array_min("ends")).alias("first_end")
    )
    known = materialize(nodes.select(*keys, F.col("n").alias("total"), F.col("first.conv").alias("g_conv"), F.col("first.shard").alias("owner"), "n_ends", F.coalesce("first_end", F.lit(0)).alias("first_end")), "nodes")
    rows = local.drop("ends").join(known, keys).withColumn("own", F.col("shard") == F.col("owner")).withColumns({"n": F.col("total"), "children": F.lit(0).cast("long")})
    once = F.col("own").cast("long")
    rows = rows.withColumns({"leaves": once * (F.col("n") == F.col("n_ends")).cast("long"), "saved": once * (F.col("n") - 1) * F.col("words")})
    sums = materialize(_accumulate(rows), "sums")
    every = [sums.where("not up")]
    while sums.where("up").head(1):
        more = sums.where("up").groupBy("shard", *keys).agg(*(F.sum(x).alias(x) for x in ("children", "leaves", "saved")))
        there = rows.drop("children", "leaves", "saved").withColumn("own", F.lit(False)).join(more.select("shard").distinct(), "shard", "left_semi").join(more, ["shard", *keys], "left")
        sums = materialize(_accumulate(there.fillna(0, ["children", "leaves", "saved"])), "sums")
        every.append(sums.where("not up"))
    whole = every[0]
    for part in every[1:]:
        whole = whole.unionByName(part)
    told = ("parent", "conv", "depth", "n", "n_ends", "first_end")
    trie = whole.groupBy(*keys).agg(*(F.sum(x).alias(x) for x in ("children", "leaves", "saved")), *(F.max(x).alias(x) for x in told)).join(_ends_digests(local, known), keys, "left")
    sha = F.when(F.col("n_ends") == 0, F.sha2(F.lit(""), 256)).when(F.col("n_ends") == 1, F.sha2(F.col("first_end").cast("string"), 256)).otherwise(F.col("sha"))
    return trie.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), sha.alias("ends_sha256"))


def op12_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _sql() -> str:
    from ragmill.llm.langid import CRC_TABLE
    from ragmill.llm.sharding import crc32_sql

    return f"""
WITH crc AS MATERIALIZED (SELECT {CRC_TABLE} AS tab),
turns AS (
  SELECT conv_id, t, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, t) AS pos
  FROM (SELECT *, sha256(length(role) || ':' || role || text) AS t FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))),
convs AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % {GROUP} AS base, ({crc32_sql("conv_id::VARCHAR")})::BIGINT % {HEAD} AS h FROM (SELECT DISTINCT conv_id FROM turns), crc),
built AS (
  SELECT c.conv_id, t.t, t.words, row_number() OVER (PARTITION BY c.conv_id ORDER BY t.pos) AS depth
  FROM convs c JOIN turns t ON (t.conv_id = c.base AND t.pos <= c.h) OR (t.conv_id = c.conv_id AND t.pos > c.h)),
paths AS MATERIALIZED (
  SELECT conv_id, 0 AS depth, 0 AS words, '' AS path FROM convs
  UNION ALL SELECT conv_id, depth, words, sha256(string_agg(t, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth)) FROM built),
long AS (SELECT conv_id, max(depth) AS size FROM paths GROUP BY 1),
nodes AS MATERIALIZED (
  SELECT path, any_value(p.depth) AS depth, min(conv_id) AS conv, count(*) AS n, any_value(words) AS words, count(*) FILTER (depth = size) AS n_ends,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = size), '')) AS ends
  FROM paths p JOIN long USING (conv_id) GROUP BY 1),
placed AS MATERIALIZED (
  SELECT p.conv_id, p.path, p.depth, lag(p.path) OVER (PARTITION BY p.conv_id ORDER BY p.depth) AS parent,
    CASE WHEN conv = p.conv_id THEN (n - 1) * n_.words ELSE 0 END AS gain, (conv = p.conv_id AND n = n_ends)::INTEGER AS leaf, (conv = p.conv_id)::INTEGER AS own
  FROM paths p JOIN nodes n_ USING (path)),
below AS (SELECT *, sum(gain) OVER w AS saved, sum(leaf) OVER w AS leaves, coalesce(lead(own) OVER (PARTITION BY conv_id ORDER BY depth), 0) AS child
  FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
summed AS (SELECT path, sum(saved) AS saved, sum(leaves) AS leaves, sum(child) AS children, any_value(parent) AS parent FROM below GROUP BY 1)
SELECT n.conv AS conv_id, n.depth::BIGINT AS depth, p.conv AS parent_conv_id, n.n AS n_convs, s.children::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN summed s USING (path) LEFT JOIN nodes p ON p.path = s.parent
"""


PREFIXTRIE_SQL = _sql()
