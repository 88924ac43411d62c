"""SimHash near-duplicates found by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.llm.common import materialize, star_components, tidy

SEED = 42
CHUNK = 1 << 15


def vote(hashes: Iterable[np.ndarray], n: int) -> int:
    """SimHash of ``n`` 64-bit hashes, given in arrays, as a signed integer: a bit is 1 if it is set in more than half of them."""
    ones = np.zeros(64, np.int64)
    for h in hashes:
        for at in range(0, len(h), CHUNK):
            ones += np.unpackbits(h[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of one text, as a signed integer.

    Words are runs of bytes outside ASCII white space after lower-casing A-Z; shingles are ``width`` words joined by a
    space, repeats included; a text of fewer words is one shingle, one of none (or null) has fingerprint 0. A bit is 1 if
    it is set in more than half the shingles' XXH64 (seed 42). Bits are counted in chunks, so a long text needs little memory.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, take = b" ".join(words), min(width, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - take + 1].tolist()
    ends = ends[take - 1 :].tolist()
    chunks = (zip(starts[at : at + CHUNK], ends[at : at + CHUNK]) for at in range(0, len(starts), CHUNK))
    return vote((np.array([xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in c], np.uint64) for c in chunks), len(starts))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp long) for each row of ``docs``; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), width) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, fp long")


def _masks(bits: int, radius: int, shift: int = 0) -> list[int]:
    """All masks of at most ``radius`` set bits among ``bits`` bits from ``shift`` on, as signed 64-bit integers."""
    out = [sum(1 << (shift + i) for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _ball(fp: str, masks: list[int]):
    return F.explode(F.transform(F.lit(masks).cast("array<bigint>"), lambda m: F.col(fp).bitwiseXOR(m)))


def links(fps: DataFrame, distance: int = 4, heavy: int = 2048) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints of ``fps(fp)`` within ``distance`` bits; components are exact.

    A fingerprint has two 32-bit segments. Of two fingerprints within ``distance`` = d, the high segments differ by at most
    h = d // 2 bits or the low ones by at most d - h - 1. For either case both sides together enumerate the Hamming ball of
    that radius: the table holds the ball of the larger half radius, the probe that of the rest, so equal keys meet in an
    equi-join; whole distances are then verified. Rows per fingerprint are a constant (99 at distance 4).

    A table entry shared by more than ``heavy`` fingerprints would make many pairs. Its fingerprints are linked the other way:
    each emits its whole ball of radius d / 2 (rounded up and down for the sides); two within d bits share a midpoint, and
    all that share one are within d bits at even d, so each links to the smallest there. No cap, no lost link.

    Spark takes an exploded ball for hardly larger than its fingerprints and would broadcast it, so balls are merge-joined.
    """
    half = 32
    high = distance // 2
    low = distance - high - 1
    mask = (1 << half) - 1
    keys = []
    for seg, radius in ((0, high), (1, low)):
        shift = half if seg == 0 else 0
        part = F.col("fp").bitwiseAND(-(1 << half) if seg == 0 else mask)
        for side, r in (("t", radius // 2), ("p", radius - radius // 2)):
            keys.append((seg, side, part, _masks(half, r, shift)))
    rows = {s: None for s in "tp"}
    for seg, side, part, masks in keys:
        x = fps.select("fp", part.alias("part")).select("fp", F.lit(seg).alias("seg"), _ball("part", masks).alias("key"))
        rows[side] = x if rows[side] is None else rows[side].unionByName(x)
    table = rows["t"]
    sizes = rows["p"].groupBy("seg", "key").agg(F.count("*").alias("n")).where(F.col("n") > heavy)
    big = materialize(sizes.select("seg", "key"), "heavy")
    probe = rows["p"]
    crowded = None
    if distance % 2 == 0 and big.head(1):
        crowded = materialize(probe.join(big, ["seg", "key"], "left_semi").select("fp").distinct(), "crowded")
        table = table.join(big, ["seg", "key"], "left_anti")
        probe = probe.join(big, ["seg", "key"], "left_anti")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    within = F.when(F.col("seg") == 0, F.lit(-(1 << half))).otherwise(F.lit(mask))
    at = F.col("a").bitwiseAND(within).bitwiseXOR(F.col("key"))
    bt = F.col("b").bitwiseAND(within).bitwiseXOR(F.col("key"))
    once = (at < bt) | ((at == 0) & (bt == 0))  # of the keys at which two meet, and of the segments, one
    fresh = (F.col("seg") == 0) | (F.bit_count(differ.bitwiseAND(-(1 << half))) > high)
    found = (
        table.select("seg", "key", F.col("fp").alias("a"))
        .join(probe.select("seg", "key", F.col("fp").alias("b")).hint("merge"), ["seg", "key"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= distance) & once & fresh)
        .select("a", "b")
    )
    if crowded is not None:
        ball = crowded.select("fp", _ball("fp", _masks(64, distance // 2)).alias("mid"))
        first = ball.groupBy("mid").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z")
        star = ball.join(first.hint("merge"), "mid").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
        found = found.unionByName(star)
    return found


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4, heavy: int = 2048) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (smallest doc_id reachable over links, itself included).

    Equal fingerprints collapse to one node first, so copies never make pairs. Null, empty and wordless texts share
    fingerprint 0 and are linked like others. Repeated rows each give a row; an empty table gives none. Null doc_ids never
    name a component while another member has an id. Extra columns are ignored.
    """
    fps = materialize(fingerprints(docs, width), "fps")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    found = star_components(links(nodes.select("fp"), distance, heavy))
    member = nodes.join(found.withColumnRenamed("node", "fp"), "fp")
    least = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    joined = materialize(member.join(least, "root").select("fp", "component_id"), "members")
    comp = nodes.join(joined, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return fps.join(comp, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that stand for their component: those whose doc_id is its component_id. All columns stay."""
    kept = near_duplicates(docs, **params).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
