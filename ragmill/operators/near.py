"""Near vectors within a key by banded sign signatures, and the sequential merging of memories done for all at once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragmill.operators.retrieve import ranked, similarity
from ragmill.sources.store import scratch

#: Rows that a band's bucket should hold on average; widest band; probability to miss a pair at the threshold.
ROWS, WIDEST, MISS = 64, 20, 0.005
SEED, SLICE = 11, 512


def bands_needed(bits: int, least: float, miss: float = MISS) -> int:
    """Bands of ``bits`` signs so that a pair at cosine ``least`` shares none with probability ``miss`` at most; one band of no bits holds all."""
    if not bits:
        return 1
    one = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log1p(-one))) if one < 1 else 1


def signatures(vectors: DataFrame, by: str, key: str, bits: Column | int, least: float, miss: float = MISS) -> DataFrame:
    """(by, key, band, sign): the buckets of each vector, ``bits`` signs of projections a band; bits may differ by row.

    Projections come from a fixed seed, so signatures of any two tables agree. Null keys, ids and vectors, zero vectors and
    those with components that are no numbers have no bucket; vectors of other lengths meet in none.
    """
    by_type, key_type = (vectors.schema[c].dataType.simpleString() for c in (by, key))
    wide = {b: bands_needed(b, least, miss) for b in range(WIDEST + 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for big in batches:
            for at in range(0, big.num_rows, SLICE):
                b = big.slice(at, SLICE)
                widths = b.column(3).to_numpy()
                found = [np.array(v, np.float64) for v in b.column(2).to_pylist()]
                rows, band, sign = [], [], []
                sizes = np.array([len(v) if np.isfinite(v).all() and v.any() else 0 for v in found])
                for size, w in sorted(set(zip(sizes.tolist(), widths.tolist()))):
                    own = np.flatnonzero((sizes == size) & (widths == w))
                    if not size:
                        continue
                    n = wide[w]
                    if (size, w) not in planes:
                        planes[size, w] = np.random.default_rng([SEED, size, w]).standard_normal((size, n * w))
                    x = np.stack([found[i] for i in own])
                    on = ((x @ planes[size, w]) > 0).reshape(len(own), n, w)
                    rows.append(np.repeat(own, n))
                    band.append(np.tile(np.arange(n), len(own)) + (size << 12))
                    sign.append((on @ (1 << np.arange(w, dtype=np.int64)) + (w << 32)).reshape(-1))
                if rows:
                    take = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(np.concatenate(band)), pa.array(np.concatenate(sign))], names=[by, key, "band", "sign"])

    bits = F.lit(bits) if isinstance(bits, int) else bits
    ready = vectors.where(F.col(by).isNotNull() & F.col(key).isNotNull() & F.col("vector").isNotNull())
    return ready.select(by, key, F.col("vector").cast("array<double>").alias("vector"), F.least(bits, F.lit(WIDEST)).cast("int").alias("bits")).mapInArrow(run, f"{by} {by_type}, {key} {key_type}, band long, sign long")


def _kept(df: DataFrame, tag: str) -> DataFrame:
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _width(count: Column) -> Column:
    """Signs a band for so many rows, so that a bucket holds about ROWS of rows that are not alike."""
    return F.greatest(F.lit(0), F.ceil(F.log2(count / ROWS))).cast("int")


def _verified(pairs: DataFrame, left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """pairs(a, b) with their cosine, in 6 digits, if it is ``least`` or more; left(a, va) and right(b, vb) have the vectors."""
    scored = pairs.join(left, "a").join(right, "b").withColumn("cosine", F.round(similarity(F.col("va"), F.col("vb")), 6))
    return scored.where(F.col("cosine") >= least).drop("va", "vb")


def near_within(queries: DataFrame, vectors: DataFrame, by: str, least: float, miss: float = MISS) -> tuple[DataFrame, DataFrame]:
    """((query_id, chunk_id, score), (query_id, chunk_id) compared): pairs with the same ``by`` and a cosine of ``least`` or more.

    Bands are as wide as the rows of a key ask for: a key of up to ROWS vectors is compared whole, exactly; of larger keys
    only pairs with a band in common are compared, and a pair at the threshold is missed with probability ``miss`` at most,
    nearer ones less. ``retrieve.dense_within`` is the exact form for any threshold.
    """
    sizes = vectors.groupBy(by).agg(F.count("*").alias("_n"))
    sides = [df.select(by, key, "vector").join(sizes, by) for df, key in ((queries, "query_id"), (vectors, "chunk_id"))]
    q, v = (signatures(df, by, key, _width(F.col("_n")), least, miss) for df, key in zip(sides, ("query_id", "chunk_id")))
    compared = _kept(q.join(v, [by, "band", "sign"]).select("query_id", "chunk_id").distinct(), "compared")
    pairs = compared.select(F.col("query_id").alias("a"), F.col("chunk_id").alias("b"))
    near = _verified(pairs, queries.select(F.col("query_id").alias("a"), F.col("vector").alias("va")), vectors.select(F.col("chunk_id").alias("b"), F.col("vector").alias("vb")), least)
    return near.select(F.col("a").alias("query_id"), F.col("b").alias("chunk_id"), F.col("cosine").alias("score")), compared


def settle(candidates: DataFrame, memories: DataFrame, marks: DataFrame, least: float, bits: int, miss: float = MISS) -> tuple[DataFrame, DataFrame]:
    """What happens to candidates(user_id, candidate_id, seq, vector) that come one after another, by (seq, candidate_id).

    Each is merged into the nearest memory of its user, of cosine ``least`` or more, or becomes a memory itself, which later
    ones may be merged into. Returns (candidate_id, memory_id, cosine), with null cosine and its own id for a new memory, and
    the signatures of the new ones. memories(user_id, memory_id, vector) are there before; ``marks`` has their signatures.

    A candidate is a memory exactly if no earlier one within reach is, so fates are settled in rounds, not in order: the first
    open candidate of all its buckets is a memory, and what is within its reach merges; each bucket tests one candidate, so
    a group of copies, however large, makes no pairs. When rounds settle little, the near pairs of those left are made and
    rounds go over them. Equal vectors share a fate but for the first. Ties of cosine go to the larger memory_id.
    """
    spark = candidates.sparkSession
    c = _kept(candidates.withColumn("same", F.xxhash64("vector")), "candidates")
    first = F.min(F.struct("seq", "candidate_id")).alias("f")
    reps = _kept(c.join(c.groupBy("user_id", "same").agg(first), ["user_id", "same"]).where("candidate_id = f.candidate_id").drop("f"), "reps")
    own = _kept(signatures(reps, "user_id", "candidate_id", bits, least, miss).join(reps.select("candidate_id", "seq"), "candidate_id"), "marks")
    va = reps.select(F.col("candidate_id").alias("a"), F.col("vector").alias("va"))
    vb = va.withColumnsRenamed({"a": "b", "va": "vb"})
    before = memories.select(F.col("memory_id").alias("b"), F.col("vector").alias("vb"))
    bucket = ["user_id", "band", "sign"]
    hit = own.join(marks, bucket).select(F.col("candidate_id").alias("a"), F.col("memory_id").alias("b")).distinct()
    merged = _verified(hit, va, before, least).select("a").distinct()
    odd = reps.join(own.select("candidate_id").distinct(), "candidate_id", "left_anti").select("candidate_id")  # no direction: near nothing
    open_ = _kept(own.join(merged.withColumnRenamed("a", "candidate_id"), "candidate_id", "left_anti"), "open")
    leaders, left = odd, open_.select("candidate_id").distinct().count()
    while left:
        firsts = open_.groupBy(*bucket).agg(F.min(F.struct("seq", "candidate_id")).alias("f")).select(*bucket, F.col("f.candidate_id").alias("b"))
        met = _kept(open_.join(firsts, bucket).select(F.col("candidate_id").alias("a"), "b").distinct(), "met")
        lead = _kept(met.groupBy("a").agg(F.max(F.col("a") != F.col("b")).alias("other")).where("not other").select("a"), "lead")
        leaders = leaders.unionByName(lead.withColumnRenamed("a", "candidate_id"))
        gone = _verified(met.where("a <> b").join(lead.withColumnRenamed("a", "b"), "b", "left_semi"), va, vb, least).select("a").unionByName(lead).distinct()
        open_ = _kept(open_.join(gone.withColumnRenamed("a", "candidate_id"), "candidate_id", "left_anti"), "open")
        now = open_.select("candidate_id").distinct().count()
        if 10 * (left - now) < left:
            break
        left = now
    else:
        now = 0
    if now:
        o = open_.select(*bucket, "candidate_id", "seq")
        earlier = F.struct("seq_b", "b") < F.struct("seq_a", "a")
        pairs = o.withColumnsRenamed({"candidate_id": "a", "seq": "seq_a"}).join(o.withColumnsRenamed({"candidate_id": "b", "seq": "seq_b"}), bucket).where(earlier).select("a", "b").distinct()
        near = _kept(_verified(pairs, va, vb, least).select("a", "b"), "near")
        nodes = _kept(open_.select(F.col("candidate_id").alias("a")).distinct(), "nodes")
        while nodes.head(1):
            waits = near.join(nodes.withColumnRenamed("a", "b"), "b", "left_semi").select("a").distinct()
            lead = _kept(nodes.join(waits, "a", "left_anti"), "lead")
            leaders = leaders.unionByName(lead.withColumnRenamed("a", "candidate_id"))
            gone = near.join(lead.withColumnRenamed("a", "b"), "b", "left_semi").select("a").unionByName(lead).distinct()
            nodes = _kept(nodes.join(gone, "a", "left_anti"), "nodes")
    leaders = _kept(leaders.distinct(), "leaders")
    new = own.join(leaders, "candidate_id", "left_semi").withColumnRenamed("candidate_id", "memory_id")
    kind = dict(candidates.dtypes)["candidate_id"]
    held = marks.select(*bucket, F.col("memory_id").cast(kind).alias("b"), F.lit(None).cast(dict(candidates.dtypes)["seq"]).alias("since")).unionByName(new.select(*bucket, F.col("memory_id").alias("b"), F.col("seq").alias("since")))
    rest = c.join(leaders, "candidate_id", "left_anti").select(F.col("candidate_id").alias("a"), "user_id", "same", "seq")
    marked = rest.join(own.drop("seq").join(reps.select("candidate_id", "same"), "candidate_id").drop("candidate_id"), ["user_id", "same"])
    earlier = F.col("since").isNull() | (F.struct("since", "b") < F.struct("seq", "a"))
    pairs = marked.join(held, bucket).where(earlier).select("a", "b").distinct()
    every = c.select(F.col("candidate_id").alias("a"), F.col("vector").alias("va"))
    into = _verified(pairs, every, before.unionByName(vb.join(leaders.withColumnRenamed("candidate_id", "b"), "b", "left_semi")), least)
    best = ranked(into, ["a"], [F.desc("cosine"), F.desc("b")], 1, "r").select(F.col("a").alias("candidate_id"), F.col("b").alias("memory_id"), "cosine")
    alone = leaders.select("candidate_id", F.col("candidate_id").alias("memory_id"), F.lit(None).cast("double").alias("cosine"))
    # copies of a vector without direction have no bucket: each is a memory of its own
    apart = rest.join(odd.join(reps.select("candidate_id", "user_id", "same"), "candidate_id").select("user_id", "same"), ["user_id", "same"], "left_semi").select(F.col("a").alias("candidate_id"), F.col("a").alias("memory_id"), F.lit(None).cast("double").alias("cosine"))
    return _kept(alone.unionByName(best).unionByName(apart), "settled"), new.drop("seq")


def clusters_of(vectors: DataFrame, most: int = 256, sample: int = 20_000, seed: int = SEED) -> DataFrame:
    """(chunk_id, vector, cluster, angle): each vector with the nearest of up to ``most`` centres and the angle to it.

    Centres are vectors of a bounded random sample; which they are does not change any result of a search. Rows with a null
    id or vector, zero vectors and those with components that are no numbers are left out.
    """
    spark = vectors.sparkSession
    fits = vectors.where("chunk_id is not null and vector is not null").select("chunk_id", F.col("vector").cast("array<double>").alias("vector"))
    some = fits.select("vector").orderBy(F.xxhash64("chunk_id", F.lit(seed))).limit(min(most, sample)).collect()
    found = [x for x in (np.array(r.vector) for r in some) if len(x) and np.isfinite(x).all() and x.any()]
    centres = {n: np.stack([x / np.linalg.norm(x) for x in found if len(x) == n]) for n in {len(x) for x in found}}
    first = dict(zip(centres, np.cumsum([0, *(len(c) for c in centres.values())]).tolist()))
    shared = spark.sparkContext.broadcast((centres, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begin = shared.value
        for big in batches:
            for at in range(0, big.num_rows, SLICE):
                b = big.slice(at, SLICE)
                cluster, angle = np.full(b.num_rows, -1, np.int64), np.zeros(b.num_rows)
                for i, v in enumerate(b.column(1).to_pylist()):
                    x = np.array(v, np.float64)
                    if not len(x) or not np.isfinite(x).all() or not x.any():
                        cluster[i] = -2
                    elif len(x) in held:
                        c = held[len(x)] @ (x / np.linalg.norm(x))
                        cluster[i], angle[i] = begin[len(x)] + c.argmax(), np.arccos(min(1.0, c.max()))
                    else:  # a length that the sample has not: all of them are one cluster, which is never skipped
                        angle[i] = np.pi
                out = pa.RecordBatch.from_arrays([*b.columns, pa.array(cluster), pa.array(angle)], names=["chunk_id", "vector", "cluster", "angle"])
                yield out.filter(pa.array(cluster > -2))

    return fits.mapInArrow(run, f"chunk_id {dict(fits.dtypes)['chunk_id']}, vector array<double>, cluster long, angle double")


def dense_clustered(queries: DataFrame, vectors: DataFrame, k: int = 30, most: int = 256) -> tuple[DataFrame, DataFrame]:
    """((query_id, chunk_id, score, rank), (query_id, cluster) opened): the exact nearest chunks by cosine, for any number of queries.

    Vectors are read once and dealt to clusters. A cluster's centre and widest angle bound the angle of a query to all it
    holds, from below and above; with the clusters' sizes the upper bounds give an angle that the k-th nearest can't exceed,
    and a query opens the clusters whose lower bound is not beyond it. Queries and vectors then meet by cluster, in blocks.
    Nothing of the queries passes the driver; of the clusters, up to ``most`` rows do. Vectors of other lengths than the
    query's, zero vectors and null ones match nothing; ties go to the smaller chunk_id.
    """
    from ragmill.operators.retrieve import dense_within

    dealt = _kept(clusters_of(vectors, most), "dealt")
    sizes = dealt.groupBy("cluster").agg(F.count("*").alias("n"), F.max("angle").alias("wide"), F.min_by("vector", F.struct("angle", F.xxhash64("chunk_id"))).alias("mid"), F.min("angle").alias("off")).collect()
    table = [(r.cluster, r.n, r.wide + r.off, np.array(r.mid) / np.linalg.norm(r.mid)) for r in sizes]
    shared = vectors.sparkSession.sparkContext.broadcast(table)
    kind = dict(queries.dtypes)["query_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = shared.value
        for big in batches:
            for at in range(0, big.num_rows, SLICE):
                b = big.slice(at, SLICE)
                rows, clusters = [], []
                for i, v in enumerate(b.column(1).to_pylist()):
                    q = np.array(v, np.float64)
                    if not len(q) or not np.isfinite(q).all() or not q.any():
                        continue
                    q = q / np.linalg.norm(q)
                    near = [(c, n, w, math.acos(max(-1.0, min(1.0, float(q @ m)))) if len(m) == len(q) else 0.0) for c, n, w, m in told if len(m) == len(q) or c == -1]
                    near.sort(key=lambda x: x[2] + x[3])
                    reach, seen = math.pi, 0
                    for c, n, w, a in near:
                        seen += n if c != -1 else 0
                        if seen >= k:
                            reach = min(math.pi, w + a)
                            break
                    for c, _, w, a in near:
                        if c == -1 or math.cos(max(0.0, min(math.pi, a - w))) >= math.cos(reach) - 2e-6:
                            rows.append(i)
                            clusters.append(c)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), b.column(1).take(pa.array(rows, pa.int64())), pa.array(clusters, pa.int64())], names=["query_id", "vector", "cluster"])

    asked = queries.where("query_id is not null and vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    opened = _kept(asked.mapInArrow(run, f"query_id {kind}, vector array<double>, cluster long"), "opened")
    found = dense_within(opened, dealt.select("cluster", "chunk_id", "vector"), "cluster", k)
    return ranked(found, ["query_id"], [F.desc("score"), "chunk_id"], k), opened.select("query_id", "cluster")
