"""Embedding near-duplicates by randomised-rotation binary codes with error bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragmill.llm.common import materialize, star_components, tidy, whole_groups

SEED = 20_240
CODE_BITS = 256
LANE = 16
#: Vectors of a label that share a lane by chance, about, and so the width of its lanes.
FILL = 16
MISS = 0.003
EPSILON = 3.5
BLOCK = 1024


@cache
def rotation(dim: int) -> np.ndarray:
    """``dim`` orthonormal columns in as many dimensions as the code has bits: pads a vector and rotates it at random."""
    bits = max(CODE_BITS, -(-dim // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((bits, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits of the rotated unit vectors and each one's correction factor, the inner product of vector and code."""
    y = unit @ rotation(unit.shape[1]).T
    return np.packbits(y > 0, axis=1), np.abs(y).sum(axis=1) / np.sqrt(y.shape[1])


def estimate(codes: np.ndarray, factors: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the inner products of coded vectors (rows) with whole ones (columns), and the error bounds.

    The estimate is <code, other> / <code, own vector>; its error is below EPSILON sqrt((1 - f^2) / f^2) / sqrt(bits - 1)
    with overwhelming probability over the rotation.
    """
    bits = codes.shape[1] * 8
    signs = (np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(bits))
    y = (unit @ rotation(unit.shape[1]).T).astype(np.float32)
    bound = EPSILON * np.sqrt(np.maximum(0, 1 - factors**2)) / factors / np.sqrt(bits - 1)
    return (signs @ y.T) / factors[:, None].astype(np.float32), bound


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@cache
def lanes(bits: int, width: int, threshold: float, miss: float = MISS) -> np.ndarray:
    """The code's bits that each lane takes, a row a lane: as many lanes of ``width`` bits as keep misses below ``miss``.

    Two vectors at the threshold differ in each bit with a probability of its angle over pi. Lanes of one order of the bits
    are disjoint; where they do not suffice, further ones come from shuffled orders, and their number follows from the
    distribution of differing bits.
    """
    p, d = math.acos(threshold) / math.pi, np.arange(bits + 1)
    logs = np.array([math.lgamma(i + 1) for i in range(bits + 1)])
    weight = np.exp(logs[bits] - logs[d] - logs[bits - d] + d * math.log(max(p, 1e-300)) + (bits - d) * math.log1p(-p))
    left = np.maximum(bits - d - width, 0)
    same = np.where(bits - d >= width, np.exp(logs[bits - d] - logs[left] - logs[bits] + logs[bits - width]), 0.0)
    n, each = 1, bits // width
    while (1 - (1 - p) ** width) ** n > miss if n <= each else (weight * (1 - same) ** n).sum() > miss:
        n += 1
    rng = np.random.default_rng(SEED)
    orders = [np.arange(bits), *(rng.permutation(bits) for _ in range(-(-n // each) - 1))]
    return np.concatenate([o[: each * width].reshape(each, width) for o in orders])[:n]


def _keys(codes: np.ndarray, width: int, threshold: float, miss: float) -> np.ndarray:
    """Each code's lanes as whole numbers, a row a code."""
    signs = np.unpackbits(codes, axis=1)
    return np.stack([signs[:, x] @ (np.int64(1) << np.arange(width, dtype=np.int64)) for x in lanes(signs.shape[1], width, threshold, miss)], axis=1)


def _codes(classes: DataFrame, threshold: float, miss: float) -> DataFrame:
    """``classes`` with each vector's code, correction factor and lanes; vectors of one batch may differ in length and lane width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column("v").to_pylist()
            widths = b.column("width").to_pylist()
            codes, factors, keys = [b""] * len(vectors), np.zeros(len(vectors)), [[]] * len(vectors)
            for dim, width in set(zip(map(len, vectors), widths)):
                at = [i for i, v in enumerate(vectors) if len(v) == dim and widths[i] == width]
                code, factors[at] = encode(_unit(np.array([vectors[i] for i in at], np.float64)))
                for i, c, k in zip(at, code, _keys(code, width, threshold, miss).tolist()):
                    codes[i], keys[i] = c.tobytes(), k
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.binary()), pa.array(factors), pa.array(keys, pa.list_(pa.int64()))], names=[*b.schema.names, "code", "factor", "lanes"])

    added = [T.StructField("code", T.BinaryType()), T.StructField("factor", T.DoubleType()), T.StructField("lanes", T.ArrayType(T.LongType()))]
    return classes.mapInArrow(tidy(run), T.StructType([*classes.schema.fields, *added]))


def _candidates(g: np.ndarray, fresh, signs: np.ndarray, factors: np.ndarray, bound: np.ndarray, y: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of a bucket that ``fresh`` lets pass and whose estimate plus bound reaches the threshold; small buckets together,
    large ones by matrix."""
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    size = np.diff(np.r_[start, len(g)])
    after = np.repeat(start + size, size) - np.arange(len(g)) - 1
    after[np.repeat(size > 64, size)] = 0
    rows = np.flatnonzero(after)
    edges = np.searchsorted(np.cumsum(after[rows]), np.arange(0, after.sum() + 50_000, 50_000))
    for s, e in zip(edges[:-1], edges[1:] if len(edges) > 1 else []):
        part = rows[s:e] if e < edges[-1] else rows[s:]
        n = after[part]
        p = np.repeat(part, n)
        q = p + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ok = fresh(p, q)
        p, q = p[ok], q[ok]
        ok = np.einsum("ij,ij->i", signs[p], y[q]) / factors[p] + bound[p] >= threshold
        yield p[ok], q[ok]
    for at, n in zip(start[size > 64].tolist(), size[size > 64].tolist()):
        x = slice(at, at + n)
        p, q = np.nonzero(np.triu(signs[x] @ y[x].T / factors[x, None].astype(np.float32) + bound[x, None] >= threshold, 1))
        ok = fresh(p + at, q + at)
        yield p[ok] + at, q[ok] + at


def _compare(threshold: float, miss: float):
    """Compares the members of buckets; gives link counts by node, and edges that span each linked group.

    Stored codes and factors estimate each pair once, in the first lane it shares; exact products are made only where the
    estimate and its bound leave the pair open.
    """

    def linked(t: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        weight, g, band, block, factors = (t[c].to_numpy() for c in ("weight", "g", "band", "block", "factor"))
        same_block = t["i"].to_numpy() == t["j"].to_numpy()
        key = np.stack([t["id"].to_numpy(), t["h"].to_numpy()], axis=1)
        node = np.unique(key, axis=0, return_inverse=True)[1].ravel()
        of = np.zeros(node.max() + 1, np.int64)
        of[node] = np.arange(len(node))
        codes = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(len(node), -1)
        unit = _unit(t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(node), -1))
        y = (unit @ rotation(unit.shape[1]).T).astype(np.float32)
        bits = codes.shape[1] * 8
        signs = (np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(bits))
        bound = EPSILON * np.sqrt(np.maximum(0, 1 - factors**2)) / factors / np.sqrt(bits - 1)
        keys = _keys(codes, width, threshold, miss)

        def fresh(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            """Pairs of unlike nodes, of unlike blocks where two blocks meet, that no earlier lane has compared."""
            ok = (node[p] != node[q]) & (same_block[p] | (block[p] != block[q]))
            for k in range(int(band[p].max(initial=0))):
                ok &= (keys[p, k] != keys[q, k]) | (band[p] <= k)
            return ok

        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for p, q in _candidates(g, fresh, signs, factors, bound, y, threshold):
            for s in range(0, len(p), 65_536):
                a, b = p[s : s + 65_536], q[s : s + 65_536]
                ok = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
                xs.append(a[ok]), ys.append(b[ok])
        x, z = np.concatenate(xs), np.concatenate(ys)
        nodes, at = np.unique(node[np.concatenate([x, z])], return_inverse=True)
        n = np.bincount(at, weight[np.concatenate([z, x])], len(nodes)).astype(np.int64)
        s, e = at[: len(at) // 2], at[len(at) // 2 :]
        root = np.arange(len(nodes))
        while True:
            least, new = np.minimum(root[s], root[e]), root.copy()
            np.minimum.at(new, s, least), np.minimum.at(new, e, least)
            new = new[new]
            if (new == root).all():
                return key[of[nodes]], n, key[of[nodes[root]]]
            root = new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            dims, widths = t["dim"].to_numpy(), t["width"].to_numpy()
            for dim, width in sorted(set(zip(dims.tolist(), widths.tolist()))):
                mine, n, other = linked(t.filter(pa.array((dims == dim) & (widths == width))), width)
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in (mine[:, 0], mine[:, 1], n, other[:, 0], other[:, 1]))], names=["id", "h", "n", "other_id", "other_h"])

    return tidy(run)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, miss: float = MISS, block: int = BLOCK, fill: int = FILL) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors(vec_id, embedding, label)``.

    Rows link if their labels and lengths are equal and their cosine in double precision is at least ``threshold``. Equal
    vectors of a label collapse to one class with a weight, so copies make no pairs. The index: the rotated sign code of each
    class is stored once with its correction factor and cut into lanes; classes that share a lane meet in a bucket. A lane has
    16 bits, and more where a label has over ``fill`` x 65,536 classes of a length: so wide that about ``fill`` of them share
    one by chance, so work grows with the rows and not with their square. Wider lanes are more lanes (``lanes``). There the stored codes and factors estimate each pair: estimate plus bound below the threshold
    rejects it, the others are computed exactly, so no link is below it. Vectors travel in the type they came in. Buckets of
    more than ``block`` members are compared block by block, each pair of blocks in a task of its own; a pair that meets in
    several buckets counts in the first. Blocks give sums and spanning edges, not pairs: linking two blocks that are wholly
    near-duplicates costs block x block products, as the number of links is asked for.

    A pair at the threshold shares no lane with a probability of at most ``miss``; closer ones far less (at 0.98, 6.4 % of
    the bits differ: 14 lanes of 16 bits).
    Vectors that are null, zero or hold null or non-finite components link with nothing, as do those with null labels; rows
    of one vec_id with different vectors are vectors of their own, equal rows each count; rows with null vec_id give
    n_links 0 and a null component; an empty table gives none; extra columns are ignored.
    """
    finite = "embedding is not null and label is not null and vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label").withColumn("ok", F.coalesce(F.expr(f"{finite} and exists(embedding, x -> x <> 0)"), F.lit(False)))
    known = rows.select("vec_id", "ok", "label", F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"), "embedding")
    good, key = known.where("ok"), ["label", "dim", "h1", "h2"]
    counted = materialize(good.groupBy(*key).agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")).withColumn("h", F.xxhash64(*key)), "classes")
    wide = F.greatest(F.lit(LANE), F.least(F.lit(62), F.ceil(F.log2(F.count("*") / fill)).cast("int")))
    widths = counted.groupBy("label", "dim").agg(wide.alias("width"))
    chosen = good.select(*key, F.col("vec_id").alias("id"), F.col("embedding").alias("v")).join(counted, [*key, "id"]).dropDuplicates([*key, "id"]).join(widths, ["label", "dim"])
    coded = materialize(_codes(chosen.select("id", "h", "label", "dim", "width", "weight", "v"), threshold, miss), "codes")
    places, bucket = coded.select("id", "h", "label", "dim", F.posexplode("lanes").alias("band", "bucket")), ["label", "dim", "bucket", "band"]
    sizes = places.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.expr(f"cast((n + {block - 1}) div {block} as int)")).drop("n")
    member = materialize(places.join(sizes, bucket).withColumn("block", F.pmod(F.xxhash64("id", "h"), F.col("blocks")).cast("int")), "buckets")
    dealt = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("id", "h", *bucket, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    group = [*bucket, "i", "j"]
    pairs = dealt.join(coded.select("id", "h", "width", "weight", "v", "code", "factor"), ["id", "h"]).withColumn("g", F.xxhash64(*group)).select("id", "h", "weight", "v", "code", "factor", "g", "dim", "width", "band", "block", "i", "j")
    pairs = pairs.repartition("g").sortWithinPartitions("g", "id", "h")
    found = materialize(pairs.mapInArrow(_compare(threshold, miss), "id long, h long, n long, other_id long, other_h long"), "links")
    degree = found.groupBy("id", "h").agg(F.sum("n").alias("n"))
    comp = star_components(found.select(F.struct("id", "h").alias("a"), F.struct(F.col("other_id").alias("id"), F.col("other_h").alias("h")).alias("b")))
    roots = comp.select("node.id", "node.h", F.col("root.id").alias("root"))
    nodes = counted.join(degree, ["id", "h"], "left").join(roots, ["id", "h"], "left").select(*key, F.coalesce("n", F.lit(0)).alias("n"), "weight", F.coalesce("root", "id").alias("root"))
    ids = known.select("vec_id", "ok", *key)
    linked = ids.where("ok").join(nodes, key).select("vec_id", (F.col("n") + F.col("weight") - 1).alias("n_links"), F.col("root").alias("component_id"))
    alone = ids.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator on each vector and two copies bent by its id: by a third of the ids over the threshold's angle, else under it."""
    copy = F.explode(F.array(*map(F.lit, range(3)))).alias("k")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label", copy)
    bend = "k * case when vec_id % 3 = 2 then 0.25D else 0.046875D end"
    bent = F.expr(f"transform(embedding, (x, i) -> cast(x as double) * (1 + {bend} * ((i * 7 + vec_id) % 5 - 2)))")
    return near_duplicates(rows.select((F.col("vec_id") * 3 + F.col("k")).alias("vec_id"), bent.alias("embedding"), "label"))


def _sql(source: str) -> str:
    return f"""
WITH RECURSIVE every AS ({source}),
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM every WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(r.m, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(r.m, e.vec_id)) AS kept
FROM every e LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY 1) n ON n.x = e.vec_id LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY 1) r ON r.x = e.vec_id
"""


EMBEDDING_SQL = _sql("SELECT vec_id, embedding, label FROM embeddings")
LINKS_SQL = _sql("""
  SELECT (vec_id * 3 + k)::BIGINT AS vec_id, label, list_transform(range(len(embedding)), lambda i: embedding[i + 1]::DOUBLE
    * (1 + k * CASE WHEN vec_id % 3 = 2 THEN 0.25::DOUBLE ELSE 0.046875::DOUBLE END * ((i * 7 + vec_id) % 5 - 2))) AS embedding
  FROM embeddings CROSS JOIN range(3) AS copies(k)""")
