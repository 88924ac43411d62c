"""Banded neighbours against all pairs; merging of streamed memories against one candidate after another."""

import numpy as np

from ragmill.operators import near as N
from ragmill.plans import kept
from ragmill.streaming.memories import CANDIDATE, MemoryTable, memory_merge_stream

VECTOR = "user_id string, {} string, vector array<double>"


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def test_recall_in_a_hot_user(spark):
    rng = np.random.default_rng(1)
    base = unit(rng.standard_normal((3000, 24)))
    near = unit(base[:400] + 0.07 * rng.standard_normal((400, 24)))
    vectors = [("hot", f"m{i}", v.tolist()) for i, v in enumerate(base)] + [("small", f"s{i}", v.tolist()) for i, v in enumerate(base[:40])] + [("hot", "zero", [0.0] * 24), ("hot", "none", None), ("hot", "short", [1.0]), (None, "x", base[0].tolist())]
    queries = [("hot", f"q{i}", v.tolist()) for i, v in enumerate(near)] + [("small", f"t{i}", v.tolist()) for i, v in enumerate(near[:40])]
    q, v = spark.createDataFrame(queries, VECTOR.format("query_id")), spark.createDataFrame(vectors, VECTOR.format("chunk_id"))
    found, compared = N.near_within(q, v, "user_id", 0.88)
    got = {(r.query_id, r.chunk_id) for r in found.collect()}
    s = np.round(near @ base.T, 6)
    want = {(f"q{i}", f"m{j}") for i, j in zip(*np.nonzero(s >= 0.88))}
    small = {(f"t{i}", f"s{j}") for i, j in zip(*np.nonzero(s[:40, :40] >= 0.88))}
    assert small <= got and got <= want | small and len(want) > 300
    assert len(got & want) / len(want) >= 0.98
    assert compared.count() < 400 * 3000 * 0.6


def sequential(rows, least=0.88):
    kept = []
    for i, user, _, content, imp, conf, tags, v in sorted(rows, key=lambda r: (r[2], r[0])):
        if imp < 0.72 or conf < 0.65:
            continue
        v = np.array(v)
        best = max(((round(float(v @ m["v"] / (np.linalg.norm(v) * np.linalg.norm(m["v"]))), 6), m["id"], m) for m in kept if m["user"] == user), key=lambda x: x[:2], default=(0, "", None))
        if best[2] is not None and best[0] >= least:
            m = best[2]
            m |= {"imp": max(m["imp"], imp), "conf": max(m["conf"], conf), "tags": m["tags"] | set(tags)}
        else:
            kept.append({"id": i, "user": user, "content": content, "imp": imp, "conf": conf, "tags": set(tags), "v": v})
    return {(m["id"], m["user"], m["content"], m["imp"], m["conf"], tuple(sorted(m["tags"]))) for m in kept}


def made():
    rng = np.random.default_rng(5)
    centres = unit(rng.standard_normal((12, 16)))
    rows = []
    for i in range(96):
        c = centres[0] if i % 3 == 0 else centres[rng.integers(12)]
        v = c + rng.choice([0.0, 0.02, 0.12]) * rng.standard_normal(16)
        rows.append((f"c{i:03}", f"u{0 if i % 3 == 0 else i % 2}", i // 2, f"text {i}", 0.5 if i % 11 == 0 else 0.8 + i % 7 / 100, 0.7 + i % 5 / 100, [f"t{i % 4}"], v.tolist()))
    return rows


def rows_of(table):
    return {(r.memory_id, r.user_id, r.content, r.importance, r.confidence, tuple(r.tags)) for r in table.memories().collect()}


def test_any_split_gives_the_same_memories(spark, tmp_path):
    rows = made()
    want = sequential(rows)
    assert 10 < len(want) < 80
    for name, size in (("one", 96), ("three", 40)):
        table = MemoryTable(spark, f"file://{tmp_path}/{name}", bits=4, miss=1e-7, buckets=2, most=2)
        for n, at in enumerate(range(0, 96, size)):
            table.apply(spark.createDataFrame(rows[at : at + size], CANDIDATE), n)
        assert rows_of(table) == want
        table.apply(spark.createDataFrame([("zz", "u0", 999, "again", 0.9, 0.9, ["x"], [1.0] * 16)], CANDIDATE), n)
        assert rows_of(MemoryTable(spark, f"file://{tmp_path}/{name}", bits=4, miss=1e-7, buckets=2)) == want


def test_stream(spark, tmp_path):
    rows = [r for r in made()[:60]]
    src, root = str(tmp_path / "in"), f"file://{tmp_path}/table"
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, CANDIDATE).coalesce(1).write.mode("append").parquet(src)
        memory_merge_stream(spark.readStream.schema(CANDIDATE).parquet(src), root, str(tmp_path / "cp"), bits=4, miss=1e-7, buckets=2).awaitTermination()
    assert rows_of(MemoryTable(spark, root, bits=4, miss=1e-7, buckets=2)) == sequential(rows)


def test_vectors_without_direction(spark, tmp_path):
    table = MemoryTable(spark, f"file://{tmp_path}/t", bits=4, miss=1e-7, buckets=2)
    rows = [("a", "u", 1, "x", 0.9, 0.9, None, [0.0, 0.0]), ("b", "u", 2, "y", 0.9, 0.9, ["t"], [0.0, 0.0]), ("c", "u", 3, "z", 0.9, 0.9, ["t"], None), (None, "u", 3, "z", 0.9, 0.9, ["t"], [1.0, 0.0]), ("d", None, 3, "z", 0.9, 0.9, ["t"], [1.0, 0.0])]
    table.apply(spark.createDataFrame(rows, CANDIDATE), 0)
    assert {r[0] for r in rows_of(table)} == {"a", "b", "c"}
    table.apply(spark.createDataFrame([], CANDIDATE), 1)
    assert len(rows_of(table)) == 3


def test_clusters_give_the_exact_nearest(spark):
    rng = np.random.default_rng(9)
    centres = unit(rng.standard_normal((20, 12)))
    v = unit(centres[rng.integers(20, size=1500)] + 0.03 * rng.standard_normal((1500, 12)))
    q = unit(centres[rng.integers(20, size=60)] + 0.03 * rng.standard_normal((60, 12)))
    vectors = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, [0.0] * 12), (5001, None), (None, v[0].tolist()), (5002, [1.0, 2.0]), (5003, v[0].tolist())]
    queries = [(i, x.tolist()) for i, x in enumerate(q)] + [(900, [0.0] * 12), (901, None), (902, [1.0, 2.0])]
    df = spark.createDataFrame(vectors, "chunk_id long, vector array<double>")
    hits, opened = N.dense_clustered(spark.createDataFrame(queries, "query_id long, vector array<double>"), df, 5, 40)
    every = np.vstack([v, v[:1]])
    ids = [*range(1500), 5003]
    want = {}
    for i, x in enumerate(q):
        s = np.round(every @ x, 6)
        order = sorted(range(len(ids)), key=lambda j: (-s[j], ids[j]))[:5]
        want |= {(i, r + 1): ids[j] for r, j in enumerate(order)}
    got = {(r.query_id, r["rank"]): r.chunk_id for r in hits.collect()}
    assert {k: c for k, c in got.items() if k[0] < 900} == want
    assert {c for k, c in got.items() if k[0] >= 900} == {5002}
    n = len({r.cluster for r in opened.collect()})
    assert opened.where("query_id < 900").count() < 0.5 * 60 * n
    assert N.dense_clustered(spark.createDataFrame([], "query_id long, vector array<double>"), df, 5, 40)[0].count() == 0
    assert N.dense_clustered(spark.createDataFrame(queries, "query_id long, vector array<double>"), df.limit(0), 5, 40)[0].count() == 0


def embeddings(spark, tmp_path, vectors, labels):
    rows = [(i, label, [float(x) for x in v]) for i, (v, label) in enumerate(zip(vectors.astype(np.float32), labels))]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    return np.array([r[2] for r in rows])


def test_near_copies_are_all_found(spark, tmp_path):
    v = embeddings(spark, tmp_path, unit(np.random.default_rng(3).standard_normal((1500, 6))), [0] * 1500)
    copies = v + ((np.arange(6)[None] + np.arange(1500)[:, None]) % 3 - 1) * kept.SHIFT
    s = np.round(unit(copies) @ unit(v).T, 6)
    want = {(int(i) + kept.COPY, int(j), s[i, j]) for i, j in zip(*np.nonzero(s >= 0.88))}
    got = {(r.query_id, r.chunk_id, r.score) for r in kept.near_copies(spark, str(tmp_path)).collect()}
    assert len(want) > 10_000 and got == want


def test_streamed_copies_merge_into_near_memories(spark, tmp_path):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((12, 64))
    v = embeddings(spark, tmp_path, unit(np.vstack([base, base + 0.1 * rng.standard_normal((12, 64))])), [i % 2 for i in range(12)] * 2)
    copies = v + ((np.arange(64)[None] + np.arange(24)[:, None]) % 3 - 1) * kept.SHIFT
    s = np.round(unit(copies) @ unit(v).T, 6)
    s[np.arange(24)[:, None] % 12 % 2 != np.arange(24)[None] % 12 % 2] = -1
    want = {str(i): [i] for i in range(24)}
    for i in range(24):
        want[max((s[i, j], str(j)) for j in range(24))[1]].append(i + kept.COPY)
    got = {r.memory_id: (r.importance, r.confidence, r.tags) for r in kept.streamed_memories(spark, str(tmp_path)).collect()}
    assert got == {m: (round(max(0.75 + i % 5 / 20 for i in own), 6), round(max(0.7 + i % 3 / 10 for i in own), 6), ",".join(sorted({f"t{i % 4}" for i in own}))) for m, own in want.items()}
