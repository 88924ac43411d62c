import numpy as np

from ragmill.llm.embedding import MISS, encode, estimate, lanes, near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, weight string, node string"


def sample(seed=1, n=300, dim=64):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    rows = [(i, base[i].astype(np.float32), int(i % 3)) for i in range(n)]
    for i in range(n, n + 300):
        j = int(rng.integers(n)) if i % 2 else 7
        v = base[j] / np.linalg.norm(base[j])
        noise = rng.standard_normal(dim)
        noise -= noise @ v * v
        angle = rng.choice([0, 0.05, 0.15, 0.19, 0.21, 0.3])
        v = (np.cos(angle) * v + np.sin(angle) * noise / np.linalg.norm(noise)) * rng.choice([1, 3])
        rows.append((i, v.astype(np.float32), int(j % 3)))
    return rows


def brute(rows, t=0.98):
    out = {}
    root = {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for lab in {r[2] for r in rows}:
        ids = [r[0] for r in rows if r[2] == lab]
        x = np.array([r[1] for r in rows if r[2] == lab], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        ok = x @ x.T >= t
        np.fill_diagonal(ok, False)
        for a, i in enumerate(ids):
            out[i] = int(ok[a].sum())
            for b in np.flatnonzero(ok[a]):
                p, q = sorted((find(i), find(ids[b])))
                root[q] = p
    return {i: (n, find(i), find(i) == i) for i, n in out.items()}


def run(spark, rows, **params):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, "", "") for i, v, lab in rows], SCHEMA)
    return near_duplicates(df, **params).collect()


def test_recall_and_precision(spark):
    rows = sample()
    want = brute(rows)
    for params in ({}, {"block": 16}):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in run(spark, rows, **params)}
        assert got.keys() == want.keys() and all(got[i][0] <= want[i][0] for i in want)
        assert sum(g[0] for g in got.values()) >= 0.98 * sum(w[0] for w in want.values())
        assert sum(got[i][1] == want[i][1] for i in want) >= 0.98 * len(want)
        assert all(g[2] == (i == g[1]) for i, g in got.items())


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    est, bound = estimate(*encode(x), x)
    off = ~np.eye(400, dtype=bool)
    error = est - x @ x.T
    assert abs(error[off].mean()) < 2e-3 and (np.abs(error) <= bound[:, None]).mean() > 0.999


def test_edges(spark):
    one = [1.0, 0.0, 2.0]
    rows = [(1, one, 1), (2, one, 1), (2, one, 1), (3, one, None), (4, None, 1), (5, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 2.0], 1), (7, [1.0, float("nan"), 2.0], 1), (8, [1.0, float("inf"), 2.0], 1), (9, [1.0, 0.0], 1), (10, one, 2), (11, [2.0, 0.0, 4.0], 1), (None, one, 1), (12, [], 1)]
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id, r.kept) for r in run(spark, rows))
    assert got[:5] == [(-1, 0, None, False), (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 0, 3, True)]
    assert (11, 3, 1, False) in got and all((i, 0, i, True) in got for i in (4, 5, 6, 7, 8, 9, 10, 12))
    assert run(spark, []) == []


def test_vectors_of_one_id(spark):
    a, b = [1.0, 0.0, 0.0, 0.2], [0.0, 1.0, 0.3, 0.0]
    rows = [(5, a, 1), (5, b, 1), (6, [0.0, 1.0, 0.31, 0.0], 1), (7, [1.0, 0.0, 0.0, 0.21], 1), (8, [0.0, 0.0, 1.0, -1.0], 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in run(spark, rows))
    assert got == [(5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False), (8, 0, 8, True)]


def test_lanes_follow_the_number_of_rows(spark):
    assert lanes(256, 16, 0.98).shape == (14, 16)
    for width in (16, 19, 24, 30):
        x = lanes(256, width, 0.98)
        assert all(len(set(r)) == width for r in x.tolist())
        rng = np.random.default_rng(width)
        differ = rng.random((20_000, 256)) < np.arccos(0.98) / np.pi
        assert differ[:, x].any(axis=2).all(axis=1).mean() < 2 * MISS
    rows = sample(seed=5)
    want = brute(rows)
    for fill in (1e-3, 1e-4):  # as if labels held thousands of times as many rows: lanes of 18 and 21 bits
        got = {r.vec_id: (r.n_links, r.component_id) for r in run(spark, rows, fill=fill, block=32)}
        assert all(got[i][0] <= want[i][0] for i in want)
        assert sum(g[0] for g in got.values()) >= 0.98 * sum(w[0] for w in want.values())


def test_recall_on_many_links(spark):
    rng = np.random.default_rng(8)
    centre = np.repeat(rng.standard_normal((60, 64)), 60, axis=0)
    x = centre / np.linalg.norm(centre, axis=1, keepdims=True) + rng.standard_normal((3600, 64)) * 0.0125
    rows = [(i, v, 0) for i, v in enumerate(x)]
    want = brute([(i, np.float32(v), lab) for i, v, lab in rows])
    got = {r.vec_id: r.n_links for r in run(spark, [(i, np.float32(v), lab) for i, v, lab in rows])}
    links = sum(w[0] for w in want.values()) // 2
    assert links >= 50_000 and all(got[i] <= want[i][0] for i in want) and sum(got.values()) // 2 >= 0.99 * links
