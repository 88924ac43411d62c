import hashlib
import random
import re
import zlib

import numpy as np

from ragmill.llm.prefixtrie import Slots, op12_prefixtrie, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            t = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(c, []).append((turn is not None, turn or 0, role, t, text))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built = own.get(c - c % 20, [])[:h] + turns[h:]
        for d in range(len(built) + 1):
            nodes.setdefault(tuple(built[:d]), []).append((c, d == len(built)))
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        kids = children.get(p, [])
        leaves[p] = sum(leaves[k] for k in kids) or 1
        saved[p] = sum(saved[k] for k in kids) + ((len(nodes[p]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0)
    low = {p: min(m)[0] for p, m in nodes.items()}
    sha = lambda m: hashlib.sha256(",".join(map(str, sorted(c for c, end in m if end))).encode()).hexdigest()
    return sorted((low[p], len(p), low[p[:-1]] if p else -1, len(m), len(children.get(p, [])), leaves[p], saved[p], sha(m)) for p, m in nodes.items())


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *(r[f] for f in FIELDS[3:])) for r in df.collect())


def test_registered_query(spark):
    d = "/root/testdata/sf0.001"
    assert rows_of(op12_prefixtrie(spark, d)) == brute([tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select(*(x.split()[0] for x in SCHEMA.split(", "))).collect()])


def made(seed=1, n=400):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 1500), n):
        size = rng.choice([1, 1, 2, 3, 5, 9])
        hot = rng.random() < 0.4
        rows += [(c, t, rng.choice("ua") if not hot else "u", " ".join(["w"] * (t % 4)) if hot else rng.choice(["x", "y  z", "", "ü\x0bq"])) for t in range(size)]
    return rows + [(3000, t, "u", f"t {t}") for t in range(700)] + [(3001, t, "u", f"t {t}") for t in range(650)]


def test_shards_of_any_size_agree_with_brute_force(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows)
    for shard_rows in (1 << 16, 200):
        got = rows_of(prefix_trie(df, shard_rows=shard_rows))
        assert got == want, shard_rows


def test_many_conversations_end_at_one_node(spark):
    rows = [(c, 0, "u", "same") for c in range(0, 30000, 3)]
    assert rows_of(prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_edges(spark):
    rows = [(5, None, None, None), (5, 1, "u", ""), (5, 1, "u", ""), (5, 1, "a", "b"), (None, 0, "u", "x"), (7, 0, "", None), (-3, 0, "u", "neg"), (-40, 0, "u", "base"), (-41, 2, "u", "q"), (20, 0, "u", "w" * 300_000 + " v"), (21, 0, "u", "w"), (22, 0, "u", "r"), (23, 0, "u", "s"), (24, 0, "u", "s")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", depth long, k1 long")
    # ids of other signs have a base towards zero, as c % 20 has the sign of c
    want = [r for r in rows if r[0] is None or r[0] >= 0]
    assert rows_of(prefix_trie(df.where("conv_id is null or conv_id >= 0"))) == brute(want)
    assert {r.n_convs for r in prefix_trie(df).where("depth = 0").collect()} == {10}
    assert prefix_trie(df.limit(0)).count() == 0


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5000):
        k1, k2 = rng.integers(-(2**63), 2**63, n), rng.integers(0, 3, n)
        slots = Slots(k1, k2)
        assert sorted(slots.find(k1, k2).tolist()) == list(range(n))
        assert (slots.find(k1 + 1, k2) == -1).all() and (slots.find(k1, k2 + 5) == -1).all()
