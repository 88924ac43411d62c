import random

import xxhash
from pyspark.sql import functions as F

from ragmill.llm.simhash import fingerprint, keep_first, links, near_duplicates

SCHEMA = "doc_id long, text string, fp string, component_id string"


def brute_fp(text):
    out, word = [], ""
    for ch in (text or "") + " ":
        if ch in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += ch.lower() if "A" <= ch <= "Z" else ch
    if not out:
        return 0
    sh = [" ".join(out[i : i + 4]) for i in range(max(1, len(out) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [brute_fp(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        best[find(i)] = min(best.get(find(i), r[0]), r[0])
    return sorted((r[0], fps[i], best[find(i)]) for i, r in enumerate(rows))


def sample():
    rnd = random.Random(3)
    words = [f"w{i}é" for i in range(200)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 3, 5, 60])))) for i in range(60)]
    for i in range(60, 160):
        t = rows[rnd.randrange(60)][1].split()
        if rnd.random() < 0.7:
            t[rnd.randrange(len(t))] = rnd.choice(words)
        rows.append((i, "\t".join(t).upper() if rnd.random() < 0.2 else " ".join(t)))
    return rows + [(500, None), (501, ""), (502, " \n"), (503, " "), (504, "a " * 40_000)]


def got(df):
    return sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in df.collect())


def test_components_equal_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    want = brute(rows)
    assert got(near_duplicates(df)) == want
    assert got(near_duplicates(df, heavy=1)) == want
    assert sorted(r.doc_id for r in keep_first(df).collect()) == sorted({c for _, _, c in want})


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(df).count() == 0
    df = spark.createDataFrame([(7, "a b", "", ""), (7, "a b", "", ""), (None, "a b", "", "")], SCHEMA)
    assert [r.component_id for r in near_duplicates(df).collect()] == [7, 7, 7]


def test_chunks():
    text = " ".join(str(i % 977) for i in range(100_000))
    assert fingerprint(text) & (2**64 - 1) == brute_fp(text)


def test_balls_are_never_broadcast(spark):
    fps = spark.range(300).select(F.xxhash64("id").alias("fp"))
    for heavy in (2048, 0):
        plan = links(fps, heavy=heavy)._jdf.queryExecution().sparkPlan().toString()
        joins = [x for x in plan.split("\n") if "Join" in x and "Inner" in x]
        assert joins and all("SortMergeJoin" in x for x in joins)
