import random

import corpus_pipeline
from ragmill.llm import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    """Smallest doc_id of each component of five-word-shingle Jaccard 0.8 or more, over all pairs."""
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [r[0] for i, r in enumerate(rows) if find(i) == i]


def sample(seed):
    rnd = random.Random(seed)
    words = [f"w{i}é" for i in range(300)]
    line = [rnd.choice(words) for _ in range(12)]
    rows = [[rnd.choice(words) for _ in range(rnd.choice([1, 3, 5, 30, 120, 200]))] for _ in range(60)]
    for _ in range(140):
        t = list(rnd.choice(rows))
        for _ in range(rnd.randrange(6)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        if rnd.random() < 0.3:
            at = rnd.randrange(len(t) + 1)
            t[at:at] = line
        rows.append(t)
    return [(i, " ".join(t).upper() if rnd.random() < 0.1 else "\t".join(t)) for i, t in enumerate(rows)] + [(900, None), (901, ""), (902, " \n")]


def test_stage_equals_brute_jaccard(spark, monkeypatch):
    for seed, common in ((1, 8), (2, 0)):
        monkeypatch.setattr(shingles, "COMMON", common)
        monkeypatch.setattr(shingles, "SAMPLE", 2)
        rows = sample(seed)
        docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], SCHEMA)
        out = corpus_pipeline.near_dedup(spark, docs, "")
        assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == brute(rows)


def test_tables_by_brute_jaccard(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == brute(rows)


def test_many_near_copies_in_blocks(spark, monkeypatch):
    """Copies of one text that are mostly under 0.8 to each other meet at common shingles, in several blocks."""
    monkeypatch.setattr(shingles, "BLOCK", 8)
    monkeypatch.setattr(shingles, "COMMON", 10**6)
    rnd = random.Random(5)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(90):
        t = list(base)
        for _ in range(rnd.choice([1, 1, 2, 3])):
            t[rnd.randrange(60)] = f"x{rnd.randrange(1000)}"
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == brute(rows)


def sets_of(rows):
    return list({shingles.shingle_set(t).tobytes(): shingles.shingle_set(t) for _, t in rows}.values())


def brute_close(sets):
    """Pairs of sets, by name, whose fingerprints differ in 4 bits or fewer, of each fingerprint's first and of it with its others; those of Jaccard 0.8 or more."""
    nodes = sorted((shingles._node(h), h, sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h.view("u8")) > len(h))) for h in sets)
    first = {}
    for x in nodes:
        first.setdefault(x[2], x[0])
    pairs = [(x, y) for x in nodes for y in nodes if x[0] < y[0] and (x[2] ^ y[2]).bit_count() <= 4]
    pairs = [(x, y) for x, y in pairs if x[0] == first[x[2]] and (x[2] == y[2] or y[0] == first[y[2]])]
    like = [(x, y) for x, y in pairs if 9 * len(set(x[1].tolist()) & set(y[1].tolist())) >= 4 * (len(x[1]) + len(y[1]))]
    return {(x[0], y[0]) for x, y in pairs}, {(x[0], y[0]) for x, y in like}


def test_simhash_links_without_prefixes(spark):
    """Where no prefix finds a pair, the fingerprints do: their pairs are those within 4 bits, verified by the sets."""
    rnd = random.Random(11)
    rows = [(i, " ".join(rnd.choice("abcdefgh") * 3 + str(rnd.randrange(50)) for _ in range(rnd.choice([5, 7, 400])))) for i in range(40)]
    for i in range(40, 120):
        t = rows[rnd.randrange(40)][1].split()
        t[rnd.randrange(len(t))] = "x"
        rows.append((i, " ".join(t)))
    rows += [(900, None), (901, "")]
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], SCHEMA)
    marks = corpus_pipeline.materialize(shingles.shingle_marks(docs), "marks")
    nodes = corpus_pipeline.materialize(marks.dropDuplicates(["node"]).withColumnRenamed("doc_id", "rep"), "nodes")
    close, like = brute_close(sets_of(rows))
    assert {(r.a, r.b) for r in shingles.close_pairs(nodes).collect()} == close and len(like) > 20
    none = marks.select("node", "n", shingles.F.lit(b"").alias("prefix"))
    assert {(r.a, r.b) for r in shingles.similar_links(docs, none, nodes).collect()} == like


def test_stage_uses_simhash_pairs(spark, monkeypatch):
    """The stage takes the pairs of SimHash first; what fingerprints miss is still found."""
    seen, close_pairs = [], shingles.close_pairs
    monkeypatch.setattr(shingles, "close_pairs", lambda *a: seen.append(close_pairs(*a)) or seen[-1])
    rows = sample(1)
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == brute(rows)
    close, like = brute_close(sets_of(rows))
    assert len(seen) == 1 and {(r.a, r.b) for r in seen[0].collect()} == close and like
