import zlib
from collections import Counter

from ragmill.llm.sharding import hilbert_shards, write_shards

SCHEMA = "doc_id long, text string, lang string, source string, shard string, h string"


def rows(n=500):
    return [(i, "é" * (i * 7 % 300), ["en", "de", "fr"][i % 3] if i % 11 else None, "hot" if i % 3 else f"s{i % 40}", "", "") for i in range(n)] + [(7, "x", "en", "hot", "", "")] * 3 + [(None, None, None, None, None, None)]


def hilbert(x, bits=5):
    """Place on the curve by walking it: three-dimensional curve as a transpose, written out per bit."""
    x = list(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(3):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in (1, 2):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[2] & q:
            t ^= q - 1
        q >>= 1
    return sum(((x[i] ^ t) >> j & 1) << (3 * j + 2 - i) for j in range(bits) for i in range(3))


def test_curve_is_continuous():
    at = {hilbert((a, b, c), 3): (a, b, c) for a in range(8) for b in range(8) for c in range(8)}
    assert sorted(at) == list(range(512))
    assert all(sum(abs(p - q) for p, q in zip(at[i], at[i + 1])) == 1 for i in range(511))


def brute(data, shards):
    s = lambda v: v or ""
    d0, d1 = sorted({s(r[2]) for r in data}), sorted({s(r[3]) for r in data})
    sizes = [len(s(r[1]).encode()) + 8 for r in data]
    classes = [int(f"{n:b}"[1:4], 2) + 8 * n.bit_length() for n in sizes]
    keyed, n = [], len(data)
    for r, size, b in zip(data, sizes, classes):
        x = (d0.index(s(r[2])) * 32 // len(d0), d1.index(s(r[3])) * 32 // len(d1), sum(o < b for o in classes) * 32 // n)
        crc = zlib.crc32(s(r[1]).encode())
        c = crc if r[0] is None else zlib.crc32(str(r[0]).encode())
        keyed.append((hilbert(x), s(r[2]), s(r[3]), b, c, -1 if r[0] is None else r[0], crc, size))
    out = []
    for k, r in enumerate(sorted(keyed)):
        shard = k * shards // n
        out.append((r[5], r[7], r[6], r[0], shard, k - -(-shard * n // shards)))
    return sorted(out)


def test_brute_force(spark):
    data = rows()
    for params in ({}, {"group_rows": 10}):
        got = hilbert_shards(spark.createDataFrame(data, SCHEMA), 24, **params).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32, r.h, r.shard, r.slot) for r in got) == brute(data, 24)
        n = Counter(r.shard for r in got)
        assert max(n.values()) - min(n.values()) <= 1 and all(sorted(r.slot for r in got if r.shard == s) == list(range(n[s])) for s in n)


def test_edges_and_files(spark, tmp_path):
    assert hilbert_shards(spark.createDataFrame([], SCHEMA)).count() == 0
    few = hilbert_shards(spark.createDataFrame(rows()[:3], SCHEMA)).collect()
    assert sorted(r.slot for r in few) == [0, 0, 0]
    docs = spark.createDataFrame(rows(200)[:200], SCHEMA).drop("shard")
    write_shards(docs, str(tmp_path / "out"), 6)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.select("shard").distinct().count() == 6


def test_written_rows_and_pruning(spark, tmp_path):
    """Null and shared ids are written; filters on a dim need few of the files by their statistics."""
    import pathlib

    import pyarrow.parquet as pq

    data = [(i % 300, "x" * (1 << i % 12), ["en", "de", "fr", "es"][i * 7 % 4], f"s{i * 13 % 32:02}", "", "") for i in range(2000)] + [(None, "a", "en", "s01", "", ""), (5, None, None, None, None, None)]
    docs = spark.createDataFrame(data, SCHEMA).drop("shard")
    write_shards(docs, str(tmp_path / "out"), 8, files=4)
    assert Counter((r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == Counter(r[:4] for r in data)
    stats = []
    for f in pathlib.Path(tmp_path, "out").rglob("*.parquet"):
        meta = pq.read_metadata(f)
        columns = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        stats.append({c: meta.row_group(0).column(columns[c]).statistics for c in ("lang", "source")})
    assert len(stats) > 20
    shares = []
    for column, values in (("lang", ("en", "de", "fr", "es")), ("source", ("s03", "s11", "s19", "s27"))):
        for value in values:
            hit = [s[column].has_min_max and s[column].min <= value <= s[column].max for s in stats]
            shares.append(sum(hit) / len(hit))
    assert min(shares) > 0 and sum(shares) / len(shares) <= 0.7, shares  # unsorted files would all be read


def test_filters_on_sizes_and_pairs_prune(spark):
    """Of 96 runs of the order, a filter on a size range alone opens a part, where a plain sort opens most; pairs open few."""
    import random

    rnd = random.Random(3)
    data = [(i, "x" * int(40 * 2 ** rnd.gauss(3, 1.5)), rnd.choice(["en"] * 5 + ["de", "fr", "es"]), "hot" if rnd.random() < 0.33 else f"s{rnd.randrange(20):02}", "", "") for i in range(6000)]
    got = hilbert_shards(spark.createDataFrame(data, SCHEMA), 96).select("doc_id", "shard").collect()
    meta = {r[0]: (r[2], r[3], len(r[1])) for r in data}
    curve = [[meta[r.doc_id] for r in got if r.shard == f] for f in range(96)]
    plain = sorted(meta.values())
    plain = [plain[f * 6000 // 96 : (f + 1) * 6000 // 96] for f in range(96)]
    sizes = sorted(m[2] for m in meta.values())
    eighths = [(sizes[k * 750], sizes[k * 750 + 749]) for k in range(8)]

    def opened(files, conds):
        hit = lambda f, c: all(min(m[i] for m in f) <= hi and lo <= max(m[i] for m in f) for i, (lo, hi) in c.items())
        return sum(hit(f, c) for f in files for c in conds) / len(files) / len(conds)

    by_size, langs, sources = [{2: e} for e in eighths], [(v, v) for v in ("en", "de", "fr", "es")], [(f"s{k:02}",) * 2 for k in range(20)]
    assert opened(curve, by_size) <= 0.4 < 0.6 <= opened(plain, by_size)
    assert opened(curve, [{0: v} for v in langs]) <= 0.4 and opened(curve, [{1: v} for v in sources]) <= 0.3
    assert opened(curve, [{0: v, 2: e} for v in langs for e in eighths]) <= 0.15 and opened(curve, [{1: v, 2: e} for v in sources for e in eighths]) <= 0.15


def test_many_values_of_a_dim(spark):
    data = [(None if i % 5 == 0 else i, f"t{i}", "en", f"http://host/{i * 37 % 1000}", "", "") for i in range(1000)]
    got = hilbert_shards(spark.createDataFrame(data, SCHEMA), 7, group_rows=3).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32, r.h, r.shard, r.slot) for r in got) == brute(data, 7)
