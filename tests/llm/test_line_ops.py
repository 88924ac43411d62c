import random

from ragmill.llm.linededup import drop_repeated_runs
from ragmill.llm.substring import dedup

SCHEMA = "doc_id long, text string, n_lines string, start string, h string"


def rows(seed=1, n=60):
    rnd = random.Random(seed)
    lines = [" ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 4) for _ in range(rnd.choice([1, 2, 9, 12]))) + rnd.choice(["", ".", "! x y z a b c d e f g."]) for _ in range(40)]
    blocks = [[rnd.choice(lines) for _ in range(rnd.choice([2, 3, 5]))] for _ in range(8)]
    out = []
    for i in range(n):
        body = []
        for _ in range(rnd.randrange(0, 5)):
            body += rnd.choice(blocks) if rnd.random() < 0.6 else [rnd.choice(lines)]
        out.append((i, "\n".join(body)))
    return out + [(900, None), (901, ""), (902, "\n\n\n"), (903, "same\n" * 3000), (904, " SAME \n" * 5)]


def frame(spark, data):
    return spark.createDataFrame([(i, t, "", "", "") for i, t in data], SCHEMA)


def brute_runs(data, w=3, words=50):
    seen, gone = {}, set()
    rows = sorted(((i, k, t) for k, (i, t) in enumerate(data) if t is not None), key=lambda r: (r[0], r[1]))
    for i, k, t in rows:
        ls = [x.strip(" ").lower() for x in t.split("\n")]
        for p in range(len(ls)):
            for size in range(1, min(w, len(ls) - p) + 1):
                run = tuple(ls[p : p + size])
                enough = sum(x.count(" ") + 1 for x in run) >= words
                if size == w or enough or size == len(ls):
                    key = (run, size == w or enough)
                    if seen.setdefault(key, (i, t, p)) != (i, t, p):
                        gone |= {(k, q) for q in range(p, p + size)}
    return [(i, t if t is None else "\n".join(x for q, x in enumerate(t.split("\n")) if (k, q) not in gone)) for k, (i, t) in enumerate(data)]


def test_runs_equal_brute_force(spark):
    for seed in (1, 2):
        data = rows(seed)
        got = {r.doc_id: (r.text, r.n_lines, r.n_deleted) for r in drop_repeated_runs(frame(spark, data)).collect()}
        assert {i: g[0] for i, g in got.items()} == dict(brute_runs(data))
        for i, t in data:
            n = 0 if t is None else len(t.split("\n"))
            assert got[i][1] == n and got[i][2] <= n


def test_long_document_and_edges(spark):
    data = [(1, "\n".join(f"line {i % 5000}" for i in range(60_000))), (1, "b"), (None, "b"), (3, None)]
    got = drop_repeated_runs(frame(spark, data)).collect()
    assert len(got) == 4 and max(r.n_deleted for r in got) == 55_000
    assert drop_repeated_runs(frame(spark, [])).count() == 0


def test_rows_of_one_id(spark):
    data = [(1, "a\nb\nc"), (3, "a\nb\nc"), (3, "a\nb\nc"), (3, "x\ny\nz\nw")]
    got = sorted((r.doc_id, r.text, r.n_deleted) for r in drop_repeated_runs(frame(spark, data)).collect())
    assert got == [(1, "a\nb\nc", 0), (3, "", 3), (3, "", 3), (3, "x\ny\nz\nw", 0)]
    clash = spark.createDataFrame([(1, "a\nb\nc", 1, "x", 2), (2, "a\nb\nc", 3, "y", 4)], "doc_id long, text string, _starts int, pos string, d int")
    assert [(r._starts, r.pos, r.d, r.n_deleted) for r in drop_repeated_runs(clash).orderBy("doc_id").collect()] == [(1, "x", 2, 0), (3, "y", 4, 3)]


def test_long_lines_are_runs(spark):
    long = " ".join(f"w{i}" for i in range(60))
    half = [" ".join(f"{c}{i}" for i in range(30)) for c in "ab"]
    data = [(1, f"one\n{long}\ntwo\n{half[0]}\n{half[1]}\nthree"), (2, long), (3, f"four\n{half[0]}\n{half[1]}\nfive"), (4, half[0]), (5, half[0]), (6, f"{half[0]}\nx")]
    got = {r.doc_id: r.text for r in drop_repeated_runs(frame(spark, data)).collect()}
    assert got == dict(brute_runs(data))
    assert got[2] == "" and got[3] == "four\nfive" and got[4] == half[0] and got[5] == "" and got[6] == f"{half[0]}\nx"


def test_long_document_in_linear_time(spark):
    import time

    text = "\n".join(f"line number {i}" for i in range(100_000))
    data = [(1, text), (2, f"{text[:40]}\nother\n{text[50:]}")]
    began = time.time()
    got = {r.doc_id: r.n_deleted for r in drop_repeated_runs(frame(spark, data)).collect()}
    assert got[1] == 0 and 99_990 < got[2] < 100_000 and time.time() - began < 60


def brute_units(data, m=20):
    import re

    out, seen, cut = [], {}, set()
    rows = sorted(((i, k, t) for k, (i, t) in enumerate(data) if t), key=lambda r: (r[0], r[1]))
    for i, k, t in rows:
        at, sents = 0, []
        for s in re.findall(r"[^.!?\n]*[.!?]*[ \t]*\n?", t):
            if s.strip(" \t\n"):
                sents.append((at, at + len(s), re.sub(r"[ \t\n]+", " ", s).strip(" ").lower()))
            at += len(s)
        for a in range(len(sents)):
            for b in range(a + 1, len(sents) + 1):
                words = sum(x[2].count(" ") + 1 for x in sents[a:b])
                if words >= m:
                    here = (i, t, sents[a][0])
                    if seen.setdefault(tuple(x[2] for x in sents[a:b]), here) != here:
                        cut |= {(k, c) for c in range(sents[a][0], sents[b - 1][1])}
                if words >= 3 * m:
                    break
    for k, (i, t) in enumerate(data):
        out.append((i, t if t is None else "".join(c for j, c in enumerate(t) if (k, j) not in cut)))
    return out


def test_units_equal_brute_force(spark):
    for seed in (1, 2):
        data = rows(seed)
        got = dedup(frame(spark, data)).collect()
        assert {r.doc_id: r.text for r in got} == dict(brute_units(data))
        texts = dict(data)
        for r in got:
            spans = [tuple(map(int, s.split("-"))) for s in r.removed.split(",") if s]
            assert len(spans) == r.n_removed
            if texts[r.doc_id]:
                assert len(texts[r.doc_id]) - sum(e - s for s, e in spans) == len(r.text)


def test_unit_edges(spark):
    passage = " ".join(f"word{i}" for i in range(60)) + "."
    data = [(1, f"one. {passage} two"), (2, f"three\n{passage}\nfour"), (3, "clean text"), (3, "clean text"), (None, passage), (4, None), (5, "x " * 200_000)]
    got = sorted((r.doc_id or 0, r.text or "", r.n_removed) for r in dedup(frame(spark, data)).collect())
    assert got[0] == (0, passage, 0) and got[1][2] == 0 and got[2] == (2, "three\nfour", 1) and got[3] == got[4] == (3, "clean text", 0)
    assert dedup(frame(spark, [])).count() == 0


def test_units_of_one_id_and_of_short_lines(spark):
    p, q = "A line of words. " * 8, "no other row has this text. " * 3
    short = "\n".join(f"short line {i} of six words" for i in range(10))
    data = [(1, p), (3, p), (3, q), (4, f"Intro one.\n{short}\nend"), (5, f"Another.\n{short}\nfinish")]
    got = sorted((r.doc_id, r.text) for r in dedup(frame(spark, data)).collect())
    assert got == sorted(brute_units(data))
    assert ("A line" not in got[1][1]) and (3, q) in got and got[4][1] == "Another.\nfinish"
