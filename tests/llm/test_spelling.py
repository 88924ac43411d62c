import random
import re
import zlib
from collections import Counter

from ragmill.llm import spelling
from ragmill.llm.spelling import Grams, count_runs, near_words, op11_spelling, spelling_groups


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def brute_counts(docs):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return n


def brute(docs, min_count=5):
    n = {w: k for w, k in brute_counts(docs).items() if len(w) >= 6 and k >= min_count}
    near = {w: [] for w in n}
    rest = {}
    for w in n:
        for i in range(len(w)):
            rest.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    for w in n:
        may = {x for i in range(len(w)) for x in rest[w[:i] + w[i + 1 :]]} | {w[:i] + w[i + 1 :] for i in range(len(w))} | rest.get(w, set())
        near[w] = [x for x in may if x in n and one_edit(w, x)]
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def rows_of(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def test_registered_query(spark):
    d = "/root/testdata/sf0.001"
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()])
    assert rows_of(op11_spelling(spark, d)) == want and len(want) > 100


def test_affected_grams_leave_a_merged_list():
    """A word merges a list of each word within an edit, under any dictionary, also where grams are cut at the word's end."""
    rng = random.Random(5)
    for _ in range(4000):
        size = rng.randint(5, 12)
        word = "".join(rng.choice("abé") for _ in range(size))
        i, c = rng.randrange(size), rng.choice("abéx")
        frequent = frozenset("".join(rng.choice("abé") for _ in range(2)) for _ in range(rng.choice([0, 3, 9, 40])))
        for other in (word[:i] + c + word[i + 1 :], word[:i] + c + word[i:], word + c):
            assert other == word or Grams(word, frequent).merged() & Grams(other, frequent).listed(), (word, other, frequent)


def test_near_words_equal_brute_force(spark):
    rng = random.Random(7)
    words = {"".join(rng.choice("abcdé") for _ in range(rng.choice([6, 6, 7, 8, 30]))) for _ in range(300)}
    words |= {w[:3] + rng.choice("abcx") + w[4:] for w in words} | {w + "a" for w in list(words)[:100]} | {"z" * 3_000, "z" * 3_001}
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    want = {(a, b) for a in words for b in words if abs(len(a) - len(b)) < 2 and one_edit(a, b)}
    for share in (0.001, 0.05):
        got = near_words(df, share).select("word", "other").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_chain_of_forms(spark):
    docs = [(3, "abcdef " * 5 + "abcdeg " * 25 + "abcdegh " * 125 + "abcdxgh " * 625)]
    got = rows_of(spelling_groups(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == brute(docs) and ("abcdef", "abcdeg", "abcdxgh", 5, 1, 25) in got


def test_pieces_of_long_texts(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("abÉ× -İſ") for _ in range(5000)) + "x" * 500
    want = {w: n for w, n in brute_counts([(9, text)]).items() if len(w) >= 6}
    for piece in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(spelling, "PIECE", piece)
        counts = Counter()
        count_runs("9:", text, counts)
        assert counts == want


def test_edges(spark):
    text = "Straße naïve×es " * 6 + "ÀÈÌÒÙÝ " * 5 + "naïvexes " * 30
    docs = [(1, text, 1), (1, text, 1), (None, "naïvexes " * 5, 2), (2, None, 3), (3, "", 4)]
    df = spark.createDataFrame(docs, "doc_id long, text string, word int").withColumnRenamed("word", "n")
    assert rows_of(spelling_groups(df)) == brute([d[:2] for d in docs])
    assert spelling_groups(df.limit(0)).count() == 0
