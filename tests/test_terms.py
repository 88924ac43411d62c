"""Term tables against Python's own search, and synonyms as a table against those in the plan."""

import random

from ragmill.operators import retrieve as R
from ragmill.operators import terms as T


def brute(docs, terms):
    out = []
    for i, t in docs:
        for w in terms:
            at = (t or "").find(w)
            while at >= 0:
                out.append((i, at, w))
                at = t.find(w, at + 1)
    return sorted(out, key=str)


def test_all_places(spark, monkeypatch):
    rng = random.Random(2)
    docs = [(i, "".join(rng.choice("abé火\n ") for _ in range(rng.randint(0, 80)))) for i in range(40)] + [(None, "ab"), (7, None), (7, ""), (7, "aaaa"), (7, "aaaa")]
    terms = {"".join(rng.choice("abé火 ") for _ in range(rng.randint(1, 4))) for _ in range(60)} | {"aa"}
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame([(w,) for w in [*terms, "aa", None, ""]], "term string")
    want = brute(docs, terms)
    for chars in (4_000_000, 40):
        assert sorted(map(tuple, T.find_terms(d, t, block_chars=chars).collect()), key=str) == want
    first = {}
    for i, at, w in brute(docs, terms):
        if i not in (7, None):
            first[i, w] = min(at, first.get((i, w), at))
    assert {(r.doc_id, r.term): r.pos for r in T.find_terms(d, t, first=True).collect() if r.doc_id not in (7, None)} == first
    assert T.find_terms(d, t.limit(0)).count() == 0 and T.find_terms(d.limit(0), t).count() == 0


def test_pieces_overlap(monkeypatch):
    monkeypatch.setattr(T, "PIECE", 5)
    auto = T.ahocorasick.Automaton()
    for w in ("abc", "c", "bcabca"):
        auto.add_word(w, w)
    auto.make_automaton()
    text = "abcabcabcab" * 3
    assert sorted(T._places(auto, text, 6)) == sorted((a, w) for _, a, w in brute([(0, text)], ["abc", "c", "bcabca"]))


def test_a_hundred_thousand_terms(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rng = random.Random(3)
    every = list(texts.values())
    terms = set()
    while len(terms) < 100_000:
        t = rng.choice(every)
        at = rng.randrange(max(len(t) - 12, 1))
        terms.add(t[at : at + rng.choice([8, 12])] + rng.choice(["", "", "#"]))
    got = {(r.doc_id, r.term) for r in T.find_terms(docs, spark.createDataFrame([(t,) for t in terms], "term string"), first=True).collect()}
    want = {(i, t[a : a + n]) for i, t in texts.items() for n in {len(w) for w in terms} for a in range(len(t) - n + 1) if t[a : a + n] in terms}
    assert got == want and len(got) > 50_000


def test_synonyms_as_a_table(spark):
    texts = ["请问火灾烟气吗", "烟雾 疏散 检测", "abc", "", None, "火灾火灾 预警", "隧道排烟标准，森林风险"]
    q = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    want = sorted(map(tuple, R.rewrite(q).collect()))
    assert sorted(map(tuple, R.rewrite_by_table(q, T.synonym_table(spark, R.SYNONYMS)).collect())) == want and len(want) > 20
