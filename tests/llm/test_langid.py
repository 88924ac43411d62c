from collections import Counter

from ragmill.llm.langid import identify, ngrams, op10_langid, predict, profiles

DIR = "/root/testdata/sf0.001"


def brute_grams(text):
    out = Counter()
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        w = f"\x01{word}\x01"
        out.update(word)
        out.update(w[i : i + 2] for i in range(len(w) - 1))
        out.update(w[i : i + 3] for i in range(len(w) - 2))
    return out


def decode(g):
    s = ""
    while g:
        s, g = chr(g & 0x1FFFFF) + s, g >> 21
    return s


def test_ngrams():
    for text in (None, "", "12 .", "a", "Ab ab, été 語言 𐐀x", "  x  "):
        g, n = ngrams(text)
        assert {decode(int(a)): int(b) for a, b in zip(g, n)} == dict(brute_grams(text))


def test_brute_force_and_accuracy(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = docs.collect()
    import zlib

    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows}
    prof = {}
    for r in rows:
        if not held[r.doc_id]:
            prof.setdefault(r.lang, Counter()).update(brute_grams(r.text))
    order = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:300]]
    prof = {k: {g: i for i, g in enumerate(order(c))} for k, c in prof.items()}
    got = {r.doc_id: r for r in op10_langid(spark, DIR).collect()}
    assert len(got) == len(rows)
    for r in rows:
        mine = order(brute_grams(r.text))
        assert got[r.doc_id].held_out == held[r.doc_id]
        if not mine:
            assert got[r.doc_id].lang_pred == "und"
            continue
        d = {k: sum(abs(p[g] - i) if g in p else 300 for i, g in enumerate(mine)) for k, p in prof.items()}
        best = min(sorted(d), key=d.get)
        assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == (best, 1 - d[best] / (300 * len(mine)))
    out = [got[r.doc_id].lang_pred == r.lang for r in rows if held[r.doc_id]]
    assert sum(out) / len(out) >= 0.95


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score string, n string"
    assert identify(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, "en", "", ""), (2, "", None, "", ""), (3, "the " * 50_000, "en", "", ""), (3, "the", "en", "", ""), (None, "der", "de", "", ""), (4, "123", "de", "", "")]
    got = identify(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6 and {r.lang_pred for r in got if r.doc_id in (1, 2, 4)} == {"und"}
    none = predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), profiles(spark.createDataFrame([], "doc_id long, text string, lang string")))
    assert [tuple(r) for r in none.collect()] == [(1, "und", 0.0)]


def test_long_texts_and_many_grams(spark, monkeypatch):
    """Grams of a text are the same from slices of any size; sums of a batch are the same if they are passed on early."""
    from ragmill.llm import langid

    text = "Ünïcode wörds, and más letras " * 60_000
    assert len(text) > 1_500_000
    whole = {decode(int(a)): int(b) for a, b in zip(*ngrams(text))}
    assert whole == dict(brute_grams(text))
    monkeypatch.setattr(langid, "STARTS", 7)
    small = "Ünïcode wörds, and más letras 語言 " * 5
    assert {decode(int(a)): int(b) for a, b in zip(*ngrams(small))} == dict(brute_grams(small))
    docs = spark.createDataFrame([(i, f"{w} {w}er {w}ing", lang) for i, (w, lang) in enumerate([("haus", "de"), ("house", "en"), ("maison", "fr")] * 20)], "doc_id long, text string, lang string")
    want = sorted(map(tuple, profiles(docs).collect()))
    monkeypatch.setattr(langid, "HELD", 5)
    assert sorted(map(tuple, profiles(docs).collect())) == want and want
