from collections import Counter

import sentencepiece

import corpus_pipeline
from ragmill.llm.decontam import budget
from ragmill.llm.pieces import model_path
from tests.llm.test_decontam import best_edits, plain
from tests.llm.test_langid import brute_grams
from tests.llm.test_line_ops import brute_runs

SF = "/root/testdata/sf0.001"


def brute_similar(rows, width):
    """Rows that are the first of their component of pairs with a shingle Jaccard of 0.8 or more."""
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [r for i, r in enumerate(rows) if find(i) == i]


def test_stages_by_brute_force(spark):
    bench = [(r.item_id, plain(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    for name, stage in corpus_pipeline.STAGES:
        before = sorted((r.doc_id, r.text) for r in docs.collect())
        out = stage(spark, docs, SF)
        if name == "sentencepiece":
            got = {r.doc_id: r.ids for r in out.collect()}
            assert got == {i: sp.encode(t) for i, t in before}
            break
        assert out.columns == docs.columns
        out = corpus_pipeline.materialize(out, name)
        got = sorted((r.doc_id, r.text) for r in out.collect())
        if name == "language_id":
            assert got == [r for r in before if brute_grams(r[1])]
        if name == "line_dedup":
            left = dict(brute_runs(before))
            assert got == [(i, left[i]) for i, t in before if left[i] == t or left[i].replace("\n", "").strip(" ")]
            assert all(r.n_chars == len(r.text) for r in out.collect())
        if name == "near_dedup":
            assert got == brute_similar(before, 5)
        if name == "decontam":
            grams = lambda t: {t[i : i + 10] for i in range(len(t) - 9)}

            def holds(text):
                text, have = plain(text), grams(plain(text))
                return any(len(grams(b) & have) >= 5 and best_edits(b, text) <= budget(len(b)) for _, b in bench)

            assert got == [r for r in before if not holds(r[1])] and len(got) < len(before)
        docs = out


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _n int, lang_pred string, d int, n_lines int"
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "same words here", "en", "s", 15), (3, "same words here", "en", "s", 15), (None, "no id", "en", "s", 5), (4, "123", None, None, 3), (5, "other text " * 20_000, "en", "s", 1)]
    for data in (rows, []):
        docs = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in data], schema)
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, corpus_pipeline.materialize(stage(spark, docs, SF), "edge")
            assert name == "sentencepiece" or docs.columns == before.columns
            if name != "sentencepiece":
                assert {(r._n, r.lang_pred, r.d, r.n_lines) for r in docs.collect()} <= {(1, "x", 2, 3)}
        got = Counter(r.doc_id for r in docs.collect())
        assert got == (Counter({3: 1, 5: 1, None: 1}) if data else Counter())
