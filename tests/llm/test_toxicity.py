import itertools
import random

import numpy as np

from ragmill.llm.toxicity import DECAY, EDGE, SPAN, _norm, classify, fit, fold, kernel, op6_toxicity, word_sums

SF = "/root/testdata/sf0.1"


def brute_kernel(a, b):
    def weights(w):
        out = {}
        for i, j, k in itertools.combinations(range(len(w)), 3):
            if k - i <= SPAN:
                key = (w[i], w[j], w[k])
                out[key] = out.get(key, 0) + DECAY ** (k - i) / _norm(len(w))
        return out

    x, y = weights(a), weights(b)
    return sum(v * y.get(k, 0) for k, v in x.items())


def words(texts):
    return [fold(t).tobytes() for t in texts]


def test_kernel_equals_brute_force():
    w = words(["idiot", "idxiot", "an", "moron", "éàü", "x" * 40, "abcabcabc"])
    got = kernel(w, w)
    want = np.array([[brute_kernel(a, b) for b in w] for a in w])
    assert np.allclose(got, want, atol=1e-5)


def test_folding():
    for text in ("idiot", "i.d.i.o.t", "I-D-I-O-T!", "i d i o t", "id​iot"):
        assert fold(text).tobytes() == fold("idiot").tobytes()
    assert fold("").tolist() == [EDGE] and len(fold("a bc d e")) == len(fold("a bc de"))
    assert len(word_sums(fold(""), np.zeros(1 << 18, np.float32))) == 0


def corpus(n, seed):
    rnd = random.Random(seed)
    syl = ["th", "er", "on", "an", "re", "st", "ing", "ou"]
    word = lambda: "".join(rnd.choice(syl) for _ in range(rnd.randrange(1, 4)))
    out = []
    for i in range(n):
        w = [word() for _ in range(rnd.randrange(5, 80))]
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            w.insert(rnd.randrange(len(w)), rnd.choice(["idiot", "moron", "worthless", "clown"]))
        out.append((" ".join(w), int(toxic)))
    return out


def test_gapped_insults():
    model = fit(*zip(*corpus(400, 1)), landmarks=40)
    held = corpus(200, 2)
    assert np.mean([(model.score(t) >= 0.5) == y for t, y in held]) > 0.98
    clean = [t for t, y in held if not y]
    for change in ("-".join, " ".join, lambda w: w[:2] + "*" + w[2:], lambda w: w[:3] + w[2:], lambda w: w[:2] + "x" + w[2:]):
        hit = [model.score(t + " " + change("idiot") + " the " + change("worthless")) >= 0.5 for t in clean]
        assert np.mean(hit) > 0.9
    assert model.score("") == model.score(None) < 0.5
    long = " ".join(t for t in clean for _ in range(60))
    assert len(long) > 1_000_000 and model.score(long) < 0.5 <= model.score(long + " idiot you moron")


def test_operator_edges(spark):
    rows = [(i, t, "", 0.0) for i, (t, _) in enumerate(corpus(120, 3))] + [(500, None, "", 0.0), (501, "", "", 0.0), (7, "again", "", 0.0), (None, "x", "", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(corpus(120, 3))] + [(3, 1, None), (None, 0, 1), (999, 0, 1)], "doc_id long, quality int, toxic int")
    got = classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in classify(docs, labels.limit(0)).collect()} == {0.0}


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [(r.score, r.predicted, labels[r.doc_id]) for r in op6_toxicity(spark, SF).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for _, p, y in got]) > 0.97
    assert sum(p and y for _, p, y in got) / sum(y for _, _, y in got) > 0.85
