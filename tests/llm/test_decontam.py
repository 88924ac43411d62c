import random

import numpy as np

from ragmill.llm import decontam
from ragmill.llm.decontam import Index, budget, contaminated, drop_contaminated, gram_hashes, normalise

DOCS, BENCH = "doc_id long, text string, item_id string, edits string", "item_id long, text string, doc_id string"


def plain(text):
    out = "".join(c.lower() if c.isalnum() and len(c.lower()) == 1 else c if c.isalnum() else " " for c in text or "")
    return " ".join(out.split())


def best_edits(item, text):
    """Least edits of the whole item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def sample(seed=5):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["th", "er", "on", "é", "in", "st", "a"]) for _ in range(rnd.randrange(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rnd.choice([3, 12, 40])).capitalize() + ".") for i in range(12)] + [(50, None), (51, ""), (52, "abc"), (53, items_repeat())]
    docs = []
    for i in range(80):
        t = prose(rnd.randrange(0, 60))
        for _ in range(rnd.choice([0, 1, 2])):
            x = list(rnd.choice(items[:12])[1])
            for _ in range(rnd.randrange(0, 9)):
                at = rnd.randrange(len(x))
                x[at : at + 1] = rnd.choice([[], ["z"], [x[at], "q"]])
            x = "".join(x)
            t += rnd.choice(["\n", " ", ""]) + (x.upper().replace(" ", "!! ") if rnd.random() < 0.3 else x) + " " + prose(rnd.randrange(0, 20))
        docs.append((i, t))
    return docs + [(90, None), (91, ""), (92, "ab " * 400), (92, "ab " * 400)], items


def items_repeat():
    return "ab " * 30


def brute(docs, items):
    out = set()
    for d, t in docs:
        text = plain(t)
        for i, x in items:
            item = plain(x)
            k = budget(len(item))
            if len(item) >= 10 and best_edits(item, text) <= k:
                out.add((d, i, best_edits(item, text)))
    return out


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "", "") for d in docs], DOCS), spark.createDataFrame([(*x, "") for x in items], BENCH)


def test_brute_force(spark, monkeypatch):
    docs, items = sample()
    d, b = frames(spark, docs, items)
    want = brute(docs, items)
    assert len(want) > 20
    got = contaminated(d, b).collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in got} == want and len(got) == len(want) + 1
    texts, bench = dict(docs), dict(items)
    for r in got:
        assert abs(best_edits(plain(bench[r.item_id]), plain(texts[r.doc_id][r.start : r.stop])) - r.edits) == 0
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 300)
    assert {(r.doc_id, r.item_id, r.edits) for r in contaminated(d, b).collect()} == want
    assert {r.doc_id for r in drop_contaminated(d, b).collect()} == {i for i, _ in docs} - {w[0] for w in want}


def test_pieces_and_hashes(monkeypatch):
    docs, items = sample(6)
    index = Index(items)
    text = " ".join(t for _, t in docs if t)
    c, _ = normalise(text)
    whole = {(i, low) for i, low, _, _ in index.search(c)}

    def hit():
        cases = list(index.search(c))
        return {x[0] for x, a in zip(cases, index.align([x[:3] for x in cases])) if a[0] <= index.edits[x[0]]}

    first = hit()
    monkeypatch.setattr(decontam, "PIECE", 700)
    assert whole and hit() == first
    h = gram_hashes(c)
    s = "".join(map(chr, c))
    assert len({s[i : i + 10] for i in range(len(h))}) == len(np.unique(h))


def test_empty(spark):
    docs, items = frames(spark, [], [(1, "some benchmark text")])
    assert contaminated(docs, items).count() == 0
    docs, items = frames(spark, [(1, "some benchmark text")], [])
    assert contaminated(docs, items).count() == 0 and drop_contaminated(docs, items).count() == 1


def test_short_and_long_items_and_blocks(spark, monkeypatch):
    """Items without a q-gram by equality; a very long one within its bounded budget; the same rows from many scans; null ids by their text."""
    rnd = random.Random(11)
    long = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(40_000))
    assert len(long) > 200_000 and budget(len(long)) > 10_000 and budget(len(long), most=400) == 400
    changed = list(long)
    for i in range(100):
        changed[2_000 * (i + 1)] = "z"
    items = [(1, "Yes!"), (2, "yes"), (3, long)]
    docs = [(1, " yes. "), (2, "yes sir"), (3, "start " + "".join(changed) + " end"), (None, "YES"), (4, None), (4, "clean text of this row")]
    d, b = frames(spark, docs, items)
    got = sorted((r.doc_id or 0, r.item_id, r.edits, r.start) for r in contaminated(d, b, max_edits=400).collect())
    assert [(i, k) for i, k, _, _ in got] == [(0, 1), (0, 2), (1, 1), (1, 2), (3, 3)] and got[-1][2] <= 100 and got[-1][3] == 6
    assert sorted((r.doc_id or 0, r.text or "") for r in drop_contaminated(d, b, max_edits=400).collect()) == [(2, "yes sir"), (4, ""), (4, "clean text of this row")]
    docs, items = sample()
    d, b = frames(spark, docs, items)
    want = sorted(map(tuple, contaminated(d, b).collect()), key=repr)
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 200)
    monkeypatch.setattr(decontam, "MAX_BLOCKS", 2)
    assert sorted(map(tuple, contaminated(d, b).collect()), key=repr) == want and want


def test_repetitive_texts(monkeypatch):
    """Counts of q-grams by band equal those of single matches, in little memory, where item and text repeat themselves."""
    import tracemalloc

    rnd = random.Random(8)
    period = "".join(rnd.choice("abcdefghij") for _ in range(23))
    items = [(0, period * 90), (1, "ab " * 60), (2, period[:12] * 8), (3, "plain text without any such thing")]
    texts = [period * 300, "ab " * 500 + period * 20, "x" * 90 + (period * 95)[7:], "ab " * 30]

    def single(index, c):
        """Bands by matching each q-gram of the text with each place of it in each item."""
        h, own, count = gram_hashes(c), [gram_hashes(x) for x in index.chars], {}
        for n, g in enumerate(own):
            step, places = int(index.edits[n]) + 1, {}
            for s, v in enumerate(g.tolist()):
                places.setdefault(v, []).append(s)
            for p, v in enumerate(h.tolist()):
                for s in places.get(v, ()):
                    for b in ((p - s) // step, (p - s) // step - 1):
                        count[n, b * step] = count.get((n, b * step), 0) + 1
        return {k for k, c in count.items() if c >= index.sizes[k[0]] + 1 - (index.edits[k[0]] + 1) * index.q}

    index = Index(items)
    for most in (decontam.MATCHES, 50):
        monkeypatch.setattr(decontam, "MATCHES", most)
        for t in texts:
            c, _ = normalise(t)
            assert {tuple(x) for x in index.bands(c).tolist()} == single(index, c)
    monkeypatch.undo()
    index, c = Index([(0, period * 430)]), normalise(period * 40_000)[0]
    tracemalloc.start()
    assert len(index.bands(c)) > 1000
    assert tracemalloc.get_traced_memory()[1] < 600e6
    tracemalloc.stop()


def test_budget_of_long_items(spark):
    """Items over 5,000 characters have their whole budget."""
    rnd = random.Random(12)
    item = "".join(rnd.choice("abcdefgh ") for _ in range(7_000))
    x = list(item)
    for at in rnd.sample(range(0, 7_000), 450):
        x[at] = "z"
    d, b = frames(spark, [(1, "before " + "".join(x) + " after")], [(9, item)])
    assert [(r.doc_id, r.item_id) for r in contaminated(d, b).collect()] == [(1, 9)]
    assert contaminated(d, b, max_edits=400).count() == 0
