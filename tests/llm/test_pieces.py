import random

import numpy as np
import pytest
import sentencepiece

from ragmill.llm import pieces
from ragmill.llm.pieces import SPACE, Encoder, Pieces, decode_documents, encode_documents, model_path, op4_sentencepiece


@pytest.fixture(scope="module")
def coder():
    with open(model_path(), "rb") as f:
        return Encoder(Pieces(f.read()))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


def fuzz(coder, n=1500):
    rnd = random.Random(9)
    v = [coder.pieces.names[i] for i in coder.pieces.id_of.values()]
    odd = [" ", "  ", "\n", "a", "aaaa", "😀", "\t", "語", " " * 17, "\x00", "é"]
    return ["".join(rnd.choice(v) if rnd.random() < 0.7 else rnd.choice(odd) for _ in range(rnd.randrange(0, 30))).replace(SPACE, " ") for _ in range(n)]


def test_equals_library(coder, library):
    texts = fuzz(coder)
    assert list(coder.encode(texts)) == library.encode(texts)
    assert [coder.decode(i) for i in library.encode(texts)] == texts
    long = ["".join(random.Random(1).choice("abcde") for _ in range(5000))]
    assert list(coder.encode(long)) == library.encode(long)
    for n in (1, 2, 15, 17, 31, 100):
        t = [" " * n, " " * n + "\n", "x" + " " * n + "y"]
        assert list(coder.encode(t)) == library.encode(t)


def test_occurrences_by_brute_force(coder):
    text = "\x00".join(["▁hello", "▁thé", "語", "abcabc"])
    begin, number = coder.pieces.edges(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    got = sorted((int(b), coder.pieces.texts[k]) for b, k in zip(begin, number))
    want = sorted((i, text[i:j]) for i in range(len(text)) for j in range(i + 1, min(len(text), i + 16) + 1) if text[i:j] in coder.pieces.rank or (j == i + 1 and text[i:j] in coder.pieces.id_of))
    assert got == want


def test_small_cache_and_parts(coder, library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 50)
    monkeypatch.setattr(pieces, "TEXT_CHARS", 40)
    texts = fuzz(coder, 100)
    assert list(Encoder(coder.pieces).encode(texts)) == library.encode(texts)


def test_operator(spark, library):
    rows = [(1, None), (2, ""), (3, "Hello  wörld\nline"), (3, "Hello  wörld\nline"), (4, f"a{SPACE}b"), (None, "x"), (5, "long text " * 30_000)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], "doc_id long, text string, ids string, n_tokens string")
    out = encode_documents(df)
    got = {(r.doc_id, r.n_tokens, tuple(r.ids) if r.ids is not None else None, r.round_trip) for r in out.collect()}
    want = {(i, 0 if t is None else len(library.encode(t)), None if t is None else tuple(library.encode(t)), None if t is None else SPACE not in t) for i, t in rows}
    assert got == want
    back = {(r.doc_id, r.text) for r in decode_documents(out).collect()}
    assert back == {(i, t.replace(SPACE, " ") if t else t) for i, t in rows}
    assert encode_documents(df.limit(0)).count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op4_sentencepiece(spark, sf).collect()
    assert len(got) == len(texts) and all(r.ids == library.encode(texts[r.doc_id]) and r.round_trip for r in got)
