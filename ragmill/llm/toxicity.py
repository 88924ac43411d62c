"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.llm.common import tidy
from ragmill.llm.langid import held_out

SPAN = 5
DECAY = 0.6
LANDMARKS = 160
TRAIN_TOXIC = 2_000
TRAIN_CLEAN = 4_000
TRAIN_CHARS = 6_000
PIECE = 1_000_000
EDGE, GAP = 63, 0
PAIRS = [(a, b) for b in range(2, SPAN + 1) for a in range(1, b)]


@cache
def _classes() -> np.ndarray:
    """Class of each code point: 1-26 the letters a to z, 27-62 other letters and digits, 0 white space, 64 dropped."""
    out = np.full(0x110000, 64, np.uint8)
    for i in range(0x110000):
        ch = chr(i)
        low = ch.lower()[:1]
        if ch.isspace():
            out[i] = GAP
        elif "a" <= low <= "z":
            out[i] = ord(low) - 96
        elif unicodedata.category(ch)[0] in "LN":
            out[i] = 27 + ord(low) % 36
    return out


def fold(text: str) -> np.ndarray:
    """Character classes of a text's words, EDGE before and after each word.

    Characters that are neither letters nor digits are dropped, so letters apart by inserted marks stand together; single
    letters in a row become one word.
    """
    c = _classes()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    c = c[c != 64]
    c = np.concatenate([[GAP], c, [GAP]]).astype(np.uint8)
    gap = c == GAP
    c = c[~(gap & np.r_[False, gap[:-1]])]
    gap = c == GAP
    at = np.flatnonzero(gap)
    single = np.diff(at) == 2  # words of one letter, by the gap before them
    both = np.flatnonzero(single[:-1] & single[1:]) + 1
    c = np.delete(c, at[both])
    c[c == GAP] = EDGE
    return c


def _spread(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin of each word in ``c`` (its first EDGE), and each word's number of characters with both edges."""
    edges = np.flatnonzero(c == EDGE)
    return edges[:-1], np.diff(edges) + 1


@cache
def _norm(length: int) -> float:
    return float(np.sqrt(sum(DECAY ** (2 * b) * max(length - b, 0) for _, b in PAIRS))) or 1.0


def _norms(lengths: np.ndarray) -> np.ndarray:
    top = int(lengths.max(initial=0))
    if top > 4096:
        values, at = np.unique(lengths, return_inverse=True)
        return np.array([_norm(int(v)) for v in values])[at]
    return np.array([_norm(n) for n in range(top + 1)])[lengths]


def word_sums(c: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each word the inner product of its subsequence features with ``table``, over the norm for its length.

    The features of a word are its subsequences of three characters (edges included) that span at most SPAN steps, each
    weighted by DECAY to the power of its span; a table holds a weight for each of the 64^3 subsequences. The inner product
    of two words' features over their norms is the kernel, so any sum of kernels with landmarks is one table.
    """
    begins, lengths = _spread(c)
    if not len(begins):
        return np.zeros(0)
    x = c.astype(np.int32)
    ends = np.zeros(len(c), np.int32)  # steps to the end of the word that a character begins in
    word_end = np.repeat(begins + lengths - 1, lengths - 1)
    left = (word_end - np.arange(len(word_end))).astype(np.int32)
    ends[: len(left)] = left
    total = np.zeros(len(c), np.float64)
    for a, b in PAIRS:
        n = len(c) - b
        if n <= 0:
            continue
        value = table[(x[:n] << 12) | (x[a : a + n] << 6) | x[b : b + n]] * np.float32(DECAY**b)
        value[ends[:n] < b] = 0
        total[:n] += value
    return np.add.reduceat(total[: begins[-1] + lengths[-1] - 1], begins) / _norms(lengths)


def features(word: bytes) -> dict[int, float]:
    """Weights of one word's subsequences, over its norm."""
    out: dict[int, float] = {}
    for i in range(len(word)):
        for a, b in PAIRS:
            if i + b < len(word):
                key = word[i] << 12 | word[i + a] << 6 | word[i + b]
                out[key] = out.get(key, 0.0) + DECAY**b / _norm(len(word))
    return out


def _table(words: list[bytes], weights: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 18, np.float64)
    for w, weight in zip(words, weights):
        for key, value in features(w).items():
            out[key] += weight * value
    return out.astype(np.float32)


def kernel(words: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """The kernel of each word with each landmark: both as weights over the landmarks' subsequences, multiplied in blocks."""
    marks = [features(k) for k in landmarks]
    codes = np.unique(np.array([key for m in marks for key in m], np.int64))
    column = np.full(1 << 18, -1, np.int64)
    column[codes] = np.arange(len(codes))
    theirs = np.zeros((len(codes), len(landmarks)), np.float32)
    for j, m in enumerate(marks):
        theirs[column[list(m)], j] = list(m.values())
    out = np.zeros((len(words), len(landmarks)))
    size = max(1, 2_000_000 // max(len(codes), 1))
    for at in range(0, len(words), size):
        part = words[at : at + size]
        c = np.frombuffer(bytes([EDGE]) + b"".join(w[1:] for w in part), np.uint8)
        begins, lengths = _spread(c)
        x, cells, weights = c.astype(np.int64), [], []
        word = np.repeat(np.arange(len(part)), lengths - 1)
        left = np.repeat(begins + lengths - 1, lengths - 1) - np.arange(len(word))
        for a, b in PAIRS:
            n = max(len(c) - b, 0)
            key = column[(x[:n] << 12) | (x[a : a + n] << 6) | x[b : b + n]]
            ok = (left[:n] >= b) & (key >= 0)
            cells.append(word[:n][ok] * len(codes) + key[ok])
            weights.append(np.full(len(cells[-1]), DECAY**b))
        mine = np.bincount(np.concatenate(cells), np.concatenate(weights), len(part) * len(codes))
        out[at : at + size] = mine.reshape(len(part), -1).astype(np.float32) @ theirs / _norms(lengths)[:, None]
    return out


def _values(words: list[bytes], table: np.ndarray) -> np.ndarray:
    return word_sums(np.frombuffer(bytes([EDGE]) + b"".join(w[1:] for w in words), np.uint8), table) if words else np.zeros(0)


def _apart(words: list[bytes], n: int, most: float = 0.7) -> list[bytes]:
    """At most ``n`` of ``words``, first come first, no two with a kernel above ``most``."""
    out: list[int] = []
    free, near = np.ones(len(words), bool), kernel(words, words) <= most if words else None
    for i in range(len(words)):
        if free[i] and len(out) < n:
            out.append(i)
            free &= near[:, i]
    return [words[i] for i in out]


def _words(c: np.ndarray) -> set[bytes]:
    raw = c.tobytes()
    begins, lengths = _spread(c)
    return {raw[b : b + n] for b, n in zip(begins.tolist(), lengths.tolist()) if n > 4}


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 3.0) -> np.ndarray:
    """Linear SVM with squared hinge loss and a bias as last weight, by Newton steps on the violators."""
    x = np.c_[x, np.ones(len(x))]
    w, reg = np.zeros(x.shape[1]), np.eye(x.shape[1])
    reg[-1, -1] = 1e-3
    for _ in range(30):
        on = y * (x @ w) < 1
        h = reg + 2 * c * (x[on] * weight[on, None]).T @ x[on]
        new = np.linalg.solve(h, 2 * c * (x[on] * weight[on, None]).T @ y[on])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


@dataclass
class Model:
    """One table for all landmarks' kernel sums, the bias, and the logistic curve over a text's two highest words."""

    table: np.ndarray
    bias: float
    curve: np.ndarray

    def top_two(self, text: str | None) -> tuple[float, float]:
        """Decision values of the two most toxic words; a text's sentences score as their highest word, the text as its highest sentence."""
        best = [-2.0, -2.0]
        for at in _pieces(text or ""):
            v = word_sums(fold(at), self.table) + self.bias
            if len(v) > 2:
                v = np.partition(v, len(v) - 2)[-2:]
            best = sorted([*best, *np.maximum(v, -2.0).tolist()])[-2:]
        return best[1], best[0]

    def score(self, text: str | None) -> float:
        first, second = self.top_two(text)
        z = self.curve @ [first, second, 1.0]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _pieces(text: str) -> Iterator[str]:
    """The text, if long in pieces of about PIECE characters cut at white space."""
    at = 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(" ", at, at + PIECE), text.rfind("\n", at, at + PIECE))
        cut = cut if cut > at else at + PIECE
        yield text[at:cut]
        at = cut
    yield text[at:]


def fit(texts: list[str], labels: list[int], landmarks: int = LANDMARKS, rounds: int = 4) -> Model | None:
    """Trains on labelled texts; None without texts of both labels.

    Sentences are single words here, see README: longer parts of sentences hide an insult among other words.
    A toxic text needs only one toxic sentence, so training alternates: each toxic text gives its most toxic words as
    positive examples (at first by how much more often toxic texts hold them); the sentences of clean texts give negative ones,
    the common, the nearest, and after each round the wrongly scored. Landmarks are the most telling positives that are apart
    from each other, the nearest clean words and common ones, later also what was scored wrongly; the SVM is linear in the
    Nyström map of the kernel with them.
    """
    y = np.array(labels) > 0
    if not y.any() or y.all():
        return None
    pos, neg, bags = {}, {}, []
    for text, toxic in zip(texts, y):
        bag, into = _words(fold(text)), pos if toxic else neg
        for w in bag:
            into[w] = into.get(w, 0) + 1
        if toxic:
            bags.append(bag)
    n1, n0 = int(y.sum()), int((~y).sum())

    def telling(w: bytes) -> float:
        p, q = pos.get(w, 0), neg.get(w, 0)
        mean = (p + q + 1) / (n1 + n0 + 2)
        return (p / n1 - q / n0) / np.sqrt(mean * (1 - mean) * (1 / n1 + 1 / n0))

    z = {w: telling(w) for w in pos if w not in neg or pos[w] / n1 > 5 * neg[w] / n0}
    ranked = sorted(z, key=lambda w: (-z[w], w))
    if not ranked:
        return None
    value = dict(z)
    strong = {w for w in z if pos[w] >= 2 and z[w] >= 3}
    marks = _apart([w for w in ranked if w in strong or z[w] >= 2][: 5 * landmarks] or ranked[:landmarks], landmarks)
    clean = sorted(w for w in neg if w not in z)
    common = sorted(clean, key=lambda w: (-neg[w], w))
    closeness = _values(clean, _table(marks, np.array([z[m] for m in marks]) / z[marks[0]]))
    nearest = [clean[i] for i in np.argsort(-closeness, kind="stable")]
    chosen = list(dict.fromkeys([*marks, *_apart(nearest[: 4 * landmarks], landmarks // 2), *common[: landmarks // 4]]))
    negatives = dict.fromkeys([*nearest[:3000], *common[:1000], *clean[:: max(1, len(clean) // 3000)]])
    candidates = [sorted(w for w in bag if w in z) for bag in bags]
    table, bias = None, 0.0
    for turn in range(rounds):
        witness = set(strong)
        for bag in candidates:
            if bag and not any(w in strong for w in bag):
                witness.add(max(bag, key=lambda w: (value[w], w)))
        words, others = sorted(witness), sorted(negatives)
        values, vectors = np.linalg.eigh(kernel(chosen, chosen))
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        weight = np.array([min(pos[w], 20) for w in words], float)
        x = kernel([*words, *others], chosen) @ root
        sides = np.r_[np.ones(len(words)), -np.ones(len(others))]
        w = _svm(x, sides, np.r_[weight / weight.mean(), np.ones(len(others))])
        table, bias = _table(chosen, root @ w[:-1]), float(w[-1])
        value = dict(zip(ranked, (_values(ranked, table) + bias).tolist()))
        strong = {w for w in strong if value[w] > -0.5}
        wrong = _values(clean, table) + bias
        worst = [clean[i] for i in np.argsort(-wrong, kind="stable")[:3000] if wrong[i] > -0.9]
        negatives |= dict.fromkeys(worst)
        if turn < rounds - 1:
            missed = sorted((w for w in strong if value[w] < 0.5), key=lambda w: (-z[w], w))
            chosen = list(dict.fromkeys([*chosen, *_apart([w for w in worst if w not in chosen][: 2 * landmarks], landmarks // 2), *_apart(missed[:landmarks], landmarks // 4)]))
    model = Model(table, bias, np.zeros(3))
    top = np.array([model.top_two(t) for t in texts])
    x, target = np.c_[top, np.ones(len(top))], y.astype(float)
    share = np.where(y, 0.5 / n1, 0.5 / n0) * len(y)
    curve = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        step = np.linalg.solve(h, x.T @ (share * (target - p)) - 0.05 * curve)
        curve = curve + step
        if np.abs(step).max() < 1e-6:
            break
    model.curve = curve
    return model


def training_sample(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN) -> DataFrame:
    """(doc_id, text, toxic), of at most ``toxic`` toxic and ``clean`` clean labelled documents that are not held out.

    Those with the smallest hash of doc_id are taken from the labels alone, so the sample has a fixed bound, is the same in
    any order of rows, and costs one scan of the documents. Texts of more than TRAIN_CHARS characters are not trained on, so
    the driver gets (toxic + clean) x TRAIN_CHARS characters at most; of rows that share a doc_id the least text is taken.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    ids = known.where("toxic = 1").orderBy(*order).limit(toxic).unionByName(known.where("toxic = 0").orderBy(*order).limit(clean))
    texts = docs.select("doc_id", "text").where(F.length("text") <= TRAIN_CHARS).join(F.broadcast(ids), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, predicted for each row; without a model all scores are 0. Null and empty texts score like a clean word."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            scores = [m.score(t.as_py()) if m else 0.0 for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; learns only from labelled rows that are not held out.

    A score is a function of the text alone. Repeated rows each give a row; an empty table gives none; with no label of one of the
    two kinds all scores are 0. Extra columns are ignored. The training sample is bounded by ``toxic`` and ``clean`` rows.
    """
    sample = training_sample(docs, labels, toxic, clean).orderBy("doc_id").toPandas()
    model = fit(sample["text"].tolist(), sample["toxic"].tolist())
    return score_documents(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
