"""SentencePiece encoding by suffix-array matching, and decoding."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ragmill.llm.common import tidy

SPACE = "▁"
NEVER = np.int64(1) << 40
END = np.uint32(0x110000)  # between words: no character
CACHE_WORDS = 200_000
NEW_WORDS = 20_000
SHORT = 8
TEXT_CHARS = 500_000
ROWS = 512
SLOTS = 1 << 21


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the installed public tokenizer files are; any other model's path may be given instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """A BPE piece table with byte fallback: pieces, merge order, and each piece's states at either end.

    A merge joins two neighbours whose text is a piece, best score first, leftmost first. Two pieces may stand side by side
    in an encoding exactly if, while each is built up by its own merges, the symbols at their border never merge earlier. So
    each piece keeps the list of its first (and last) symbols and the times at which each is replaced by a larger one.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.bytes_at = {int(p[3:5], 16): i for i, p in enumerate(names) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id_of = {names[i]: i for i in plain}
        self.names = names
        self.runs = {p: i for p, i in self.id_of.items() if len(p) > 1 and not p.strip(SPACE)}
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of) or any(p.startswith(SPACE * 2) for p in self.id_of if p not in self.runs):
            raise ValueError("pieces must not reach over a space")
        words = sorted((p for p in self.id_of if len(p) > 1 and p not in self.runs), key=lambda p: (-sp.get_score(self.id_of[p]), self.id_of[p]))
        if words and self.runs and min(sp.get_score(self.id_of[p]) for p in words) <= max(map(sp.get_score, self.runs.values())):
            raise ValueError("runs of spaces must merge last")
        self.rank = {p: r for r, p in enumerate(words, 1)}
        self.newline = "\n" in self.id_of
        self.longest = max(map(len, self.rank), default=1)
        self.text_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        chars = sorted(p for p in self.id_of if len(p) == 1)
        self.texts = chars + words  # by own number
        self.ids = np.array([self.id_of[p] for p in self.texts], np.int32)
        self.lengths = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        self.chars = np.zeros((len(self.texts), self.longest), np.int64)
        for k, t in enumerate(self.texts):
            self.chars[k, : len(t)] = [ord(c) for c in t]
        self.blob = np.frombuffer(b"".join(self.text_bytes), np.uint8)
        self.blob_sizes = np.fromiter(map(len, self.text_bytes), np.int64, n)
        self.blob_starts = np.cumsum(self.blob_sizes) - self.blob_sizes
        number = {p: k for k, p in enumerate(self.texts)}
        pairs = sorted((number[p[:i]] * len(self.texts) + number[p[i:]], self.rank[p]) for p in words for i in range(1, len(p)) if p[:i] in number and p[i:] in number)
        self.pair_keys = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs] or [0], np.int64)
        self.whole = np.ones(len(self.texts), bool)
        first, last = [], []
        for k, p in enumerate(self.texts):
            whole, heads, tails = self._build(p)
            self.whole[k] = whole
            first.append([(number[s], t) for s, t in heads])
            last.append([(number[s], t) for s, t in tails])
        self.first, self.last = self._table(first), self._table(last)
        self.slot_pairs = self.slot_values = None  # made on first use, so that they are not broadcast

    @staticmethod
    def _table(chains: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
        depth = max(map(len, chains), default=1)
        symbols, until = np.zeros((len(chains), depth), np.int64), np.full((len(chains), depth), NEVER)
        for k, chain in enumerate(chains):
            for i, (s, t) in enumerate(chain):
                symbols[k, i], until[k, i] = s, t
        return symbols, until

    def _build(self, piece: str) -> tuple[bool, list, list]:
        """Whether merges build the piece from its characters; its first and last symbols, with the time each lasts."""
        symbols, time = list(piece), 0
        heads, tails = [], []
        while len(symbols) > 1:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in self.rank), default=None)
            if best is None:
                return False, [*heads, (symbols[0], NEVER)], [*tails, (symbols[-1], NEVER)]
            time, i = max(time, best[0]), best[1]
            if i == 0:
                heads.append((symbols[0], time))
            if i == len(symbols) - 2:
                tails.append((symbols[-1], time))
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return True, [*heads, (symbols[0], NEVER)], [*tails, (symbols[0], NEVER)]

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * len(self.texts) + b
        i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[i] == key, self.pair_ranks[i], NEVER)

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        i, j, ok = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y, p, q = a[live], b[live], i[live], j[live]
            left, right = self.last[1][x, p], self.first[1][y, q]
            rank = self._pair_rank(self.last[0][x, p], self.first[0][y, q])
            ok[live] &= ~((rank < left) & (rank <= right) & (rank < NEVER))
            step_left = left <= right
            i[live] += step_left
            j[live] += ~step_left
            live = live[ok[live] & (np.minimum(left, right) < NEVER)]
        return ok

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether b may follow a; pairs met before are looked up in a table of SLOTS places."""
        if self.slot_pairs is None:
            self.slot_pairs, self.slot_values = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        key = a * len(self.texts) + b
        slot = self._slot(key)
        ok, miss = self.slot_values[slot], np.flatnonzero(self.slot_pairs[slot] != key)
        if len(miss):
            new, inverse = np.unique(key[miss], return_inverse=True)
            value = self._compatible(new // len(self.texts), new % len(self.texts))
            ok[miss] = value[inverse]
            slot, at = np.unique(self._slot(new), return_index=True)
            self.slot_pairs[slot], self.slot_values[slot] = new[at], value[at]
        return ok

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)

    @staticmethod
    def _sort(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of the keys, and each key's rank from 1."""
        order = np.argsort(key)
        new = key[order]
        ranks = np.empty(len(key), np.int64)
        ranks[order] = np.cumsum(np.r_[True, new[1:] != new[:-1]])
        return order, ranks

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, piece number) of every occurrence of every piece in the concatenated text.

        A suffix array of the text, sorted by as many characters as the longest piece has (prefix doubling), is searched for
        all pieces at once: the range of suffixes that begin with a piece narrows character by character.
        """
        n = len(codes)
        present = np.zeros(int(END) + 1, bool)
        present[codes] = True
        dense = np.cumsum(present)[codes]  # from 1, in order of code points
        bits = int(dense.max(initial=1)).bit_length()
        width = max(1, 62 // bits)
        key = np.zeros(n, np.int64)
        for i in range(width):
            key[: max(n - i, 0)] |= dense[i:] << (bits * (width - 1 - i))
        suffixes, ranks = self._sort(key)
        while width < self.longest:
            after = np.zeros(n, np.int64)
            after[: max(n - width, 0)] = ranks[width:]
            suffixes, ranks = self._sort(ranks * (n + 2) + after)
            width *= 2
        lo, hi = np.zeros(len(self.texts), np.int64), np.full(len(self.texts), n, np.int64)
        extended = np.concatenate([codes.astype(np.int64), np.full(self.longest, -1)])
        for at in range(self.longest):
            live = np.flatnonzero((self.lengths > at) & (lo < hi))
            want = self.chars[live, at]
            for side in (0, 1):
                a, b = lo[live].copy(), hi[live].copy()
                while True:
                    open_ = a < b
                    if not open_.any():
                        break
                    mid = (a + b) // 2
                    value = extended[suffixes[np.minimum(mid, n - 1)] + at]
                    go = open_ & ((value < want) if side == 0 else (value <= want))
                    a = np.where(go, mid + 1, a)
                    b = np.where(open_ & ~go, mid, b)
                if side == 0:
                    left = a
                else:
                    lo[live], hi[live] = left, a
        count = np.maximum(hi - lo, 0)
        number = np.repeat(np.arange(len(self.texts)), count)
        begin = suffixes[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        return begin, number

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the words, one word after the other, and how many each has; no word has a space but as its first character."""
        if not any(words):
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        text = "\x00".join(words)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).copy()
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes + 1) - sizes - 1
        codes[starts[1:] - 1] = END
        begin, number = self.edges(codes)
        lengths = self.lengths
        word = np.repeat(np.arange(len(words)), np.r_[sizes[:-1] + 1, sizes[-1]])
        usable = self.whole[number]
        begin, number = begin[usable], number[usable]
        covered = np.zeros(len(codes) + 1, bool)
        covered[begin[lengths[number] == 1]] = True
        alien = np.flatnonzero(~covered[: len(codes)] & (codes != END))  # characters without a piece stand alone
        begin = np.concatenate([begin, alien])
        number = np.concatenate([number, np.full(len(alien), -1)])
        size = np.where(number < 0, 1, lengths[number])
        end = begin + size
        stop = end - starts[word[begin]]
        order = np.argsort(stop, kind="stable")
        begin, number, end, stop = begin[order], number[order], end[order], stop[order]
        last = np.full(len(codes) + 1, -2)  # the piece that ends at a place
        fresh = np.zeros(len(codes) + 1, bool)
        fresh[starts] = True
        cuts = np.r_[np.flatnonzero(np.r_[True, stop[1:] != stop[:-1]]), len(stop)]
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            b, k = begin[s:e], number[s:e]
            before = last[b]
            ok = fresh[b] | (before == -1) | ((k == -1) & (before >= 0))
            ask = np.flatnonzero(~ok & (before >= 0) & (k >= 0))
            if len(ask):
                ok[ask] = self.compatible(before[ask], k[ask])
            last[end[s:e][ok]] = k[ok]
        place, kept, owner = (starts + sizes).copy(), [], []
        live = np.flatnonzero(sizes > 0)
        while len(live):  # back from each word's end
            k = last[place[live]]
            if (k == -2).any():
                raise RuntimeError("a word has no encoding")
            kept.append(np.where(k >= 0, k, -1 - codes[place[live] - 1].astype(np.int64)))
            owner.append(live)
            place[live] -= np.where(k >= 0, lengths[k], 1)
            live = live[place[live] > starts[live]]
        kept, owner = np.concatenate(kept[::-1]), np.concatenate(owner[::-1])
        order = np.argsort(owner, kind="stable")
        kept, owner = kept[order], owner[order]
        ids, size, alien = self.ids[np.maximum(kept, 0)], np.ones(len(kept), np.int64), np.flatnonzero(kept < 0)
        if len(alien):
            spelt = [self._fallback(chr(-1 - k)) for k in kept[alien].tolist()]
            size[alien] = [len(x) for x in spelt]
            ids, stop = np.repeat(ids, size), np.cumsum(size)
            for i, x in zip(alien.tolist(), spelt):
                ids[stop[i] - len(x) : stop[i]] = x
        return ids, np.bincount(owner, size, len(words)).astype(np.int64)

    def _fallback(self, char: str) -> list[int]:
        return [self.bytes_at[b] for b in char.encode()] if self.bytes_at else [self.unknown]

    def space_run(self, n: int) -> tuple[int, ...]:
        """The pieces of n spaces that no word has taken: neighbours merge from the left for as long as they make a piece."""
        sizes, longest = [1] * n, {len(p) for p in self.runs}
        nxt, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(i, 1, 1) for i in range(n - 1)] if 2 in longest else []
        while heap:
            i, a, b = heapq.heappop(heap)
            j = nxt[i] if i < n and alive[i] else n
            if j >= n or not alive[i] or sizes[i] != a or sizes[j] != b:
                continue
            sizes[i], alive[j] = a + b, False
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
                if sizes[i] + sizes[nxt[i]] in longest:
                    heapq.heappush(heap, (i, sizes[i], sizes[nxt[i]]))
            p = prev[i]
            if p >= 0 and sizes[p] + sizes[i] in longest:
                heapq.heappush(heap, (p, sizes[p], sizes[i]))
        return tuple(self.id_of[SPACE * sizes[i]] if SPACE * sizes[i] in self.id_of else self.unknown for i in range(n) if alive[i])


def _gather(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of runs in a flat array, one run after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Encoder:
    """Encodes texts by their distinct words; keeps the encodings of a bounded number of words, flat in two arrays."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._forget([])

    def _forget(self, kept: list[str]) -> None:
        """Forgets all words but ``kept``."""
        at = np.fromiter((self.number[w] for w in kept), np.int64, len(kept))
        size = np.diff(self.begin)[at] if kept else np.zeros(0, np.int64)
        self.ids = self.ids[_gather(self.begin[at], size)] if kept else np.zeros(0, np.int32)
        self.number, self.begin = dict(zip(kept, range(len(kept)))), np.r_[0, np.cumsum(size)]

    def split(self, text: str) -> list[str]:
        """Words with the spaces before them; a line break is a word of its own, and a later line's first word has no space."""
        marked = SPACE + text.replace(SPACE, " ").replace(" ", f" {SPACE}")
        words = (marked if self.pieces.newline else marked.replace("\n", " \n ")).split(" ")
        if SPACE not in words:
            return words
        out, free = [], 0
        for w in words:
            if w == SPACE:
                free += 1
                continue
            if free and w[:1] != SPACE:
                out.append(SPACE * free)
                free = 0
            out.append(SPACE * free + w)
            free = 0
        return [*out, SPACE * free] if free else out

    def _learn(self, words: list[str]) -> None:
        """Adds words. A run of spaces takes the space of the word after it only if that word does not merge with it."""
        runs = [w for w in words if w == SPACE or w.startswith(SPACE * 2)]
        if runs:
            words = [w for w in words if not (w == SPACE or w.startswith(SPACE * 2))]
        ids, size = self.pieces.encode_words(words)
        if runs:
            free = [len(w) - len(w.lstrip(SPACE)) for w in runs]
            rest, n = self.pieces.encode_words([w[k - 1 :] if k < len(w) else "" for w, k in zip(runs, free)])
            space, more = self.pieces.id_of[SPACE], []
            for part, k in zip(np.split(rest, np.cumsum(n)[:-1]), free):
                part = part.tolist()
                if part and part[0] == space:
                    more.append([*self.pieces.space_run(k), *part[1:]])
                else:
                    more.append([*self.pieces.space_run(k - 1 if part else k), *part])
            ids = np.concatenate([ids, np.array([i for x in more for i in x], np.int32)])
            size = np.concatenate([size, np.array([len(x) for x in more], np.int64)])
        self.number.update(zip([*words, *runs], range(len(self.number), len(self.number) + len(size))))
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(size)])
        self.ids = np.concatenate([self.ids, ids])

    def encode_part(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the texts, one text after the other, and how many each has."""
        docs = [self.split(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, docs), np.int64, len(docs))
        words = list(chain.from_iterable(docs))
        del docs
        word = self._look_up(words)
        at = np.flatnonzero(word < 0)
        new = list(dict.fromkeys([words[i] for i in at.tolist()]))
        if len(self.number) + len(new) > CACHE_WORDS:  # short words are the frequent ones: they stay, unless too many
            short = [w for w in self.number if len(w) <= SHORT]
            self._forget(short if len(short) <= CACHE_WORDS // 2 else [])
            new, at = [w for w in dict.fromkeys(words) if w not in self.number], np.arange(len(words))
        for k in range(0, len(new), NEW_WORDS):
            self._learn(new[k : k + NEW_WORDS])
        word[at] = self._look_up([words[i] for i in at.tolist()])
        size = self.begin[word + 1] - self.begin[word]
        total = np.r_[0, np.cumsum(size)]
        return self.ids[_gather(self.begin[word], size)], np.diff(total[np.r_[0, np.cumsum(counts)]])

    def _look_up(self, words: list[str]) -> np.ndarray:
        """The number of each word, -1 for those not known."""
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))

    @staticmethod
    def parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
        """Runs of texts of about TEXT_CHARS characters, as begin and end."""
        begin, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= TEXT_CHARS or i == len(texts) - 1:
                yield begin, i + 1
                begin, size = i + 1, 0

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        for begin, end in self.parts(texts):
            ids, size = self.encode_part(texts[begin:end])
            yield from (x.tolist() for x in np.split(ids, np.cumsum(size)[:-1]))

    def decoded(self, ids: np.ndarray, sizes: np.ndarray) -> Iterator[bytes]:
        """The UTF-8 bytes of each text, without the space put before the first word."""
        n = self.pieces.blob_sizes[ids]
        total = np.r_[0, np.cumsum(n)]
        raw = self.pieces.blob[_gather(self.pieces.blob_starts[ids], n)].tobytes()
        edges = total[np.r_[0, np.cumsum(sizes)]].tolist()
        for a, b in zip(edges[:-1], edges[1:]):
            yield raw[a:b].removeprefix(b" ")

    def decode(self, ids: list[int]) -> str:
        """The text of piece ids; malformed bytes become U+FFFD."""
        return next(self.decoded(np.array(ids, np.int64), np.array([len(ids)]))).decode("utf-8", "replace")


def _shared(docs: DataFrame, path: str | None):
    """The piece tables of a model file, read and made by the driver, as a broadcast of some ten MB."""
    with open(path or model_path(), "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(Pieces(f.read()))


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip for each row of ``docs``: ids as the model's own library gives them.

    Each batch's distinct words are concatenated, matched with all pieces through a suffix array, the occurrences sorted by
    their end, and relaxed left to right: an occurrence extends the encoding that ends at its begin if its piece may follow
    that one's last piece; for merge-built pieces one does at every place, so the last relaxed is the encoding. (For pieces
    with additive scores one would keep the largest sum instead; the given model is merge-built.) Words are independent as no
    piece reaches over a space; runs of spaces and characters without a piece (given as bytes) are put in afterwards.

    round_trip tells whether decoding gives the text back, which it does unless the text holds U+2581. Null texts give null
    ids, 0 tokens and a null round_trip, empty ones no ids. The piece tables, of bounded size, are broadcast; a task keeps the
    encodings of CACHE_WORDS words at most.
    """
    shared = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(shared.value)
        for b in (big.slice(at, ROWS) for big in batches for at in range(0, big.num_rows, ROWS)):
            texts = b.column(1).to_pylist()
            for begin, end in coder.parts(texts):
                part = texts[begin:end]
                missing = pa.array([t is None for t in part])
                ids, size = coder.encode_part([t or "" for t in part])
                same = [None if t is None else x == t.encode() for t, x in zip(part, coder.decoded(ids, size))]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(ids), mask=missing)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, end - begin), pa.array(size, pa.int32()), lists, pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, n_tokens int, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text for each row of ``encoded(doc_id, ids)``; null ids give null."""
    shared = _shared(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if i is None else coder.decode(i) for i in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), f"doc_id {kind}, text string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
