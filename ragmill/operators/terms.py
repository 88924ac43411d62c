"""Term tables: all terms of a table found in all texts in one pass, by an automaton that is built from the table."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of terms in one automaton that is broadcast; a larger table makes more of them, used one after another.
BLOCK_CHARS = 4_000_000
#: Code points of a text that are searched at once.
PIECE = 1 << 20
_BUILT: list = []


def _automaton(shared: Broadcast) -> ahocorasick.Automaton:
    """The automaton of a broadcast list of terms, built once in a worker; only the last one is kept."""
    if not _BUILT or _BUILT[0] is not shared:
        made = ahocorasick.Automaton()
        for term in shared.value:
            made.add_word(term, term)
        made.make_automaton()
        _BUILT[:] = [shared, made]
    return _BUILT[1]


def _places(auto: ahocorasick.Automaton, text: str, longest: int) -> Iterator[tuple[int, str]]:
    """(begin, term) of all occurrences, overlapping ones too; pieces of a long text overlap by the longest term."""
    for at in range(0, max(len(text), 1), PIECE):
        begin = max(at - longest + 1, 0)
        for end, term in auto.iter(text[begin : at + PIECE]):
            if begin + end >= at:
                yield begin + end - len(term) + 1, term


def _blocks(terms: DataFrame, block_chars: int) -> Iterator[list[str]]:
    """The distinct terms in blocks of about ``block_chars`` characters, each collected when its turn comes."""
    distinct = terms.where("term is not null and term <> ''").select("term").distinct()
    chars = distinct.agg(F.sum(F.length("term"))).first()[0] or 0
    blocks = -(-chars // block_chars)
    for i in range(blocks):
        yield [r.term for r in distinct.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == i).collect()]


def find_terms(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", first: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, pos, term): the places, from 0 in code points, of each term of terms(term) in each text; with ``first`` the first one only.

    Occurrences inside words and overlapping ones count; letters are compared as they are. Texts are read once for each
    ``block_chars`` characters of terms, however many terms that is. Null texts hold nothing, null and empty terms are left
    out, repeated terms count once, rows with null key keep it, repeated rows each give their own; empty tables give no row.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, pos long, term string"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(terms, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        longest = max(map(len, block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, longest=longest) -> Iterator[pa.RecordBatch]:
            auto = _automaton(shared)
            for b in batches:
                rows: tuple[list, list, list] = ([], [], [])
                for i, value in enumerate(b.column(1)):
                    seen = set()
                    for pos, term in _places(auto, value.as_py() or "", longest):
                        if first and term in seen:
                            continue
                        seen.add(term)
                        for column, x in zip(rows, (i, pos, term)):
                            column.append(x)
                        if len(rows[0]) >= 1 << 16:
                            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[0])), pa.array(rows[1]), pa.array(rows[2])], names=[key, "pos", "term"])
                            rows = ([], [], [])
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[0])), pa.array(rows[1]), pa.array(rows[2])], names=[key, "pos", "term"])

        found = docs.select(key, text).mapInArrow(run, schema)
        out = out.unionByName(found)
    return out


def synonym_table(spark: SparkSession, synonyms: dict[str, list[str]]) -> DataFrame:
    """(term_no, syn_no, term, syn) of a dictionary, in its order."""
    rows = [(i, j, t, s) for i, (t, many) in enumerate(synonyms.items()) for j, s in enumerate(many)]
    return spark.createDataFrame(rows, "term_no int, syn_no int, term string, syn string")
