"""Tokens, ids and small text rewrites as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "一-鿿"
TOKEN = f"[A-Za-z0-9_+#.\\-]+|[{CJK}]"
TERM = f"[A-Za-z0-9_]{{2,}}|[{CJK}]{{2,}}"
HASH_SIZE = 2_000_003


def contains_any(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    """Whether any of ``words`` is a substring."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def words_found(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    """Those of ``words`` that are substrings, in list order."""
    return F.filter(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(text, w)) if words else F.array().cast("array<string>")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def _cjk(token: Column) -> Column:
    return (F.length(token) == 1) & (token >= CJK[0]) & (token <= CJK[-1])


def tokenize(text: Column) -> Column:
    """Lower-cased word tokens and single CJK characters, followed by a pair for every two CJK tokens that are neighbours.

    The tokens are bound to a lambda's variable, so they are made once; pairs zip them with themselves, one place on.
    """
    raw = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)
    both = lambda a, b: F.when(_cjk(a) & _cjk(b), F.concat(a, b))
    pairs = lambda r: F.array_compact(F.zip_with(r, F.slice(r, 2, F.size(r)), both))
    made = F.flatten(F.transform(F.array(raw), lambda r: F.concat(r, pairs(r))))
    return F.coalesce(F.when(text.rlike(f"[{CJK}]"), made).otherwise(raw), F.array().cast("array<string>"))


def terms(text: Column) -> Column:
    """Distinct coarse terms: Latin words and CJK runs of two or more characters, with the runs' pairs."""
    raw = F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)
    pairs = F.flatten(F.transform(F.filter(raw, lambda t: t.rlike(f"^[{CJK}]+$")), lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))))
    return F.array_distinct(F.when(text.rlike(f"[{CJK}]{{2}}"), F.concat(raw, pairs)).otherwise(raw))


def term_index(term: Column, size: int = HASH_SIZE) -> Column:
    """Sparse index of a term: the first 64 bits of its MD5 modulo ``size``."""
    return F.pmod(F.conv(F.substring(F.md5(term), 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(size).cast("decimal(20,0)")).cast("long")


def key_hash(*parts: Column, size: int = 20, sep: str = "|") -> Column:
    """Leading hex digits of the SHA-1 of the parts joined by ``sep``."""
    return F.substring(F.sha1(F.concat_ws(sep, *parts)), 1, size)


def compress(text: Column, most: int) -> Column:
    """Head (72 %) and tail of a text longer than ``most``, with a mark between."""
    t = F.regexp_replace(F.trim(text), "\n{3,}", "\n\n")
    head = int(most * 0.72)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, head)), F.lit("\n...\n"), F.ltrim(F.right(t, F.lit(most - head - 8)))))


def clip(text: Column, most: int) -> Column:
    """The text, cut to ``most`` characters with an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("..."))).otherwise(text)


def pick(sorted_values: Column, share: float) -> Column:
    """The value at index round((n - 1) * share), halves to even, of a sorted array."""
    n = F.size(sorted_values)
    return F.when(n > 0, F.get(sorted_values, F.bround((n - 1) * F.lit(share), 0).cast("int")))
