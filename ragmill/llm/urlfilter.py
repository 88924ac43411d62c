"""URL filters: a trie over reversed host labels, then path segments; the longest allow or block entry wins."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.llm.common import materialize

#: Characters of rules in one trie that is broadcast; more rules make more tries, used one after another.
BLOCK_CHARS = 4_000_000
HOSTS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values: (verdict, host, path) of the registered query.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
DEFAULT = "allow"
_FOUND = "size int, host int, rule string, verdict string"


def url_host(url: str | Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, lower-cased in A-Z; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: str | Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


class _Node:
    """A place in a trie: what follows it by label or segment, the paths that begin here, and entries by their last, maybe partial, segment."""

    __slots__ = ("ends", "next", "paths", "sizes")

    def __init__(self):
        self.next: dict[str, _Node] = {}
        self.paths: _Node | None = None
        self.ends: dict[str, tuple] = {}
        self.sizes: list[int] = []


class Trie:
    """Entries (verdict, host, path) under reversed host labels and then the segments of the path."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root = _Node()
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.next.setdefault(label, _Node())
            node.paths = node = node.paths or _Node()
            *whole, last = path.split("/")
            for segment in whole:
                node = node.next.setdefault(segment, _Node())
            entry = (len(host) + len(path), len(host), host + path, verdict)
            node.ends[last] = max(entry, node.ends.get(last, entry))
            node.sizes = sorted({len(x) for x in node.ends}, reverse=True)

    def hosts(self, host: str) -> list[_Node]:
        """The path tries of the host and of those it is a subdomain of."""
        node, out = self.root, []
        for label in (None, *reversed(host.split("."))):
            node = node if label is None else node.next.get(label)
            if node is None:
                break
            if node.paths:
                out.append(node.paths)
        return out

    @staticmethod
    def longest(tries: list[_Node], path: str) -> tuple | None:
        """The largest entry whose path begins ``path``."""
        best = None
        for node in tries:
            for segment in path.split("/"):
                for size in node.sizes:
                    found = node.ends.get(segment[:size]) if size <= len(segment) else None
                    if found:
                        best = max(best, found) if best else found
                        break
                node = node.next.get(segment)
                if node is None:
                    break
        return best


def _matcher(shared: Broadcast):
    @F.pandas_udf(_FOUND)
    def match(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = Trie(shared.value)
        hosts = lru_cache(HOSTS)(trie.hosts)
        for host, path in parts:
            found = [trie.longest(hosts(h), p) or (None, None, None, None) for h, p in zip(host, path)]
            yield pd.DataFrame(found, columns=["size", "host", "rule", "verdict"]).astype({"size": "Int32", "host": "Int32"})

    return match


def _blocks(rules: DataFrame, block_chars: int) -> Iterator[list[tuple[str, str, str]]]:
    """The rules in blocks of about ``block_chars`` characters, each collected when its turn comes. Equal (host, path) are in one block."""
    tidy = rules.where("verdict is not null").select("verdict", F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")).distinct()
    chars = tidy.agg(F.sum(F.length("host") + F.length("path") + 16)).first()[0] or 0
    blocks = -(-chars // block_chars)
    for i in range(blocks):
        part = tidy.where(F.pmod(F.xxhash64("host", "path"), F.lit(blocks)) == i)
        yield [tuple(r) for r in part.collect()]


def _judged(pages: DataFrame, rules: DataFrame, url: str, name: str, block_chars: int) -> DataFrame:
    """``pages`` with a struct column ``name``: host, path and the entry found, null where none fits."""
    found = f"{name}_found"
    out = pages.withColumn(name, F.struct(url_host(url).alias("host"), url_path(url).alias("path"))).withColumn(found, F.lit(None).cast(f"struct<{_FOUND.replace(' ', ':').replace(',:', ',')}>"))
    for i, block in enumerate(_blocks(rules, block_chars)):
        if i:
            out = materialize(out, "judged")
        new = _matcher(pages.sparkSession.sparkContext.broadcast(block))(F.col(name)["host"], F.col(name)["path"])
        out = out.withColumn(f"{found}_new", F.when(new["rule"].isNotNull(), new)).withColumn(found, F.greatest(found, f"{found}_new")).drop(f"{found}_new")
    return out


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = DEFAULT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, host, path, rule, verdict) for each row of ``pages``.

    An entry of rules(verdict, host, path) fits its host and all subdomains where the url's path begins with its own, also
    within a segment. Of those that fit, the longest (host and path together) wins, of equally long ones that of the longer
    host; one that is in both lists blocks. Without any, rule is null and verdict is ``default``. An entry without host fits
    all hosts, one without path all paths; those without verdict are left out.

    The trie is broadcast in blocks of at most ``block_chars`` characters of rules; a table of more is used block by block,
    with the best entry kept, so its size has no bound. Pages are not shuffled. Null urls and those without ``://`` have empty
    host and path. Repeated rows and null keys stay; empty tables give no row, an empty rule table the default; other columns
    are not read.
    """
    at = "_at_9f3c"
    found = F.col(f"{at}_found")
    out = _judged(pages.select(key, F.col(url).alias("_url_9f3c")), rules, "_url_9f3c", at, block_chars)
    return out.select(key, F.col(at)["host"].alias("host"), F.col(at)["path"].alias("path"), found["rule"].alias("rule"), F.coalesce(found["verdict"], F.lit(default)).alias("verdict"))


def keep_allowed(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``pages`` whose url is allowed (see ``judge_urls``), with all their columns, of whatever name."""
    at = "_at_9f3c"
    out = _judged(pages, rules, url, at, block_chars)
    return out.where(F.coalesce(F.col(f"{at}_found")["verdict"], F.lit(default)) == "allow").select(pages.columns)


def op13_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES, "verdict string, host string, path string"))


URLFILTER_SQL = f"""
WITH rules(verdict, host, path) AS (VALUES {", ".join(str(r) for r in RULES)}),
rest AS (SELECT page_id, row_number() OVER () AS row_no, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, row_no, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
fits AS (
  SELECT row_no, r.host || r.path AS rule, verdict FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, verdict DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM parts LEFT JOIN fits USING (row_no)
"""
