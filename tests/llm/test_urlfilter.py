import random

from ragmill.llm.urlfilter import RULES, Trie, judge_urls, keep_allowed, op13_urlfilter

RULE_SCHEMA = "verdict string, host string, path string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute(url, rules, default="allow"):
    host, path = split(url)
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, default))
    return host, path, best[3], best[4]


def test_registered_query(spark):
    d = "/root/testdata/sf0.001"
    got = {r.page_id: tuple(r)[1:] for r in op13_urlfilter(spark, d).collect()}
    assert got == {r.page_id: brute(r.url, RULES) for r in spark.read.parquet(f"{d}/pages.parquet").collect()}


def test_random_rules_and_blocks(spark):
    rng = random.Random(3)
    label = lambda: rng.choice(["a", "b", "com", "org", "É", ""])
    segment = lambda: rng.choice(["", "e", "en", "en1", "é"])
    host = lambda: ".".join(label() for _ in range(rng.randint(1, 3)))
    path = lambda: "".join("/" + segment() for _ in range(rng.randint(0, 3)))
    rules = [(rng.choice(["allow", "block"]), host(), path()) for _ in range(120)]
    urls = [rng.choice(["http", "", "x"]) + "://" + host() + path() + rng.choice(["", "?q=/en", "#x", "?"]) for _ in range(600)]
    urls += [None, "", "a.com/en", "http://A.COM/En", "http://a.com", "http://a.com?x://b.org/", "x://a.com\n.org/\n/en", "http:///en", "http://" + "a." * 5000 + "com" + "/en" * 5000]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    table = spark.createDataFrame(rules + rules[:5], RULE_SCHEMA)
    want = {i: brute(u, rules) for i, u in enumerate(urls)}
    for chars in (4_000_000, 400):
        got = {r.page_id: tuple(r)[1:] for r in judge_urls(pages, table, block_chars=chars).collect()}
        assert got == want
    assert len({v[2] for v in want.values()}) > 20


def test_edges(spark):
    rules = spark.createDataFrame([("block", "A.com", "/x"), ("allow", "a.com", "/x"), (None, "com", "/"), ("block", None, "/y"), ("allow", "b.com", None)], RULE_SCHEMA)
    rows = [(1, "http://a.com/xy", "h", "r", 9), (1, "http://a.com/xy", "h", "r", 9), (None, "http://b.com", None, None, None), (2, "http://c.com/y", "h", "r", 1), (3, None, "h", "r", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, verdict int")
    got = sorted(map(tuple, judge_urls(pages, rules).collect()), key=str)
    assert got == sorted([(1, "a.com", "/xy", "a.com/x", "block")] * 2 + [(None, "b.com", "", "b.com", "allow"), (2, "c.com", "/y", "/y", "block"), (3, "", "", None, "allow")], key=str)
    kept = keep_allowed(pages, rules)
    assert kept.columns == pages.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([rows[2], rows[4]], key=str)
    assert {r.verdict for r in judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}
    assert judge_urls(pages.limit(0), rules).count() == 0 and keep_allowed(pages.limit(0), rules).count() == 0


def test_longest_in_trie():
    trie = Trie([("allow", "org", "/"), ("block", "x.org", "/en/1"), ("block", "x.org", "/e")])
    at = lambda h, p: (trie.longest(trie.hosts(h), p) or (0, 0, None))[2]
    assert [at("a.x.org", p) for p in ("/en/12", "/en/2", "/es", "/", "")] == ["x.org/en/1", "x.org/e", "x.org/e", "org/", None]
    assert at("ax.org", "/en/1") == "org/" and at("org", "/q") == "org/" and at("orgs", "/") is None
