import numpy as np

from pathloom.llm import bloom, common, queries, url_filter

URLS = [
    None,
    "",
    "no scheme",
    "http://",
    "http://EXAMPLE.com/en/x?y#z",
    "http://www.Example.com/en/",
    "https://a.b.example.com/en/",
    "http://example.com/fr/",
    "http://notexample.com/en/",
    "x://net/es/1",
    "x://a.net/fr/?q",
    "x://a.net/fr",
    "http://com",
    "http://com/",
    "http://a.com?x/en/",
    "http://a.org/en/",
    "http://a.org://b.com/en/",
    "http://é.com/\n/x",
    "http://example.com./en/",
    "http://.com/x",
]


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[2:]) if fits else (host, path, None, default)


def test_rules(spark):
    rules = url_filter.parse_rules(queries.RULES)
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    rows = url_filter.judge(pages, url_filter.rule_table(spark, rules)).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(URLS[r["page_id"] % len(URLS)], rules)


def test_many_rules_join_over_a_shuffle(spark, monkeypatch):
    rules = [(f"h{i}.Example.com", "/" + "x" * (i % 3), "block" if i % 2 else "allow") for i in range(200)]
    urls = [f"http://w.h{i}.example.com/{'x' * (i % 4)}y" for i in range(400)] + [None] * 50 + ["http://h3.example.com/"] * 99
    lowered = [(h.lower(), p, v) for h, p, v in rules]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = sorted((i, *brute(u, lowered)[2:]) for i, u in enumerate(urls) if brute(u, lowered)[2])
    for most in (100_000, 10):
        monkeypatch.setattr(common, "MOST_HOT", most)
        rows = url_filter.judge(pages, url_filter.rule_table(spark, rules)).collect()
        assert sorted((r["page_id"], r["rule"], r["verdict"]) for r in rows if r["rule"]) == want
        assert len(rows) == len(urls)


def test_odd_columns(spark):
    columns = "page_id long, url string, __url string, row_ int, keys_ string, c0_ map<string,int>, Verdict int"
    pages = spark.createDataFrame(
        [(i, u, "x", 1, "k", {"a": i}, 5) for i, u in enumerate(["http://a.com/x", None, "http://b.org/"])],
        columns,
    )
    rules = url_filter.rule_table(spark, [("com", "", "block"), ("com", "", "allow"), (None, "/", "block"), ("org", "/", None)])
    out = url_filter.judge(pages, rules)
    assert out.columns == ["page_id", "url", "__url", "row_", "keys_", "c0_", "host", "path", "rule", "verdict"]
    got = sorted((r["page_id"], r["c0_"]["a"], r["rule"], r["verdict"]) for r in out.collect())
    assert got == [(0, 0, "com", "allow"), (1, 1, None, "allow"), (2, 2, None, "allow")]


def test_hashes_are_sparks(spark):
    texts = ["", "a", "7:example", "é漢", "x" * 100]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").selectExpr("i", "xxhash64(t) AS h").collect()
    assert url_filter._hashes(texts).tolist() == [r["h"] for r in sorted(rows)]


def test_empty(spark):
    rules = url_filter.rule_table(spark, [])
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [tuple(r)[2:] for r in url_filter.judge(pages, rules).collect()] == [("a.com", "/", None, "allow")]
    some = url_filter.rule_table(spark, [("a.com", "/", "block")])
    assert url_filter.judge(pages.limit(0), some).count() == 0


def test_bloom_holds_all_keys_and_few_others(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) AS h")
    filled = bloom.build(keys, 5000)
    mine = np.array([r["h"] for r in keys.collect()])
    assert bloom.may_hold(filled, mine).all()
    others = np.array([r["h"] for r in spark.range(10**6, 10**6 + 20000).selectExpr("xxhash64(id) AS h").collect()])
    assert bloom.may_hold(filled, others).mean() < 0.02
