import random
from collections import Counter

from flowscope.llm.url_filter import QUERY_RULES, judged, op10
from pyspark.sql import functions as F


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def test_op10_against_brute_force(spark, tiny):
    want = sorted((r.page_id, *brute(r.url, QUERY_RULES)) for r in spark.read.parquet(f"{tiny}/pages.parquet").collect())
    assert sorted(tuple(r) for r in op10(spark, tiny).collect()) == want


def test_nested_rules_and_hot_hosts(spark):
    rng = random.Random(8)
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in [(rng.choice(["org", "a.org", "b.a.org", "com", "x.com"]), rng.choice(["", "/", "/a", "/a/", "/a/b", "/a/bc", "/ab", "/a/b/c"])) for _ in range(60)]}.values())
    urls = [(i, "http://" + rng.choice(["a.org", "A.org", "b.a.org", "z.b.a.org", "x.com", "y.x.com", "org", "aorg", "net", "org:80"]) + rng.choice(["", "/", "/a", "/a/b", "/a/bcd", "/a/b/c/d", "/ab?q=/a", "/b#/a", "?x", "/\U0001f600"])) for i in range(600)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    for sweep in (100_000, 7):  # without and with salts
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged(pages, spark.createDataFrame(rules, "host string, path string, action string"), sweep=sweep).collect()}
        assert got == {i: brute(u, rules) for i, u in urls}


def test_paths_that_go_on_with_the_last_characters(spark):
    rules = [("a.org", "/x/", "block"), ("a.org", "/x/\u00ff", "allow"), ("org", "/x/\U0010ffff", "allow"), ("org", "x", "block"), ("org", "", "allow")]
    urls = [(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in ("a.org", "b.org", "w.a.org") for p in ("/x/\U0010ffffz", "/x/\u00ff\u00ff", "/x", "/x/", "/y", "", "/x0", "/x\U0010ffff", "/x/\u0100"))]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged(pages, spark.createDataFrame(rules, "host string, path string, action string")).collect()}
    assert got == {i: brute(u, rules) for i, u in urls}


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "no scheme/a", "x"), (2, "http://", "x"), (3, "ftp://org/" + "a" * 100000, "x"), (3, "ftp://org/" + "a" * 100000, "x")], "page_id long, url string, host string")
    rules = spark.createDataFrame([("org", "/", "block"), ("org", "/", "allow"), (None, "/", "block"), ("org", None, "allow")], "host string, path string, action string")
    got = sorted((r.page_id or 0, r.host, len(r.path), r.rule, r.verdict) for r in judged(pages, rules).collect())
    assert [x[3:] for x in got] == [(None, "allow")] * 4 + [("org/", "block")] * 2
    assert judged(pages, rules.filter("false"), "block").filter("verdict = 'block'").count() == 6 and judged(pages.filter("false"), rules).count() == 0


def test_urls_that_most_rows_have(spark):
    rows = [(i, "http://Hot.example.org/es/x") for i in range(300)] + [(1000 + i, None) for i in range(300)] + [(2000 + i, f"http://h{i}.com/fr/") for i in range(50)]
    rows += [(3000, "no url"), (None, "http://x.org/"), (None, "http://x.org/")]
    rules = spark.createDataFrame([("example.org", "/es/", "block"), ("org", "/", "allow"), ("com", "/fr/", "block")], "host string, path string, action string")
    urls = spark.createDataFrame(rows, "page_id long, url string").withColumns({"n": F.lit(1), "top": F.lit(2), "_fs_url": F.lit("x")})
    got = judged(urls, rules).collect()
    assert len(got) == len(rows) and Counter((r.rule, r.verdict) for r in got) == {("example.org/es/", "block"): 300, (None, "allow"): 301, ("com/fr/", "block"): 50, ("org/", "allow"): 2}
