import re

from peakloom.llm import url_rules


def brute(url, rules, default="allow"):
    m = re.search("://", url or "")
    rest = url[m.end() :] if m else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[2] if fits else None, max(fits)[3] if fits else default


URLS = [
    None, "", "no scheme", "http://", "http://com/", "https://COM", "http://a.com/x?y#z", "http://example.com/en/1", "http://www.example.com/en/1#t",
    "http://a.www.example.com/en/", "http://notexample.com/en/", "http://example.net/fr/2", "http://example.net/de/", "x://y://z/en/", "http://example.com./en/",
    "http://example.com?/en/", "http://ÉXAMPLE.com/é", "http://../", "http://net/es/", "http://com.example/en/", "http://example-a.com/en/",
]


def judged(spark, urls, rules=url_rules.RULES, **options):
    pages = spark.createDataFrame([(k, u, "h", "p", "r") for k, u in enumerate(urls)], "page_id long, url string, host string, path string, rule string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, rules, **options).collect()}


def test_against_brute_force(spark):
    assert judged(spark, URLS) == {k: brute(u, url_rules.RULES) for k, u in enumerate(URLS)}


def test_many_rules_over_many_partitions(spark):
    rules = [("com", "/", "allow"), ("b.com", "/", "block"), ("a.b.com", "/x/", "allow"), ("b.com", "/x/y", "block"), ("c.com", "/", "block"), ("z.a.b.com", "/", "block"), ("org", "/q", "block")]
    hosts = ["com", "b.com", "a.b.com", "q.a.b.com", "z.a.b.com", "c.com", "d.c.com", "org", "x.org", "bb.com", "de"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/x/", "/x/y/z", "/q?x")] * 3
    assert judged(spark, urls, rules, partitions=9) == {k: brute(u, rules) for k, u in enumerate(urls)}


def test_nested_paths_over_many_partitions(spark):
    rules = [("com", p, v) for p, v in (("", "allow"), ("/", "block"), ("/a", "allow"), ("/a/b", "block"), ("/ab", "allow"), ("/b", "block"), ("/é", "allow"))]
    rules += [("x.com", p, v) for p, v in (("/a", "block"), ("/a/b/c", "allow"), ("/a", "allow"))] + [("y.x.com", "/a/b/c/d", "block")]
    paths = ["", "/", "/a", "/a/", "/a/b", "/a/b/c/d/e", "/ab/b", "/az", "/b", "/c", "/é/x", "/e"]
    urls = [f"http://{h}{p}" for h in ("com", "x.com", "y.x.com", "z.y.x.com", "xcom", "org") for p in paths] * 2
    want = {k: brute(u, rules) for k, u in enumerate(urls)}
    for partitions in (1, 5, 17):
        assert judged(spark, urls, rules, partitions=partitions) == want


def test_many_paths_of_one_host_and_a_hot_host(spark):
    rules = [("hot.com", f"/p/{k:05d}", "block" if k % 2 else "allow") for k in range(20_000)] + [("com", "/p/", "block")]
    urls = [f"http://www.hot.com/p/{k % 21_000:05d}/x" for k in range(4000)] + [f"http://h{k}.com/p/" for k in range(500)] + ["http://hot.com/"] * 50
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge_urls(pages, rules, partitions=6).collect()}
    for k, u in enumerate(urls):
        if k < 4000:
            assert got[k] == (f"hot.com/p/{k:05d}", "block" if k % 2 else "allow")
        else:
            assert got[k] == (("com/p/", "block") if k < 4500 else (None, "allow"))


def test_empty(spark):
    assert judged(spark, []) == {}
    assert judged(spark, ["http://a.com/"], ()) == {0: ("a.com", "/", None, "allow")}
