from titrate.llm import url_filter

URLS = [
    None, "", "no scheme", "http://", "http://COM/", "http://com", "https://Example.COM/en/x", "https://example.com/en", "https://www.example.com/en/1?q#f",
    "https://a.www.example.com/en/1", "http://notexample.com/en/", "http://x.net/es/1", "http://net/fr/", "http://a.net/de/", "http://a.net?x=/es/", "http://a.net#/es/",
    "ftp://u:p@b.net:80/es/", "x://y://z.net/es/", "http://é.NET/fr/ü\nz", "http://.net/es/", "http://a.b..com//", "http://" + "a." * 3000 + "net/es/" + "x" * 9000,
]
RULES = [*url_filter.RULES, ("com", "/", "allow"), (None, "/", "block"), ("org", None, "block"), ("b.org", "/ab", "allow"), ("org", "/abcd", "block"), ("org", "", "allow")]


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if h is not None and p is not None
            and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_agrees_with_brute_force(spark):
    urls = [*URLS, "http://b.org/abcde", "http://b.org/ab", "http://c.org", "http://c.org/x"] * 2
    pages = spark.createDataFrame([(k, u, "h", "p", "d") for k, u in enumerate(urls)], "page_id bigint, url string, host string, Path string, digest string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {k: brute(u, RULES) for k, u in enumerate(urls)} and len(got) == len(urls)


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in url_filter.judge(pages, none, default="block").collect()] == [(1, "http://a.com/", "a.com", "/", None, "block")]
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark)).count() == 0
