from labelloom.llm.url_rules import judge_urls

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("a.org", "/x", "block"),
    ("org", "/xab", "allow"),
    ("b.org", "/t", "allow"),
    ("b.org", "/t", "block"),
]
URLS = [
    None,
    "",
    "no scheme.com/",
    "http://",
    "http://com",
    "http://com/",
    "HTTP://WWW.Example.COM/en/page?x=/es/",
    "https://example.com/en/1#top",
    "https://m.example.com/en/",
    "https://example.com/EN/",
    "https://notexample.com/en/",
    "http://x.net/es/1",
    "http://x.net/es",
    "http://x.net?/es/",
    "http://x.net#://y.com/",
    "http://a.org/xabc",
    "http://b.a.org/xa",
    "http://b.org/t",
    "http://Ü.net/es/",
    "http://u://x.net/es/",
    "http://.com/",
]


def brute_force(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [
        (len(h) + len(p), len(h), verdict, h + p)
        for h, p, verdict in RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def judged(spark, urls, rules=RULES, **options):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    return {r["page_id"]: tuple(r)[1:] for r in judge_urls(pages, rules, **options).collect()}


def test_equals_brute_force(spark):
    want = {i: brute_force(url) for i, url in enumerate(URLS)}
    assert judged(spark, URLS) == want


def test_a_rule_table_too_large_to_broadcast(spark):
    want = {i: brute_force(url) for i, url in enumerate(URLS)}
    assert judged(spark, URLS, broadcast_rows=0) == want


def test_without_rules_or_with_null_ones(spark):
    assert judged(spark, URLS[4:7], []) == judged(spark, URLS[4:7], [(None, "/", "block")])
    assert {r[3] for r in judged(spark, URLS, []).values()} == {"allow"}


def test_repeated_and_null_ids_and_clashing_columns(spark):
    pages = spark.createDataFrame(
        [(1, "http://x.net/es/", "h"), (1, "http://x.net/es/", "h"), (None, None, None)],
        "page_id bigint, url string, host string",
    )
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    rows = sorted(map(tuple, judge_urls(pages, rules).collect()), key=str)
    blocked = (1, "x.net", "/es/", "net/es/", "block")
    assert rows == [blocked, blocked, (None, "", "", None, "allow")]


def test_empty_table(spark):
    assert judged(spark, []) == {}


def test_a_very_long_url(spark):
    url = "http://" + "a." * 500 + "net/es/" + "x" * 100_000
    assert judged(spark, [url])[0][2:] == ("net/es/", "block")
