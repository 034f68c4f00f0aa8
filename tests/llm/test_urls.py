from pyspark.sql import functions as F
from quarrysift.llm import urls as U

URLS = [
    None, "", "no scheme", "http://", "http://Example.COM/en/7x?b=2&a=1#f", "https://user@www.example.com:443/en/7/?a=1&utm_source=x&b=2", "http://a.net/de/8", "http://sub.example.net/de/81",
    "http://example.net/de/8", "http://badexample.net/de/8", "http://x.org/es/", "http://x.org/es", "HTTP://X.ORG/es/\nline", "a://b://c/d", "http://m.spam.tld/p/", "http://spam.tld/p?#", "http://com/en/1", "http://example.com/EN/7",
]


def slow(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for what, h, p in U.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, what)
    return host, path, best


def test_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "x", True) for i, u in enumerate(URLS + URLS)], "page_id long, url string, host string, listed boolean")
    listed = spark.createDataFrame([("https://www.spam.tld/p",), (None,), ("https://www.spam.tld/p",)], "url string")
    rows = U.listed_verdicts(pages, listed, U.RULES).select("page.page_id", F.col("host"), "path", "rule", "verdict", "listed").collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        host, path, best = slow(URLS[r.page_id % len(URLS)])
        on = URLS[r.page_id % len(URLS)] in ("http://m.spam.tld/p/", "http://spam.tld/p?#")
        assert (r.host, r.path, r.rule, r.verdict, r.listed) == (host, path, best and best[0], best[1] if best else "block" if on else "allow", on)


def test_filter_lets_every_member_through_and_no_list(spark):
    pages = spark.range(3000).selectExpr("id page_id", "concat('http://h.tld/', id) url")
    got = U.listed_verdicts(pages, pages.filter("page_id % 3 = 0"), []).select("page.page_id", "listed", "rule").collect()
    assert all(r.listed == (r.page_id % 3 == 0) and r.rule is None for r in got) and len(got) == 3000
    none = U.listed_verdicts(pages, pages.limit(0), [])
    assert none.filter("verdict = 'allow'").count() == 3000
    assert U.listed_verdicts(pages.limit(0), pages, U.RULES).count() == 0
