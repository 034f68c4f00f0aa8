import datetime as dt

import pytest
from pyspark.sql import functions as F
from quarrysift.functions import text as T
from quarrysift.functions import urls as U
from quarrysift.operators import chunking, ranking, refine, results
from quarrysift.plans import control, output
from quarrysift.sources import feeds, normalise, topics

NOW = dt.datetime(2024, 3, 1)
DDL = "ord long, url string, title string, snippet string, source string, ts timestamp, metadata map<string,string>"


def one(spark, column, *values):
    return spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x")).alias("y")).collect()


def frame(spark, rows):
    return spark.createDataFrame([(i, u, t, s, "brave", NOW, {}) for i, (u, t, s) in enumerate(rows)], DDL)


@pytest.mark.parametrize("url,want", [
    ("https://shop.test/item?gclid=q7&size=9&utm_term=boots", "https://shop.test/item?size=9"), ("http://www.shop.test/item", "http://shop.test/item"),
    ("https://shop.test/faq#returns", "https://shop.test/faq"), ("https://shop.test/faq/", "https://shop.test/faq"), ("https://shop.test/s?sort=up&brand=k&brand=a", "https://shop.test/s?brand=k&brand=a&sort=up"),
    ("No Scheme Here", "no scheme here"), ("https://shop.test", "https://shop.test/"), ("http://u:p@WWW.Ex.com:8080/A/?ref=x", "http://ex.com/A"),
])
def test_normalized_url(spark, url, want):
    assert one(spark, U.normalized, url)[0].y == want


def test_fingerprint_and_similarity(spark):
    fox = "boatspastsail|boatssailsmall|boatssevensmall|greypastrocks|greypastsail"
    got = [r.y for r in one(spark, T.fingerprint, "Seven small boats sail past grey rocks", "Hello World Test", "Hi", "Test A snippet", "")]
    assert got == [fox, "hellotestworld", "hi", "test a snippet", ""]
    pair = spark.createDataFrame([("", ""), (fox, fox), ("a|b", "b|c")], "a string, b string").select(T.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in pair] == [1.0, 1.0, pytest.approx(1 / 3)]


def test_authority_and_recency(spark):
    urls = ["https://github.com/x", "https://en.wikipedia.org/", "https://nasa.gov", "https://nature.com/a", "https://some.net", "not-a-url", "https://notgithub.com"]
    assert [r.y for r in one(spark, ranking.authority, *urls)] == [1.0, 1.0, 0.9, 0.8, 0.5, 0.3, 0.5]
    now = F.lit(NOW)
    r = spark.range(1).select(ranking.recency(now, now).alias("a"), ranking.recency(now - F.make_interval(years=F.lit(2)), now).alias("b")).first()
    assert (r.a, r.b) == (1.0, 0.1)


def test_relevance(spark):
    df = frame(spark, [("https://a.b/", "TypeScript Handbook", "the typescript handbook"), ("https://a.b/", "Handbook only", "x"), ("https://a.b/", "x", "typescript"), ("https://a.b/", "x", "y")])
    rel = lambda q: [round(r.s, 6) for r in df.select(ranking.relevance(F.col("title"), F.col("snippet"), q).alias("s")).collect()]
    assert rel("typescript handbook") == [1.0, 0.3, 0.2, 0.0] and rel("") == [0.5] * 4


def test_bm25(spark):
    df = frame(spark, [("u", "red apple", "red"), ("u", "green pear", "pear tree here"), ("u", "blue", "")])
    got = {r.ord: r.bm25_score for r in ranking.bm25(df, "red red").collect()}
    import math

    n, dl, avg, tf = 3, 5, (5 + 7 + 2) / 3, 3
    want = 2 * math.log(1 + (n - 1 + 0.5) / 1.5) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got[0] == pytest.approx(want) and got[1] == got[2] == 0
    assert ranking.bm25(df.limit(0), "red").count() == 0


def test_deduplicate(spark):
    rows = [(0, "https://www.a.com/x?utm_source=1", "same title words", "body", "brave", NOW, {"k": "first", "a": "1"}), (1, "https://a.com/x/", "same title words", "body", "rss", NOW, {"k": "late"}), (2, "https://b.com", "other", "", "serp", NOW, None)]
    got = sorted(results.deduplicate(spark.createDataFrame(rows, DDL)).collect(), key=lambda r: r.ord)
    assert [r.ord for r in got] == [0, 2] and got[0].metadata == {"k": "late", "a": "1"} and got[0].sources == ["brave", "rss"] and got[1].sources is None and [r.copies for r in got] == [2, 1] and got[1].metadata is None


def test_similar_pairs_against_all_pairs(spark):
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    texts = [" ".join(words[(i * k) % 6] for k in range(1, 5 + i % 4)) for i in range(25)]
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, t string").select("ord", T.fingerprint(F.col("t")).alias("sketch"))
    sets = [set(r.sketch.split("|")) for r in df.orderBy("ord").collect()]
    for least in (0.3, 0.5, 0.85, 1.0):
        name = [sets.index(x) for x in sets]
        want = {(name[i], i) for i in range(25) if name[i] != i}
        want |= {(i, j) for i in range(25) for j in range(i + 1, 25) if name[i] == i and name[j] == j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least}
        assert {(r.i, r.j) for r in results.similar_pairs(df, least).collect()} == want


def test_suggestions(spark):
    df = frame(spark, [("https://example.com/1", "TypeScript tutorial for beginners", "x"), ("https://example.com/2", "Advanced TypeScript patterns", "patterns")])
    got = [(r.term, round(r.score, 6), r.source, r.frequency) for r in refine.suggestions(df, "typescript").collect()]
    assert got[:5] == [(t, 1.2, "combined", 2.0) for t in ("typescript tutorial", "tutorial for", "for beginners", "advanced typescript", "typescript patterns")]
    assert {g[0] for g in got[5:8]} == {"tutorial", "beginners", "advanced"} and ("example", 0.595, "domain", 1.0) in got


def test_chunks():
    rows = "\n".join("total += 7 * n" for _ in range(20))  # 15 characters with the line's end
    assert [c[:2] for c in chunking.lines(rows, 100, 10)] == [(1, 6), (7, 12), (13, 18), (19, 20)]
    assert [c[:2] for c in chunking.block_lines("a\nbb\n", 11, 3)] == [(11, 11), (12, 12), (13, 13)]
    big = "class A:\n    x = 1\n    def g(self):\n        return 1\n    def h(self):\n        return '" + "y" * 80 + "'\n"
    got = {(c[3], c[4], c[2][-16:]) for c in chunking.code(big + "# pad\n", "python", 60, 1) if c[4] in ("g", "h")}
    assert ("function", "h", "\n// ... truncated"[-16:]) in got and any(k == "function" and n == "g" for k, n, _ in got)
    assert chunking.code("def f():\n    pass", "python")[0][3] == "full"
    assert [c[4] for c in chunking.code("class A:\n    def g(self):\n        return 1\n" + "# pad\n" * 20, "python", 60, 1)] == ["A", "g"]


def test_sources(spark):
    now = F.lit(NOW)
    answer = '{"AbstractURL":"https://a","AbstractText":"t","Heading":"H","RelatedTopics":[{"Text":"one - x","FirstURL":"https://1","Result":"<a href=z>One</a>"},{"Topics":[{"Text":"two","FirstURL":"https://2"}]}]}'
    df = spark.createDataFrame([(answer,)], "payload string")
    assert [(r.url, r.title) for r in topics.instant_answers(df, now).orderBy("ord").collect()] == [("https://a", "H"), ("https://1", "One"), ("https://2", "two")]
    news = '{"web":{"results":[{"title":"a","url":"https://a.org","age":"2 days ago"},{"title":"b","url":"https://b.net"}]},"news":{"results":[{"title":"n","url":"https://n.net"}]}}'
    got = normalise.web_and_news(spark.createDataFrame([(news,)], "payload string"), now, include=["a.org"]).collect()
    assert [(r.title, r.ts) for r in got] == [("a", dt.datetime(2024, 2, 28)), ("n", NOW)]
    wiki = '{"query":{"search":[{"title":"New York","snippet":"<b>x</b> y"}]}}'
    assert normalise.adapter("wikipedia", spark.createDataFrame([(wiki,)], "payload string"), now).first()[1:4] == ("https://en.wikipedia.org/wiki/New_York", "New York", "x y")
    with pytest.raises(Exception, match="no key"):
        normalise.organic(spark.createDataFrame([('{"error":"no key"}',)], "payload string"), now).collect()


def test_control(tmp_path):
    clock = [0.0]
    b = control.TokenBucket(0.5, lambda: clock[0])
    assert [b.try_acquire(), b.try_acquire()] == [True, False]
    clock[0] = 1
    assert not b.try_acquire()
    clock[0] = 2
    assert b.try_acquire()
    c = control.FileCache(str(tmp_path), 1000, lambda: clock[0])
    c.set("k", [1])
    (tmp_path / "bad.json").write_text("{")
    assert c.get("k") == [1] and c.prune() == 1
    clock[0] = 4
    assert c.get("k") is None and c.prune() == 1
    assert control.parse_selection("1,3-5,7,x,0-2,9", 7) == [1, 3, 4, 5, 7]
    assert c.get("k") is None and c.stats()["entries"] == 0
    c.set("z", {"a": 1})
    assert c.stats()["entries"] == 1 and c.stats()["bytes"] > 0 and c.clear() == 1
    slept = []
    b = control.TokenBucket(0.5, lambda: clock[0] + sum(slept))
    b.acquire(slept.append)
    b.acquire(slept.append)
    assert slept == [2.0] and b.tokens == 0
    k = control.Categories()
    k.add("Own", ["own."])
    k.add("Own", ["mine."])
    assert k.names()[-1] == "Own" and k.rules[-1][1] == ["mine."] and len(control.Categories().rules) == len(k.rules) - 1
    k.remove("Own")
    assert "Own" not in k.names()


def test_session_and_report(spark):
    s = control.Session(lambda q: frame(spark, [("https://a.com/1", f"{q} guide [x]", "text"), ("https://b.com", "other thing", "z")]), F.lit(NOW))
    s.search("apple")
    s.search("apple")
    assert s.found.count() == 2 and s.depth == 2
    text = output.markdown(s.final(), "apple", "2024-03-01")
    assert text.index("apple guide \\[x\\]") < text.index("other thing")
    assert output.render("{{q}}:{{#each results}}<{{t}}>{{/each}}", {"q": "$1"}, [{"t": "a"}, {"t": "b"}]) == "$1:<a><b>"


def test_plans(spark):
    df = frame(spark, [("https://a.com/1", "t", "s")])
    plan = ranking.top(ranking.scored(df, "t", F.lit(NOW)), ["score"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan


def test_empty_query_vector(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert ranking.nearest(e, e.filter("vec_id = 9")).count() == 0
    assert [(r.vec_id, r.similarity) for r in ranking.nearest(e, e.filter("vec_id = 1")).collect()] == [(1, 1.0), (2, 0.0)]
    import math

    loose = {r.vec_id: r.similarity for r in ranking.similarities(e, spark.createDataFrame([([2.0, 0.0, 5.0],)], "embedding array<double>"), strict=False).collect()}
    assert loose[1] == 1.0 and math.isnan(loose[2])


def test_feeds_and_pages(spark):
    now, xml = F.lit(NOW), lambda *p: spark.createDataFrame([(x,) for x in p], "payload string")
    rss = """<rss><channel><title>c</title><item><title>A &amp; B</title><link>https://a.test/1</link><description><![CDATA[<b>red</b>  text]]></description><pubDate>Tue, 02 Jan 2024 03:04:05 +0100</pubDate><dc:creator>Kim</dc:creator></item>
      <item><title>no link</title></item></channel></rss>"""
    atom = '<feed><entry><title>E</title><link rel="x" href="https://a.test/2"/><summary>blue</summary><updated>2024-01-05T00:00:00Z</updated><author><name>Lee</name></author></entry></feed>'
    got = feeds.feed(xml(rss), now).collect()
    assert [(r.url, r.title, r.snippet, r.ts, r.metadata) for r in got] == [("https://a.test/1", "A & B", "red text", dt.datetime(2024, 1, 2, 2, 4, 5), {"author": "Kim"})]
    (r,) = feeds.feed(xml(atom), now).collect()
    assert (r.url, r.snippet, r.ts, r.metadata) == ("https://a.test/2", "blue", dt.datetime(2024, 1, 5), {"author": "Lee"})
    assert feeds.feed(xml("no xml", None), now).count() == 0
    page = '<a class="result-link" href="/ad">Ad</a><td class="result-snippet">s0</td><a class="result-link" href="https://b.test">B <b>b</b></a><td class="result-snippet"> s1 &lt; </td>'
    assert [(r.url, r.title, r.snippet) for r in normalise.lite_page(xml(page), now).collect()] == [("https://b.test", "B b", "s1 <")]
    answer = '{"AbstractURL":"https://w","AbstractText":"t","RelatedTopics":[{"Text":"One - first thing","FirstURL":"https://1","Topics":[{"Text":"two","FirstURL":"https://2"}]},{"Text":"three","FirstURL":"https://3"}],"Results":[{"Text":"four","FirstURL":"https://4"}]}'
    assert [r.title for r in normalise.web_answers(xml(answer), now).collect()] == ["Wikipedia", "One", "two", "three", "four"]
    assert [r.title for r in normalise.web_answers(xml(answer), now, 2).collect()] == ["Wikipedia", "One"]
    paper = f"<feed><entry><id>https://p/1</id><title> T </title><summary>{'s' * 201}</summary><published>2024-02-03T00:00:00Z</published></entry><entry><id>x</id></entry></feed>"
    assert [(r.url, r.title, len(r.snippet), r.ts) for r in feeds.papers(xml(paper), now).collect()] == [("https://p/1", "T", 203, dt.datetime(2024, 2, 3))]
    hn = '{"hits":[{"url":"https://h","title":"T","points":3,"num_comments":2,"author":"a","created_at":"2024-01-01T00:00:00Z"},{"title":"no url"}]}'
    assert [r.url for r in normalise.adapter("hackernews", xml(hn), now).collect()] == ["https://h"]
    for name, body, url in (
        ("searxng", '{"results":[{"url":"https://s","title":"","content":"c"}]}', "https://s"),
        ("github", '{"items":[{"html_url":"https://g","full_name":"a/b","description":"d","stargazers_count":5,"updated_at":"2024-01-01T00:00:00Z"}]}', "https://g"),
        ("reddit", '{"data":{"children":[{"data":{"permalink":"/r/x","title":"T","selftext":"s","created_utc":1704067200.0}}]}}', "https://www.reddit.com/r/x"),
        ("stackoverflow", '{"items":[{"link":"https://o","title":"a &lt; b &amp; c","score":1,"answer_count":2,"creation_date":1704067200}]}', "https://o"),
    ):
        (r,) = normalise.adapter(name, xml(body), now).collect()
        assert r.url == url
    assert r.title == "a < b & c"
