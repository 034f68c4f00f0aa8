import datetime
import html
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from quarrysift import session
from quarrysift.functions import entities
from quarrysift.functions import text as T
from quarrysift.operators import cached
from quarrysift.plans import control, fetch
from quarrysift.sources import feeds, providers, topics

NOW = datetime.datetime(2024, 3, 1)


def one(spark, texts, f):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.x for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_every_entity(spark):
    """All names of the standard table, alone and inside a text."""
    names = sorted(html5)
    assert one(spark, [f"&{n}" for n in names], entities.unescape) == [html5[n] for n in names]
    assert one(spark, [f"a &{n} b" for n in names], entities.unescape) == [f"a {html5[n]} b" for n in names]


def test_references_and_other_ampersands(spark):
    texts = ["&#65;&#x42;&#X63;", "&#65 &#x41g", "&#128;&#x9f;", "&#128512;x", "&amp;lt;", "&&amp;&", "a & b &c; &nosuch; &", "&notit; &notin;", "&ampx &LTx", "&#;&#x;", "", "plain", "&lt;b&gt;é&hellip;"]
    assert one(spark, [*texts, None], entities.unescape) == [*[html.unescape(t) for t in texts], None]
    assert one(spark, ["&#0;", "&#xD800;", "&#1114112;", "&#99999999999999999999;", "&#x0000000041;"], entities.unescape) == ["�"] * 4 + ["A"]


def test_lenient_dates(spark):
    days = ["Jan 15, 2024", "January 15, 2024", "15 Jan 2024", "15 january 2024", "Mon, 15 Jan 2024 00:00:00 GMT", "1/15/2024", "2024/01/15", "2024-01-15", "2024-01-15T00:00:00Z", "2024-01-15T00:00Z", "Monday, January 15, 2024", "JAN 15 2024"]
    assert one(spark, days, T.lenient_date) == [datetime.datetime(2024, 1, 15)] * len(days)
    times = ["Jan 15, 2024 3:04 PM", "Jan 15, 2024, 3:04 pm", "15 Jan 2024 15:04", "Mon, 15 Jan 2024 16:04:00 +0100", "2024-01-15T15:04:00Z", "1/15/2024 15:04:00"]
    assert one(spark, times, T.lenient_date) == [datetime.datetime(2024, 1, 15, 15, 4)] * len(times)
    assert one(spark, ["whenever", "", None, "3 days ago", "Foo 15, 2024", "13/45/2024"], T.lenient_date) == [None] * 6
    ago = lambda fine: lambda c: T.relative_date(c, F.lit(NOW), fine)
    assert one(spark, ["2 hours ago", "2 days ago"], ago(True)) == [NOW - datetime.timedelta(hours=2), NOW - datetime.timedelta(days=2)]
    assert one(spark, ["2 hours ago", "2 days ago"], ago(False)) == [NOW, NOW - datetime.timedelta(days=2)]


def payload(spark, *texts):
    return spark.createDataFrame([(1000 * i, t) for i, t in enumerate(texts)], "ord long, payload string")


def test_feed_forms(spark):
    rss = """<?xml version="1.0"?><!-- a feed --><rss xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>C</title>
      <!-- <item><title>hidden</title><link>https://h</link></item> -->
      <item><title>One &amp; two</title><link> https://a.test/1 </link><description><![CDATA[<b>red</b> </item>]]> and <![CDATA[more]]></description><dc:creator>Kim</dc:creator><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item>
      <item><title>No address</title></item><item><link>https://a.test/2</link><content:encoded>long</content:encoded></item></channel></rss>"""
    rdf = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><channel><title>R</title></channel><item><title>t</title><link>https://r.test</link></item></rdf:RDF>'
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><title>A</title><entry><title type="html">E</title><link rel="self" href="https://x"/><link href="https://a.test/3"/><summary>blue</summary><updated>2024-01-05T00:00:00Z</updated><author><name>Lee</name></author><author><name>Kay</name></author></entry></feed>'
    df = payload(spark, rss, rdf, atom, rss[:-20], "no xml", None, "", "<html><body/></html>", "<rss><channel><title>empty</title></channel></rss>")
    got = {r.ord: r for r in feeds.feed(df, F.lit(NOW)).collect()}
    assert {k: (r.url, r.title, r.snippet) for k, r in got.items()} == {
        0: ("https://a.test/1", "One & two", "red and more"), 2: ("https://a.test/2", "Untitled", "long"), 1000: ("https://r.test", "t", ""), 2000: ("https://a.test/3", "E", "blue"),
    }
    assert got[0].metadata == {"author": "Kim"} and got[2000].metadata == {"author": "Lee"} and got[0].ts == datetime.datetime(2024, 1, 2, 3, 4, 5) and got[1000].ts == NOW
    assert {r.ord: r.message for r in feeds.feed_errors(df).collect()} == {3000: "no well-formed feed", 4000: "no well-formed feed", 5000: "no payload", 6000: "no well-formed feed", 7000: "no well-formed feed"}


def test_topics_of_any_depth(spark):
    deep = '{"Text":"d9","FirstURL":"https://9"}'
    for i in range(8, 0, -1):
        deep = f'{{"Text":"d{i}","FirstURL":"https://{i}","Topics":[{deep},{{"Text":"leaf {i}","FirstURL":"https://l{i}"}}]}}'
    answer = '{"Heading":"H h","AbstractURL":"https://w","AbstractText":"t","Image":"i.png","Answer":"42","AnswerType":"calc","DefinitionURL":"https://d","Definition":"def","Results":[{"Text":"r","FirstURL":"https://r","Result":"<a href=x>R</a> r","Icon":{"URL":"ic"}}],"RelatedTopics":[{"Name":"group","Topics":[' + deep + ']},{"Text":"last","FirstURL":"https://z"}]}'
    got = topics.instant_answers(payload(spark, answer, "no json", "{}", None), F.lit(NOW), 30).orderBy("ord").collect()
    assert [r.title for r in got] == ["H h", "Answer: calc", "Definition from Unknown", "R", *[f"d{i}" for i in range(1, 10)], *[f"leaf {i}" for i in range(8, 0, -1)], "last"]
    assert got[1].url == "https://duckduckgo.com/?q=H%20h" and got[0].metadata == {"type": "abstract", "image": "i.png"} and got[3].metadata == {"type": "result", "icon": "ic"}
    assert [r.ord for r in topics.instant_answers(payload(spark, "{}", answer), F.lit(NOW), 3).orderBy("ord").collect()] == [1000, 1001, 1002]


def test_providers(spark):
    from functools import partial

    def give(rows, query, limit):
        yield from rows

    def fail(message, query, limit):
        yield "https://half", "t", "s", None
        raise OSError(message)

    rows = [(f"https://{i}", f"t{i}", "s", NOW) for i in range(5)]
    providers.register(spark, {"a": partial(give, rows), "bad": partial(fail, "gone"), "b": partial(give, rows[:1]), "none": partial(give, [])}, "some_providers")
    read = spark.read.format("some_providers").option("limit", "3").option("wait", "0.01").load()
    assert read.rdd.getNumPartitions() == 4
    good, bad = providers.fetched(read)
    assert sorted((r.source, r.place, r.url) for r in good.collect()) == [("a", 0, "https://0"), ("a", 1, "https://1"), ("a", 2, "https://2"), ("b", 0, "https://0")]
    assert [tuple(r) for r in bad.collect()] == [("bad", "gone", None)]
    only = read.filter("provider = 'b'")
    assert only.rdd.getNumPartitions() == 1 and only.count() == 1


@pytest.mark.parametrize("ttl", [1, 10, 1000])
def test_lookup_as_of(spark, ttl):
    import random

    rng = random.Random(ttl)
    at = lambda s: NOW + datetime.timedelta(seconds=s)
    requests = [(i, rng.choice("abc"), at(rng.randint(0, 60))) for i in range(80)] + [(900, None, at(5))]
    entries = [(rng.choice("abd"), at(rng.randint(0, 60)), rng.randint(0, 2), f"v{i}") for i in range(40)]
    got = cached.lookup(spark.createDataFrame(requests, "id long, key string, at timestamp"), spark.createDataFrame(entries, "key string, at timestamp, n long, value string"), ttl, ["n", "value"])
    want = {}
    for i, key, t in requests:
        best = max(((e[1], e[2], e[3]) for e in entries if e[0] == key and e[2] > 0 and e[1] <= t and (t - e[1]).total_seconds() <= ttl), default=(None, None, None))
        want[i] = best
    assert {r.id: (r.hit, r.n, r.value) for r in got.collect()} == want


def test_cache_outlives_the_run(spark, tmp_path):
    cache = cached.RequestCache(spark, str(tmp_path / "cache"), 60)
    assert cache.entries().count() == 0
    rows = spark.createDataFrame([(2, "q1", "b"), (1, "q1", "a"), (1, "q2", "c")], "ord int, key string, url string")
    cache.store(rows, F.col("key"), F.lit(NOW))
    session.cleanup(spark)
    asked = spark.createDataFrame([("q1", NOW + datetime.timedelta(seconds=30)), ("q2", NOW + datetime.timedelta(seconds=61)), ("q3", NOW)], "key string, at timestamp")
    got = {r.key: (r.n, r.value) for r in cached.RequestCache(spark, str(tmp_path / "cache"), 60).get(asked).collect()}
    assert got["q1"][0] == 2 and got["q1"][1].index('"a"') < got["q1"][1].index('"b"') and got["q2"] == got["q3"] == (None, None)
    stats = cache.stats().first()
    assert stats.files > 0 and stats.bytes > 0 and stats.oldest <= stats.newest
    cache.prune(F.lit(NOW + datetime.timedelta(seconds=61)))
    assert cache.entries().count() == 0


def test_fetch_survives_cleanup(spark, tmp_path):
    cache, calls = control.FileCache(str(tmp_path), 60_000), []

    def source():
        calls.append(1)
        return spark.createDataFrame([(1, "https://a")], "ord int, url string")

    fetch.fetch_all({"s": source}, 0, cache, "q")
    session.cleanup(spark)
    assert fetch.fetch_all({"s": source}, 0, cache, "q").results.count() == 1 and len(calls) == 1
    cache.set("s:q", str(tmp_path / "no such table"))
    assert fetch.fetch_all({"s": source}, 0, cache, "q").results.count() == 1 and len(calls) == 2


def test_folder_without_setting(spark, monkeypatch):
    """Where no shared folder is named, a local session has one of its own."""
    before = session.shared_dir(spark)

    class Conf:
        def get(self, key, default=None):
            return None if key == "spark.checkpoint.dir" else spark.conf.get(key, default)

    class Session:
        conf, sparkContext = Conf(), spark.sparkContext

    assert session.shared_dir(Session()) == session.shared_dir(Session())
    assert session.shared_dir(spark) == before


def test_a_reference_is_worked_out_once(spark):
    """The regular expressions of a reference stand in its plan a few times, not once for each use of what they give."""
    plan = spark.range(1).select(entities.unescape(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract(") + plan.count("regexp_extract (") <= 12


def test_many_different_references_of_a_text(spark):
    text = "".join(f"&#{n}; &#x{n:x};&amp{n}" for n in range(0x4E00, 0x4E00 + entities.DIFFERENT))
    assert one(spark, [text], entities.unescape) == [html.unescape(text)]


def test_a_provider_is_not_held_in_memory():
    """40 MB of results pass in little memory; a try that fails half-way leaves nothing."""
    import tracemalloc

    tries = []

    def give(query, limit):
        tries.append(1)
        for i in range(4000):
            yield f"https://{i}", "t", str(i) * 2500, None
            if len(tries) == 1 and i == 100:
                raise OSError("once")

    reader = providers.ProviderReader({"a": give}, {"limit": "100000", "wait": "0"})
    tracemalloc.start()
    places = [r[1] for r in reader.read(reader.partitions()[0])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert places == list(range(4000)) and len(tries) == 2 and peak < 5_000_000
