import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from quarrysift.operators import embedding, ranking
from quarrysift.plans import config, control, fetch, output

NOW = dt.datetime(2024, 3, 1)
DDL = "ord long, url string, title string, snippet string, source string, ts timestamp, metadata map<string,string>"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, t, s, "brave", NOW, {}) for i, (u, t, s) in enumerate(rows)], DDL)


def test_config(tmp_path, monkeypatch):
    base = config.Config()
    assert (base.limit, base.timeout_ms, base.retries, base.cache_ttl_ms, base.weights) == (20, 10_000, 2, 3_600_000, (0.3, 0.2, 0.5))
    assert [n for n, p in base.providers.items() if p.enabled] == ["duckduckgo", "rss"] and base.providers["duckduckgo"].rate == 0.5
    monkeypatch.setenv("SIFT_KEY", "secret")
    at = tmp_path / "own.json"
    at.write_text(json.dumps({"providers": {"brave": {"apiKey": "${SIFT_KEY}"}, "rss": {"feeds": ["https://f.test/x"]}}, "search": {"defaultLimit": 7}, "scoring": {"weights": {"recency": 0.9}}, "output": {"format": "json", "obsidian": {"tags": ["t"]}}, "cache": {"ttlMs": 5}}))
    got = config.load(str(at))
    assert got.providers["brave"].api_key == "secret" and got.providers["rss"].feeds == ("https://f.test/x",) and (got.limit, got.weights, got.report.format, got.report.tags, got.cache_ttl_ms) == (7, (0.9, 0.2, 0.5), "json", ("t",), 5)
    cli = got.merged(["brave", "serp"], limit=3, output="out", format="markdown")
    assert [n for n, p in cli.providers.items() if p.enabled] == ["brave"] and (cli.limit, cli.report.directory, cli.report.format) == (3, "out", "markdown")
    assert got.limit == 7 and config.load(str(tmp_path / "none.json")) == base
    at.write_text("{")
    for bad in (lambda: config.load(str(at)), lambda: config.Config(limit=0), lambda: config.Config(limit=1.5), lambda: config.Config(retries=-1), lambda: config.Config(similarity=2), lambda: config.Config(weights=(2, 0, 0)), lambda: config.Provider(rate=0), lambda: config.Provider(feeds=("x",)), lambda: config.Report(format="pdf"), lambda: config.from_dict({"providers": {"other": {}}})):
        with pytest.raises(config.ConfigError):
            bad()


def test_date_range():
    utc = dt.UTC
    assert config.date_range(None, None) is None
    assert config.date_range("2024-01-02", None, NOW) == (dt.datetime(2024, 1, 2, tzinfo=utc), NOW)
    assert config.date_range("", "2024-01-02") == (dt.datetime(1970, 1, 1, tzinfo=utc), dt.datetime(2024, 1, 2, tzinfo=utc))
    with pytest.raises(config.ConfigError):
        config.date_range("soon", None)


def test_fetch(spark, tmp_path):
    calls = {"bad": 0, "late": 0, "good": 0}

    def bad():
        calls["bad"] += 1
        raise config.ProviderError("bad", "gone", 410)

    def late():
        calls["late"] += 1
        if calls["late"] < 3:
            raise OSError("try again")
        return frame(spark, [("https://l.test", "l", "")])

    def good():
        calls["good"] += 1
        return frame(spark, [("https://g.test", "g", "")])

    none = lambda: frame(spark, []).limit(0)
    cache, waits = control.FileCache(str(tmp_path), 10_000), []
    got = fetch.fetch_all({"good": good, "bad": bad, "late": late, "none": none}, 2, cache, "q", sleep=waits.append)
    assert got.providers == ["good", "late", "none"] and got.errors == [{"provider": "bad", "message": "gone", "statusCode": 410}]
    assert sorted(r.url for r in got.results.collect()) == ["https://g.test", "https://l.test"] and calls == {"bad": 3, "late": 3, "good": 1} and sorted(waits) == [1.0, 1.0, 2.0, 2.0]
    again = fetch.fetch_all({"good": good, "none": none}, 2, cache, "q")
    assert calls["good"] == 1 and again.results.count() == 1 and cache.stats()["entries"] == 2
    assert fetch.healthy(good) and not fetch.healthy(bad)
    limiters = fetch.Limiters()
    assert limiters.get("a", 2) is limiters.get("a", 9) and limiters.get("a", 9).rate == 2


def test_feeds(spark):
    item = lambda n: f"<item><title>red {n}</title><link>https://f.test/{n}</link></item>"

    def read(url):
        if "bad" in url:
            raise OSError("no such feed")
        return spark.createDataFrame([(f"<rss>{item(url[-1] + 'a')}{item(url[-1] + 'b')}<item><title>blue</title><link>https://f.test/x</link></item></rss>",)], "payload string")

    feeds = fetch.Feeds()
    for u in ("https://1", "https://bad", "https://2", "https://1", "https://3"):
        feeds.add(u)
    feeds.remove("https://9")
    assert feeds.list() == ["https://1", "https://bad", "https://2", "https://3"]
    got = feeds.search("Red", 3, read, F.lit(NOW)).orderBy("ord").collect()
    assert [r.title for r in got] == ["red 1a", "red 1b", "red 2a"]


def test_extract_batch(spark):
    def load(url):
        if "bad" in url:
            raise ValueError("broken")
        return f"<p>{url}</p>"

    got = {r.url: (r.html, r.error) for r in fetch.extract_batch(spark.createDataFrame([("a",), ("bad",), ("c",)], "url string"), load).collect()}
    assert got == {"a": ("<p>a</p>", None), "bad": (None, "broken"), "c": ("<p>c</p>", None)}


def test_embedding_index(spark):
    rows = frame(spark, [("https://1", "red apple", "pie"), ("https://2", "blue sky", ""), ("https://1", "again", "x")])
    index = embedding.Index(embedding.hashed_words(64))
    index.add(rows.filter("ord < 2"))
    index.add(rows)
    assert index.stats() == {"vectors": 2} and index.available()
    best = index.search("apple red pie", 1).first()
    assert best.url == "https://1" and best.similarity == pytest.approx(1)
    index.clear()
    assert index.stats() == {"vectors": 0} and not embedding.Index(lambda t: 1 / 0).available()
    long = embedding.embedded(spark.createDataFrame([(1, None), (2, "")], "id long, t string"), "t", embedding.hashed_words(8)).collect()
    assert [sum(r.embedding) for r in long] == [0, 0]


def test_reports(spark, tmp_path, capsys):
    rows = frame(spark, [("https://a.test/1", "one | x", "s " * 200), ("https://b.test/1", "two", ""), ("bad url", "three", ""), ("https://a.test/2", "four", "")])
    s = ranking.scored(rows, "one", F.lit(NOW)).withColumn("categories", F.when(F.col("ord") == 1, F.array(F.lit("Zed"), F.lit("Blog"))).otherwise(F.array(F.lit("General"))))
    text = output.markdown(s, 'say "one"', "2024-03-01", tags=("t",), sources=("brave", "rss"))
    assert text.startswith('---\ntitle: "say \\"one\\""\ndate: 2024-03-01\ntags: ["t"]\nsources: ["brave", "rss"]\ntotal_results: 4\ngenerated_by: ')
    heads = [x for x in text.split("\n") if x.startswith("## ")]
    assert heads == ["## a.test", "## b.test", "## Unknown", "## Related"] and "- [[a]]\n- [[b]]" in text and "2 unique domains" in text and "*Categories: `Zed` `Blog`*" in text
    assert [x for x in output.markdown(s, "q", "d", by="category", front=False).split("\n") if x.startswith("## ")] == ["## General", "## Zed", "## Related"]
    assert "## a.test" not in output.markdown(s, "q", "d", by=None)
    got = json.loads(output.json_report(s, "one", "now", ("brave",), [{"provider": "x", "message": "m"}]))
    assert got["meta"]["uniqueDomains"] == 2 and got["errors"][0]["message"] == "m" and [r["title"] for r in got["results"]][0] == "one | x" and {r["domain"] for r in got["results"]} == {"a.test", "b.test", "unknown"}
    assert "errors" not in json.loads(output.json_report(s.limit(0), "one", "now"))
    c = output.context(s, "one", "d")
    assert len(c["groupedByDomain"]["a.test"]) == 2 and set(c["groupedByCategory"]) == {"Zed", "Blog", "General"}
    cards = {r.ord: r for r in output.cards(s).collect()}
    assert cards[0].percent == 100 and len(cards[0].snippet) == 203 and cards[2].domain == "unknown"
    path = output.write("text", "sub/x.md", str(tmp_path))
    assert open(path).read() == "text" and output.write("shown", None) is None and capsys.readouterr().out == "shown\n"
    line = spark.range(1).select(output.suggestion_line(F.lit(3), F.lit("word"), F.lit(0.55), F.lit("title")).alias("x")).first().x
    assert line == " 3. word" + " " * 22 + "█" * 6 + "░" * 4 + " (title)"


def test_dialog(spark):
    asked = []

    def find(q):
        asked.append(q)
        return frame(spark, [(f"https://a.com/{len(asked)}", f"{q} guide tutorial {len(asked)}", "guide tutorial text"), ("https://b.com", "other thing", "guide")])

    d = control.Dialog(control.Session(find, F.lit(NOW)), "apple")
    assert d.step("/help") == {"help": control.HELP} and d.step("/nothing") == {"help": control.HELP}
    assert d.step("red")["ran"] == ["apple red"] and d.query == "apple red"
    chosen = d.step("1, 2")["chosen"]
    assert len(chosen) == 2
    assert len(d.step("narrow it")["ran"]) == 2 and d.step("/history")["history"][:2] == ["apple", "apple red"]
    assert len(d.step("/pivot")["ran"]) == 1 and d.step("/add green")["ran"] == ["apple red green"]
    assert d.step("/query plum")["ran"] == ["plum"] and d.session.depth == 1
    assert d.step("/results")["results"].count() == d.session.found.count()
    assert d.step("/done") == {"done": True, "keep": True} and d.step("/quit")["keep"] is False
