"""Payloads of search services as results: each takes a DataFrame with a JSON column ``payload``.

Transport is left to the caller. ``ord`` counts from ``base`` in the payload's own order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions.entities import unescape
from ..operators.results import in_domains

_TOPIC = "struct<Text:string,FirstURL:string,Result:string"
ANSWER = f"AbstractText string, AbstractURL string, AbstractSource string, Heading string, Answer string, AnswerType string, Definition string, DefinitionURL string, DefinitionSource string, Results array<{_TOPIC}>>, RelatedTopics array<{_TOPIC},Topics:array<{_TOPIC}>>>>"
_WEB = "array<struct<title:string,url:string,description:string,age:string,page_age:string>>"
WEB_NEWS = f"web struct<results:{_WEB}>, news struct<results:{_WEB}>"
ORGANIC = "error string, organic_results array<struct<position:int,title:string,link:string,snippet:string,date:string,source:string>>"


def _filled(c: Column, *others: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (c, *others[:-1])], others[-1])


def _row(url: Column, title: Column, snippet: Column, source: str, ts: Column) -> Column:
    return F.struct(url.alias("url"), title.alias("title"), snippet.alias("snippet"), F.lit(source).alias("source"), ts.alias("ts"))


def _rows(df: DataFrame, items: Column, limit: int) -> DataFrame:
    listed = df.select(F.posexplode(F.slice(items, 1, limit)).alias("ord", "r"))
    return listed.select(F.col("ord").cast("long").alias("ord"), "r.*")


def web_and_news(df: DataFrame, as_of: Column, limit: int = 20, include: list[str] = (), exclude: list[str] = (), dates: tuple[Column, Column] | None = None) -> DataFrame:
    """Web results (domain and date filters), then news (dates only); invalid URLs are dropped."""
    p = F.from_json("payload", WEB_NEWS)

    def part(items: Column, first: int) -> DataFrame:
        x = df.select(p.alias("p")).select(F.posexplode(items).alias("at", "x"))
        ts = T.relative_date(F.coalesce("x.page_age", "x.age"), as_of)
        return x.select((F.col("at") + first).cast("long").alias("ord"), F.col("x.url").alias("url"), F.col("x.title").alias("title"), F.coalesce("x.description", F.lit("")).alias("snippet"), F.lit("brave").alias("source"), ts.alias("ts"))

    both = part(F.col("p.web.results"), 0), part(F.col("p.news.results"), 1_000_000)
    web = _domains(both[0], include, exclude)
    out = web.unionByName(both[1])
    out = out.filter(F.col("ts").between(*dates)) if dates else out
    return out.orderBy("ord").limit(limit)


def _domains(df: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    out = df.filter(U.host(F.col("url")).isNotNull()) if include else df
    out = out.filter(in_domains(F.col("url"), list(include))) if include else out
    return out.filter(~F.coalesce(in_domains(F.col("url"), list(exclude)), F.lit(False))) if exclude else out


def organic(df: DataFrame, as_of: Column, limit: int = 20, include: list[str] = (), exclude: list[str] = (), dates: tuple[Column, Column] | None = None) -> DataFrame:
    """Organic results; a payload with an error raises when it is read.

    Where ``df`` has a column ``first``, it is the place of a payload's first result.
    """
    first = F.col("first") if "first" in df.columns else F.lit(0)
    p = F.from_json("payload", ORGANIC)
    d = df.select(first.alias("first"), p.alias("p")).select("first", F.when(F.col("p.error").isNotNull(), F.raise_error(F.col("p.error")).cast("array<struct<position:int,title:string,link:string,snippet:string,date:string,source:string>>")).otherwise(F.col("p.organic_results")).alias("r"))
    x = d.select("first", F.posexplode("r").alias("ord", "x")).select((F.col("first") + F.col("ord")).cast("long").alias("ord"), F.col("x.link").alias("url"), F.col("x.title").alias("title"), F.coalesce("x.snippet", F.lit("")).alias("snippet"), F.lit("serp").alias("source"), T.relative_date(F.col("x.date"), as_of, fine=False).alias("ts"))
    out = _domains(x, include, exclude)
    out = out.filter(F.col("ts").between(*dates)) if dates else out
    return out.orderBy("ord").limit(limit)


def feed_items(items: DataFrame, as_of: Column) -> DataFrame:
    """Feed items (link, title, contentSnippet, summary, content, isoDate, ord): those without link are dropped."""
    body = F.coalesce("contentSnippet", "summary", "content", F.lit(""))
    flat = F.trim(F.regexp_replace(F.regexp_replace(body, "<[^>]*>", ""), rf"{T.SPACE}+", " "))
    people = [F.col(n) for n in ("creator", "author") if n in items.columns]
    author = [F.when(F.coalesce(*people).isNotNull(), F.create_map(F.lit("author"), F.coalesce(*people))).alias("metadata")] if people else []
    return items.filter(F.coalesce("link", F.lit("")) != "").select("ord", F.col("link").alias("url"), F.coalesce("title", F.lit("Untitled")).alias("title"), F.substring(flat, 1, 500).alias("snippet"), F.lit("rss").alias("source"), F.coalesce(F.col("isoDate").try_cast("timestamp"), as_of).alias("ts"), *author)


def _plain(html: Column) -> Column:
    return F.trim(unescape(F.regexp_replace(html, "<[^>]*>", "")))


def lite_page(df: DataFrame, as_of: Column, limit: int | None = 20) -> DataFrame:
    """Results of lite search pages (payload: HTML): links of class result-link with the snippets beside them.

    ``ord`` counts from a payload's own ``ord``, if it has one.
    """
    anchors = F.regexp_extract_all("payload", F.lit(r"""(?is)<a\b[^>]*class=["']result-link["'][^>]*>.*?</a>"""), F.lit(0))
    cells = F.regexp_extract_all("payload", F.lit(r"""(?is)<td\b[^>]*class=["']result-snippet["'][^>]*>(.*?)</td>"""), F.lit(1))
    first = F.col("ord") if "ord" in df.columns else F.lit(0)
    x = df.select(first.alias("first"), F.posexplode(anchors).alias("place", "a"), cells.alias("cells"))
    out = x.select((F.col("first") + F.col("place")).cast("long").alias("ord"), unescape(F.regexp_extract("a", r"""(?is)\shref=["']([^"']*)["']""", 1)).alias("url"), _plain(F.col("a")).alias("title"), F.coalesce(_plain(F.get("cells", F.col("place"))), F.lit("")).alias("snippet"), F.lit("duckduckgo").alias("source"), as_of.alias("ts"))
    out = out.filter((F.col("url") != "") & (F.col("title") != "") & ~F.startswith("url", F.lit("/")))
    return out if limit is None else out.orderBy("ord").limit(limit)


def web_answers(df: DataFrame, as_of: Column, limit: int = 20) -> DataFrame:
    """The web variant of ``topics.instant_answers``: abstract, topics each before its own, then results."""
    none = F.array().cast("array<struct<url:string,title:string,snippet:string,source:string,ts:timestamp>>")
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    short = lambda t: _row(t["FirstURL"], F.substring(t["Text"], 1, 60), t["Text"], "duckduckgo", as_of)
    headed = lambda t: _row(t["FirstURL"], _filled(F.regexp_extract(t["Text"], r"^(.+?)\s*[-–—]\s*", 1), F.substring(t["Text"], 1, 60)), t["Text"], "duckduckgo", as_of)
    usable = lambda t: F.coalesce(some(t["FirstURL"]) & some(t["Text"]), F.lit(False))
    listed = lambda a: F.coalesce(F.transform(F.filter(a, usable), short), none)
    d = df.select(F.from_json("payload", ANSWER).alias("p")).select("p.*")
    abstract = F.when(F.coalesce(some(F.col("AbstractURL")) & some(F.col("AbstractText")), F.lit(False)), F.array(_row(F.col("AbstractURL"), _filled(F.col("Heading"), F.lit("Wikipedia")), F.col("AbstractText"), "duckduckgo", as_of))).otherwise(none)
    topics = F.coalesce(F.flatten(F.transform("RelatedTopics", lambda t: F.concat(F.when(usable(t), F.array(headed(t))).otherwise(none), listed(t["Topics"])))), none)
    return _rows(d, F.concat(abstract, topics, listed(F.col("Results"))), limit)


# Web adapters: schema, array of items, and a result from an item.
_ADAPTERS = {
    "searxng": ("results array<struct<url:string,title:string,content:string>>", "results", lambda x, now: (x["url"], _filled(x["title"], F.lit("Untitled")), F.coalesce(x["content"], F.lit("")), now)),
    "wikipedia": ("query struct<search:array<struct<title:string,snippet:string,timestamp:string>>>", "query.search", lambda x, now: (F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.url_encode(F.replace(x["title"], F.lit(" "), F.lit("_")))), x["title"], F.regexp_replace(x["snippet"], "<[^>]*>", ""), F.coalesce(x["timestamp"].try_cast("timestamp"), now))),
    "hackernews": ("hits array<struct<url:string,title:string,points:int,num_comments:int,author:string,created_at:string>>", "hits", lambda x, now: (x["url"], x["title"], F.concat_ws(" | ", F.concat(x["points"].cast("string"), F.lit(" points")), F.concat(x["num_comments"].cast("string"), F.lit(" comments")), F.concat(F.lit("by "), x["author"])), F.coalesce(x["created_at"].try_cast("timestamp"), now))),
    "github": ("items array<struct<html_url:string,full_name:string,description:string,stargazers_count:int,updated_at:string>>", "items", lambda x, now: (x["html_url"], F.concat(x["full_name"], F.lit(" (★"), x["stargazers_count"].cast("string"), F.lit(")")), F.coalesce(x["description"], F.lit("")), F.coalesce(x["updated_at"].try_cast("timestamp"), now))),
    "reddit": ("data struct<children:array<struct<data:struct<permalink:string,title:string,selftext:string,created_utc:double>>>>", "data.children", lambda x, now: (F.concat(F.lit("https://www.reddit.com"), x["data"]["permalink"]), x["data"]["title"], F.substring(F.coalesce(x["data"]["selftext"], F.lit("")), 1, 200), F.timestamp_seconds(x["data"]["created_utc"]))),
    "stackoverflow": ("items array<struct<link:string,title:string,score:int,answer_count:int,creation_date:bigint>>", "items", lambda x, now: (x["link"], unescape(x["title"]), F.concat_ws(" | ", F.concat(F.lit("Score: "), x["score"].cast("string")), F.concat(F.lit("Answers: "), x["answer_count"].cast("string"))), F.timestamp_seconds(x["creation_date"]))),
}


def adapter(name: str, df: DataFrame, as_of: Column, limit: int | None = 20) -> DataFrame:
    """Results of one of the web adapters; items without URL are dropped. Without a limit, ``df`` may have any number of payloads."""
    ddl, items, make = _ADAPTERS[name]
    x = df.select(F.from_json("payload", ddl).alias("p")).select(F.posexplode(f"p.{items}").alias("ord", "x"))
    url, title, snippet, ts = make(F.col("x"), as_of)
    out = x.select(F.col("ord").cast("long").alias("ord"), url.alias("url"), title.alias("title"), snippet.alias("snippet"), F.lit(name).alias("source"), ts.alias("ts"))
    out = out.filter(F.coalesce("url", F.lit("")) != "")
    return out if limit is None else out.orderBy("ord").limit(limit)
