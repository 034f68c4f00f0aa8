"""Feeds as XML: RSS and Atom documents are parsed by Spark's reader against one schema, whatever their number of items.

A payload that is no well-formed XML, or no feed, has no items and one row of ``feed_errors``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normalise import feed_items

_ITEM = "array<struct<title:string,link:array<string>,description:string,`content:encoded`:string,content:string,summary:string,pubDate:string,`dc:date`:string,`dc:creator`:string,creator:string,author:string>>"
_ENTRY = "array<struct<id:string,title:string,link:array<struct<_href:string,_rel:string,_VALUE:string>>,summary:string,content:string,published:string,updated:string,author:array<struct<name:string>>>>"
#: RSS has its items in a channel (older forms beside it), Atom entries; other elements are passed over.
SCHEMA = f"title string, channel struct<title:string,item:{_ITEM}>, item {_ITEM}, entry {_ENTRY}, _corrupt_record string"


def parsed(df: DataFrame) -> DataFrame:
    """``df`` (payload, perhaps ord) with ``p``, its feed; a null ``p`` where the payload is none."""
    p = F.from_xml("payload", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    first = F.col("ord").cast("long") if "ord" in df.columns else F.lit(0).cast("long")
    rows = df.select(first.alias("first"), "payload", p.alias("p"))
    # the first tag tells a feed from other well-formed text
    root = F.regexp_extract("payload", r"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>|\s)*<([A-Za-z][\w.:-]*)", 1)
    feed = F.lower(F.substring_index(root, ":", -1)).isin("rss", "rdf", "feed")
    return rows.withColumn("p", F.when(feed & F.col("p._corrupt_record").isNull(), F.col("p")))


def _some(*texts: Column) -> Column:
    """The first text that is not empty, trimmed; else null."""
    return F.coalesce(*[F.nullif(F.trim(t), F.lit("")) for t in texts])


def moment(c: Column) -> Column:
    """Dates of feeds: ``[Mon, ]02 Jan 2024 03:04:05 +0000`` or ISO."""
    bare = F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z]{3},\s*", ""), r"\s(GMT|UTC|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), c.try_cast("timestamp"))


def items(df: DataFrame) -> DataFrame:
    """(ord, feed, link, title, contentSnippet, summary, content, isoDate, creator, author) of every item and entry."""
    ref = "struct<link:string,title:string,summary:string,content:string,day:string,creator:string,author:string>"
    iso = lambda c: F.date_format(moment(c), "yyyy-MM-dd HH:mm:ss")

    def item(x: Column) -> Column:
        link = F.get(F.filter(F.transform(x["link"], lambda t: F.trim(t)), lambda t: t != ""), F.lit(0))
        return F.struct(link.alias("link"), _some(x["title"]).alias("title"), _some(x["description"], x["summary"]).alias("summary"), _some(x["content:encoded"], x["content"]).alias("content"), _some(x["pubDate"], x["dc:date"]).alias("day"), _some(x["dc:creator"], x["creator"]).alias("creator"), _some(x["author"]).alias("author"))

    def entry(x: Column) -> Column:
        links = F.filter(F.transform(x["link"], lambda t: F.struct(F.coalesce(t["_rel"], F.lit("alternate")).alias("rel"), _some(t["_href"], t["_VALUE"]).alias("to"))), lambda t: t["to"].isNotNull())
        # the page itself before other addresses
        link = F.coalesce(F.get(F.filter(links, lambda t: t["rel"] == "alternate"), F.lit(0))["to"], F.get(links, F.lit(0))["to"])
        return F.struct(link.alias("link"), _some(x["title"]).alias("title"), _some(x["summary"]).alias("summary"), _some(x["content"]).alias("content"), _some(x["published"], x["updated"]).alias("day"), F.lit(None).cast("string").alias("creator"), _some(F.get(x["author"], F.lit(0))["name"]).alias("author"))

    none = F.array().cast(f"array<{ref}>")
    listed = lambda c, make: F.coalesce(F.transform(c, make).cast(f"array<{ref}>"), none)
    every = F.concat(listed(F.col("p.channel.item"), item), listed(F.col("p.item"), item), listed(F.col("p.entry"), entry))
    rows = parsed(df).filter("p is not null").select("first", _some(F.col("p.channel.title"), F.col("p.title")).alias("feed"), F.posexplode(every).alias("place", "x"))
    return rows.select((F.col("first") + F.col("place")).alias("ord"), "feed", "x.link", "x.title", F.lit(None).cast("string").alias("contentSnippet"), "x.summary", "x.content", iso(F.col("x.day")).alias("isoDate"), "x.creator", "x.author")


def feed(df: DataFrame, as_of: Column) -> DataFrame:
    """Results of feeds (payload: XML), with their author in the metadata; ``ord`` counts from a payload's own ``ord``, if it has one."""
    return feed_items(items(df), as_of)


def feed_errors(df: DataFrame) -> DataFrame:
    """(ord, message, payload) of each payload that is no feed; a null one too."""
    message = F.when(F.col("payload").isNull(), "no payload").otherwise("no well-formed feed")
    return parsed(df).filter("p is null").select(F.col("first").alias("ord"), message.alias("message"), "payload")


def papers(df: DataFrame, as_of: Column) -> DataFrame:
    """Entries of a paper archive's feed (payload: Atom) that have a title and an id."""
    x = parsed(df).filter("p is not null").select("first", F.posexplode("p.entry").alias("place", "x"))
    body = F.coalesce(_some(F.col("x.summary")), F.lit(""))
    short = F.concat(F.substring(body, 1, 200), F.when(F.length(body) > 200, "...").otherwise(""))
    out = x.select((F.col("first") + F.col("place")).alias("ord"), _some(F.col("x.id")).alias("url"), _some(F.col("x.title")).alias("title"), short.alias("snippet"), F.lit("arxiv").alias("source"), F.coalesce(moment(F.col("x.published")), as_of).alias("ts"))
    return out.filter("url is not null and title is not null")
