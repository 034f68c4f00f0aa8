"""Test tables as results: ord, url, title, snippet, source, ts, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import table

SOURCES = ["duckduckgo", "brave", "rss", "serp"]
AS_OF = "2024-03-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def _hours(n):
    return F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(hours=(n % 2000).cast("int"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url", T.html_title(F.col("html")).alias("title"), T.html_content(F.col("html")).alias("content"))
    source = F.get(F.array(*[F.lit(s) for s in SOURCES]), (F.col("page_id") % 4).cast("int"))
    return p.select(F.col("page_id").alias("ord"), "url", "title", F.col("content").alias("snippet"), source.alias("source"), _hours(F.col("page_id")).alias("ts"), F.create_map(F.lit("page_id"), F.col("page_id").cast("string")).alias("metadata"))


def pages_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, and each again by another source with a tracked www. address and other metadata."""
    p = pages(spark, sf_dir)
    url = F.regexp_replace(F.regexp_replace("url", r"#.*$", ""), r"^([a-z]+)://(www\.)?", "$1://www.")
    again = p.select((F.col("ord") + 1_000_000).alias("ord"), F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), F.lit("utm_source=again#part")).alias("url"), "title", "snippet", F.get(F.array(*[F.lit(s) for s in SOURCES]), ((F.col("ord") + 1) % 4).cast("int")).alias("source"), "ts", F.create_map(F.lit("copy"), F.lit("yes"), F.lit("page_id"), F.lit("late")).alias("metadata"))
    return p.unionByName(again)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    url = F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    return d.select(F.col("doc_id").alias("ord"), url.alias("url"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("snippet"), "source", _hours(F.col("doc_id")).alias("ts"), F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))


# The same relations in SQL, as heads of oracle queries.
PATTERN = r"'^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/:?#]*)(?::\d+)?([^?#]*)(?:\?([^#]*))?'"
_SPACE = r"[\s\x{00A0}\x{FEFF}]"
_CONTENT = rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<script[\s\S]*?</script>', '', 'g'), '(?i)<style[\s\S]*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '{_SPACE}+', ' ', 'g'))"
SQL_PAGES = rf"""
raw as (select page_id, url, html, trim(regexp_extract(html, '(?i)<title>([^<]+)</title>', 1)) as title, {_CONTENT} as content from pages),
res as (select page_id as ord, url, title, case when length(content) > 50000 then substr(content, 1, 50000) || '...' else content end as snippet,
  (['duckduckgo', 'brave', 'rss', 'serp'])[(page_id % 4) + 1] as source, timestamp '2024-01-01 00:00:00' + to_hours(cast(page_id % 2000 as bigint)) as ts from raw)
"""
SQL_DOCS = """
res as (select doc_id as ord, 'https://' || source || '.example.com/' || lang || '/' || doc_id as url, split_part(text, chr(10), 1) as title, text as snippet, source, lang,
  timestamp '2024-01-01 00:00:00' + to_hours(cast(doc_id % 2000 as bigint)) as ts from documents)
"""
SQL_TWICE = rf"""{SQL_PAGES},
again as (select ord, regexp_replace(regexp_replace(url, '#.*$', ''), '^([a-z]+)://(www\.)?', '\1://www.') as u, title, snippet, ts from res),
two as (select ord, url, title, snippet, source, ts, cast(ord as varchar) as page, null as copy from res
  union all select ord + 1000000, u || case when contains(u, '?') then '&' else '?' end || 'utm_source=again#part', title, snippet, (['duckduckgo', 'brave', 'rss', 'serp'])[((ord + 1) % 4) + 1], ts, 'late', 'yes' from again)
"""


def sql_full_host(u: str = "url") -> str:
    return f"lower(regexp_extract({u}, {PATTERN}, 2))"


def sql_host(u: str = "url") -> str:
    return rf"nullif(regexp_replace({sql_full_host(u)}, '^(.*?)www[.]', '\1'), '')"


def sql_normalized(u: str = "url") -> str:
    path = f"regexp_extract({u}, {PATTERN}, 3)"
    tracking = "['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'ref', 'source', 'mc_eid', 'mc_cid']"
    pairs = f"list_filter(string_split(regexp_extract({u}, {PATTERN}, 4), '&'), lambda p: p <> '' and not list_contains({tracking}, split_part(p, '=', 1)))"
    # parameters of one name keep their order: sort by name, then place
    query = f"array_to_string(list_transform(list_sort(list_transform({pairs}, lambda p, i: {{'k': split_part(p, '=', 1), 'i': i, 'p': p}})), lambda s: s.p), '&')"
    return rf"""case when {sql_full_host(u)} = '' then lower({u}) else lower(regexp_extract({u}, {PATTERN}, 1)) || '://' || regexp_replace({sql_full_host(u)}, '^www\.', '')
      || case when {path} in ('', '/') then '/' else regexp_replace({path}, '/$', '') end || case when {query} <> '' then '?' || {query} else '' end end"""


def sql_words(t: str, least: int) -> str:
    return rf"regexp_extract_all(lower({t}), '\w{{{least},}}')"


def sql_fingerprint(t: str) -> str:
    w = sql_words(t, 3)
    clean = rf"trim(regexp_replace(regexp_replace(lower({t}), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"
    grams = "list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_sort(list_slice(w, i, i + 2)), ''))"
    return f"list_transform([{w}], lambda w: case when len(w) < 3 then {clean} else array_to_string(list_slice(list_sort(list_distinct({grams})), 1, 10), '|') end)[1]"
