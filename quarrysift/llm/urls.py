"""URL verdicts: host and path rules, and a list of URLs behind a blocked Bloom filter.

The listed URLs, in canonical form, set bits in a blocked Bloom filter: a hash picks one
64-bit block and a few bits in it, so a look-up touches one block. The filter's size has a
fixed bound, so it is broadcast whatever the list's length; URLs that it lets through are
possible hits and go to an exact hash join with the list, which removes false positives.
Only native DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of 64 bits: at most 2**MAX_BITS of them (16 bytes each when broadcast).
MIN_BITS, MAX_BITS, PROBES, BITS_A_URL = 6, 17, 4, 12
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    get = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(get(1), _UPPER, _LOWER), get(2)


def canonical(url: Column) -> Column:
    """Canonical form for comparing URLs; null for null or without ``://``.

    Scheme and user dropped, host lower-cased without leading ``www.`` or ``m.`` and
    without a default port, empty path and final slash alike, fragment dropped, utm_*
    parameters dropped and the others sorted.
    """
    host, path = host_and_path(url)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"^(www|m)\.", ""), r":(80|443)?$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, F.regexp_replace(path, "/+$", ""), tail))


def rule_verdict(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (``host/path``) and its verdict; null where none does.

    rules: (verdict, host, path), a bounded list that becomes part of the plan. Of equal
    lengths the first in alphabetical order of rule holds.
    """
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _block_and_mask(key: str, bits: int) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    block = F.shiftrightunsigned(h, 64 - bits)
    mask = F.lit(0).cast("long")
    for i in range(PROBES):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return block, mask


def bloom_filter(keys: DataFrame, column: str, n: int) -> tuple[DataFrame, int]:
    """(block, bits) rows for the values of ``column``, and the logarithm of their number.

    n: about how many values; beyond what 2**MAX_BITS blocks are made for, more URLs pass
    the filter and the exact join does more, with the same result.
    """
    bits = min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(max(1, n) * BITS_A_URL / 64))))
    block, mask = _block_and_mask(column, bits)
    return keys.select(block.alias("block"), mask.alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("bits")), bits


def listed_verdicts(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(page, host, path, rule, verdict, listed) for every row of ``pages`` (url, any others).

    ``page`` is a struct of the row's own columns. ``listed`` (url) may repeat, hold nulls
    or be empty. Verdict: the longest rule's; without one, block if the URL is listed in
    canonical form, else allow. Null URLs and those without ``://`` are never listed.
    """
    key = listed.select(canonical(F.col("url")).alias("key")).filter("key is not null").distinct()
    blocks, bits = bloom_filter(key, "key", key.count())
    host, path = host_and_path(F.col("page.url"))
    rule, verdict = rule_verdict(F.col("host"), F.col("path"), rules)
    own = pages.select(F.struct("*").alias("page"))
    own = own.withColumns({"host": host, "path": path, "canon": canonical(F.col("page.url"))}).withColumns({"rule": rule, "said": verdict})
    block, mask = _block_and_mask("canon", bits)
    own = own.withColumns({"block": block, "mask": mask})
    met = own.join(F.broadcast(blocks), "block", "left")
    possible = F.col("canon").isNotNull() & F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))
    rest = met.filter(~possible).withColumn("listed", F.lit(False))
    hits = met.filter(possible).join(key.withColumn("in", F.lit(True)), F.col("canon") == F.col("key"), "left").withColumn("listed", F.col("in").isNotNull())
    cols = ["page", "host", "path", "rule", "said", "listed"]
    both = rest.select(cols).unionByName(hits.select(cols))
    return both.select("page", "host", "path", "rule", F.coalesce("said", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every row of ``pages``.

    The list is a feed of known bad URLs: those of ``pages`` on hosts whose first label
    (after www, m or blog) is spam-farm or cheap-pills.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host, _ = host_and_path(F.col("url"))
    feed = pages.select("url").filter(host.rlike(r"^((www|m|blog)\.)?(spam-farm|cheap-pills)\."))
    return listed_verdicts(pages.select("page_id", "url"), feed, RULES).select("page.page_id", "host", "path", "rule", "verdict", "listed")


_HOST = r"translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP8_SQL = rf"""
with parts as (
  select page_id, coalesce({_HOST}, '') as host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path,
         list_sort(list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' and not starts_with(p, 'utm_'))) as kept
  from pages),
canon as (
  select *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), '^(www|m)\.', ''), ':(80|443)?$', '') as bare from parts),
keyed as (
  select *, case when bare <> '' then bare || regexp_replace(path, '/+$', '') || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end end as key from canon),
feed as (select distinct key from keyed where regexp_matches(host, '^((www|m|blog)\.)?(spam-farm|cheap-pills)\.') and key is not null),
rules(verdict, h, p) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
best as (
  select page_id, host, path, key, arg_max(h || p, length(h || p)) as rule, arg_max(verdict, length(h || p)) as said
  from keyed left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id, host, path, key)
select page_id, host, path, rule, coalesce(said, case when feed.key is not null then 'block' else 'allow' end) as verdict, feed.key is not null as listed
from best left join feed using (key)
"""
