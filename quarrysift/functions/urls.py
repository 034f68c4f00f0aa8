"""URL functions by one shared pattern; what does not match it, or has no host, is invalid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/:?#]*)(?::\d+)?([^?#]*)(?:\?([^#]*))?"

# Query parameters that only track.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source", "mc_eid", "mc_cid"]


def full_host(url: Column) -> Column:
    """Lower-cased host with ``www.``; '' if invalid."""
    return F.coalesce(F.lower(F.regexp_extract(url, PATTERN, 2)), F.lit(""))


def host(url: Column) -> Column:
    """Host without its first ``www.``, wherever it stands; null if invalid."""
    h = full_host(url)
    return F.when(h != "", F.regexp_replace(h, r"^(.*?)www[.]", "$1"))


def normalized(url: Column) -> Column:
    """Comparison key: no fragment, port, user, tracking parameters, leading www. or final slash; parameters by name."""
    scheme, h = F.lower(F.regexp_extract(url, PATTERN, 1)), full_host(url)
    path = F.regexp_extract(url, PATTERN, 3)
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/$", ""))
    pairs = F.filter(F.split(F.regexp_extract(url, PATTERN, 4), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(TRACKING))
    keyed = F.transform(pairs, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), p.alias("p")))
    query = F.array_join(F.transform(F.array_sort(keyed), lambda s: s["p"]), "&")
    whole = F.concat(scheme, F.lit("://"), F.regexp_replace(h, r"^www\.", ""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(h == "", F.lower(url)).otherwise(whole)
