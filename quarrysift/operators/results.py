"""Results relation: union, filters, limits, first-wins deduplication, similar pairs, categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import urls as U
from ..session import materialize

# Category, host parts, keywords, URL parts; in order.
CATEGORIES = [
    ("Documentation", ["docs.", "documentation.", "developer.", "devdocs."], ["documentation", "docs", "api reference", "guide"], ["/docs/", "/documentation/", "/api/", "/reference/"]),
    ("Tutorial", [], ["tutorial", "how to", "step by step", "getting started", "learn"], ["/tutorial", "/guide/", "/learn/", "/howto/"]),
    ("Repository", ["github.com", "gitlab.com", "bitbucket.org", "npmjs.com", "pypi.org"], [], ["/repository/", "/packages/", "/releases/"]),
    ("Discussion", ["stackoverflow.com", "reddit.com", "discourse.", "discuss."], ["question", "answer", "discussion", "forum", "community"], []),
    ("Blog", ["medium.com", "dev.to", "hashnode.", "substack.com"], ["blog post", "article", "written by"], ["/blog/", "/posts/", "/articles/", "/news/"]),
    ("News", [], ["announced", "release", "update", "breaking", "news"], ["/news/", "/announcements/", "/press/"]),
    ("Video", ["youtube.com", "vimeo.com", "twitch.tv"], [], ["/watch", "/video/", "/videos/"]),
    ("Research", ["arxiv.org", "scholar.google", "researchgate.net", "academia.edu"], ["paper", "research", "study", "abstract", "citation"], ["/paper/", "/publication/", "/research/"]),
]


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def waterfall(parts: list[DataFrame], always: list[DataFrame], cap: int) -> DataFrame:
    """The first of ``parts`` that has rows, and the first ``cap`` rows of each of ``always``."""
    out = parts[0]
    for p in parts[1:]:
        some = out.limit(1).agg(F.count("*").alias("qs_any"))
        out = out.unionByName(p.crossJoin(F.broadcast(some)).filter("qs_any = 0").drop("qs_any"))
    return union_all([out, *(a.orderBy("ord").limit(cap) for a in always)])


def limit_each(df: DataFrame, by: str, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy("ord"))
    return df.withColumn("qs_rank", rank).filter(F.col("qs_rank") <= n).drop("qs_rank")


def in_domains(url: Column, domains: list[str]) -> Column:
    """Whether the host contains any; null for an invalid URL."""
    h = U.host(url)
    return reduce(lambda a, b: a | b, [h.contains(d) for d in domains], F.lit(False))


def has_any_word(text: Column, query: str) -> Column:
    """Whether a part of the query occurs in the text; an empty query is in all."""
    parts = query.lower().split()
    return reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(p)) for p in parts]) if parts else F.lit(True)


def dedup_key(url: bool = True, content: bool = True) -> Column:
    parts = ([U.normalized(F.col("url"))] if url else []) + ([T.fingerprint(F.concat_ws(" ", "title", "snippet"))] if content else [])
    return F.concat_ws(":", *parts)


def deduplicate(df: DataFrame, key: Column | None = None) -> DataFrame:
    """The row of least ``ord`` of each key; metadata entries of later rows win.

    ``sources`` are the different sources of a key with several rows, in order of first
    appearance, and ``copies`` is how many rows it has. One scan: rows are grouped by key
    and entry first, so that no row is larger than the different entries of its key.
    """
    cols = [c for c in df.columns if c != "metadata"]
    row = F.struct(*cols)
    source = F.struct(F.lit("s").alias("kind"), F.col("source").alias("name"), F.lit(None).cast("string").alias("value"), row.alias("row"))
    entry = lambda e: F.struct(F.lit("m").alias("kind"), e["key"].alias("name"), e["value"].alias("value"), F.lit(None).cast(df.select(*cols).schema).alias("row"))
    entries = F.concat(F.array(source), F.coalesce(F.transform(F.map_entries("metadata"), entry), F.array().cast(f"array<struct<kind:string,name:string,value:string,row:{df.select(*cols).schema.simpleString()}>>")))
    keyed = df.withColumn("key", dedup_key() if key is None else key).select("key", "ord", F.explode(entries).alias("e"))
    by_entry = keyed.groupBy("key", "e.kind", "e.name").agg(F.min("ord").alias("first"), F.count("*").alias("n"), F.max_by("e.value", "ord").alias("value"), F.min_by("e.row", "ord").alias("row"))
    held = by_entry.groupBy("key").agg(
        F.min_by("row", F.when(F.col("kind") == "s", F.col("first"))).alias("r"),
        F.sort_array(F.collect_list(F.struct("kind", "first", "name", "value"))).alias("x"),
        F.sum(F.when(F.col("kind") == "s", F.col("n"))).alias("copies"),
    )
    maps = F.filter("x", lambda e: e["kind"] == "m")
    names = F.transform(F.filter("x", lambda e: e["kind"] == "s"), lambda e: e["name"])
    metadata = F.when(F.size(maps) > 0, F.map_from_arrays(F.transform(maps, lambda e: e["name"]), F.transform(maps, lambda e: e["value"])))
    return held.select("r.*", metadata.alias("metadata"), F.when(F.col("copies") > 1, names).alias("sources"), "copies")


def similar_pairs(df: DataFrame, threshold: float = 0.85, key: str = "ord") -> DataFrame:
    """(i, j, similarity) of sketches at or over a threshold above 0, without expanding copies.

    Rows of equal sketches are one class, named by its least key: each other row comes once,
    as (class, row, 1). Pairs of classes come as (lesser name, greater name, similarity).
    Parts are put in order of rarity; sets that similar share one of their first few, so the
    join is on those only, and each pair is made at its first common part.
    """
    df = materialize(df.select(key, "sketch"), "sketched")
    classes = materialize(df.groupBy("sketch").agg(F.min(key).alias("id")), "sketches")
    copies = df.select(F.col(key).alias("j"), "sketch").join(classes.select(F.col("id").alias("i"), "sketch"), "sketch").filter("i <> j").select("i", "j", F.lit(1.0).alias("similarity"))
    parts = classes.select("id", F.explode(F.array_distinct(F.split("sketch", r"\|"))).alias("p"))
    rare = parts.join(parts.groupBy("p").agg(F.count("*").alias("df")), "p")
    # a class has at most ten parts
    sets = rare.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "p"))), lambda x: x["p"]).alias("all"))
    n = F.size("all")
    first = n - F.ceil(F.lit(threshold) * n - F.lit(1e-9)).cast("int") + 1
    heads = materialize(sets.select("id", "all", F.slice("all", F.lit(1), F.greatest(F.lit(1), first)).alias("head")), "heads")
    dealt = heads.select("id", "all", "head", F.explode("head").alias("p"))
    a, b = dealt.select("p", F.col("id").alias("i"), F.col("all").alias("x"), F.col("head").alias("hx")), dealt.select("p", F.col("id").alias("j"), F.col("all").alias("y"), F.col("head").alias("hy"))
    small = F.least(F.size("x"), F.size("y")) >= F.lit(threshold) * F.greatest(F.size("x"), F.size("y")) - 1e-9
    met = a.join(b, "p").filter((F.col("i") < F.col("j")) & small & (F.get(F.array_intersect("hx", "hy"), F.lit(0)) == F.col("p")))
    common = F.size(F.array_intersect("x", "y"))
    pairs = met.select("i", "j", (common / (F.size("x") + F.size("y") - common)).alias("similarity")).filter(F.col("similarity") >= threshold)
    return pairs.unionByName(copies)


def categories(url: Column, title: Column, snippet: Column, rules=CATEGORIES) -> Column:
    """Ordered names of the categories with a fitting rule; General if none."""
    some = lambda c, parts: [F.contains(c, F.lit(p)) for p in parts]

    def names(v: Column) -> Column:
        hits = [F.when(reduce(lambda a, b: a | b, some(v["h"], d) + some(v["text"], k) + some(v["link"], u), F.lit(False)), name) for name, d, k, u in rules]
        return F.filter(F.array(*hits), lambda x: x.isNotNull())

    # host, text and link are worked out once for a row, not once for each part looked for
    read = F.struct(U.full_host(url).alias("h"), F.lower(F.concat_ws(" ", title, snippet)).alias("text"), F.lower(url).alias("link"))
    return T.bound(T.bound(read, names), lambda found: F.when(F.size(found) == 0, F.array(F.lit("General"))).otherwise(found))


def cache_key(source: Column, query: Column, limit: Column, domains: list[str] = (), exclude: list[str] = (), locale: str = "", dates: tuple[str, str] | None = None) -> Column:
    """Stable digest of a request: lists sorted, so that their order does not matter."""
    wanted = [",".join(sorted(domains)), ",".join(sorted(exclude)), locale, "/".join(dates or ())]
    return F.sha2(F.concat_ws(":", source, query, limit.cast("string"), *map(F.lit, wanted)), 256)


def ranked(df: DataFrame, n: int, score: str = "score") -> DataFrame:
    """The n best by score, then ``ord``, with their global rank from 1."""
    best = df.orderBy(F.desc(score), "ord").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "ord")))


def web_top(df: DataFrame, n: int, score: str = "score") -> DataFrame:
    """The n best results by score and order, one for each exact URL."""
    best = df.groupBy("url").agg(F.min_by(F.struct(*df.columns), F.struct((-F.col(score)).alias("s"), "ord")).alias("r"))
    return best.select("r.*").orderBy(F.desc(score), "ord").limit(n)


def not_indexed(df: DataFrame, index: DataFrame) -> DataFrame:
    """Rows whose URL the index does not hold yet."""
    return df.join(index.select("url"), "url", "left_anti").select(*df.columns)
