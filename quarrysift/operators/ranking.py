"""Scores and rankings: recency, authority, relevance, BM25, hybrids, vectors."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..session import materialize

# Domains of higher standing.
QUALITY = ["nature.com", "science.org", "arxiv.org", "medium.com", "dev.to", "hackernews.com", "techcrunch.com", "wired.com", "arstechnica.com"]
TRUSTED = ["wikipedia.org", "github.com", "developer.mozilla.org", "stackoverflow.com"]


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def recency(ts: Column, as_of: Column) -> Column:
    """1 for now, falling by 1 a year, 0.1 at least; over 1 for later dates."""
    return F.greatest(F.lit(0.1), F.lit(1.0) - (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(86_400e6) / F.lit(365.0))


def authority(url: Column, trusted: list[str] = TRUSTED, suffix: bool = True) -> Column:
    """Standing of the host. suffix: by domain and its subdomains, else by substring and without a middle tier."""
    h = U.host(url)
    in_domain = lambda d: (h == d) | h.endswith("." + d)
    out = F.when(h.isNull(), 0.3).when(_any([in_domain(d) if suffix else h.contains(d) for d in trusted]), 1.0).when(h.endswith(".gov") | h.endswith(".edu"), 0.9)
    return (out.when(_any([in_domain(d) for d in QUALITY]), 0.8) if suffix else out).otherwise(0.5)


def relevance(title: Column, snippet: Column, query: str) -> Column:
    """Share of the query's words in title (0.6) and snippet (0.4); 0.2 more for the whole query in the title."""
    terms = T.words_of(query, 3)
    if not terms:
        return F.lit(0.5)
    hits = lambda c: reduce(add, [F.array_contains(T.words(c, 3), t).cast("int") for t in terms])
    base = hits(title) / len(terms) * F.lit(0.6) + hits(snippet) / len(terms) * F.lit(0.4)
    return F.when(F.contains(F.lower(title), F.lit(query.lower())), F.least(F.lit(1.0), base + 0.2)).otherwise(base)


def scored(results: DataFrame, query: str, as_of: Column, trusted: list[str] = TRUSTED, weights: tuple[float, float, float] = (0.3, 0.2, 0.5)) -> DataFrame:
    """``results`` with score: weighted recency, authority and relevance."""
    a, b, c = weights
    return results.withColumn("score", recency(F.col("ts"), as_of) * a + authority(F.col("url"), trusted) * b + relevance(F.col("title"), F.col("snippet"), query) * c)


def top(df: DataFrame, by: list[str], n: int, tie: str = "ord") -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in by], F.asc(tie)).limit(n)


def web_tfidf(title: Column, snippet: Column, query: str) -> Column:
    """Share of the query's parts of over two characters found in title and snippet."""
    terms = [t for t in query.lower().split() if len(t) > 2]
    text = F.lower(F.concat_ws(" ", title, snippet))
    return reduce(add, [F.contains(text, F.lit(t)).cast("int") for t in terms], F.lit(0)) / F.lit(float(max(1, len(terms))))


def postings(docs: DataFrame) -> DataFrame:
    """(ord, term, tf, dl): title counts twice. Documents without words have no row."""
    body = F.concat_ws(" ", F.col("title"), F.col("title"), F.col("snippet"))
    tokens = docs.select("ord", T.words(body, 2).alias("t")).select("ord", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return tokens.groupBy("ord", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: n documents, average length, different terms are counted apart (``vocabulary``)."""
    body = F.concat_ws(" ", F.col("title"), F.col("title"), F.col("snippet"))
    return docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(T.words(body, 2))), F.lit(0)).alias("total")).select("n", (F.col("total") / F.greatest("n", F.lit(1))).alias("avgdl"))


def inverse_frequency(post: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf) with idf = ln(1 + (n - df + 0.5) / (df + 0.5))."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(stats)).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def _count_of(term: str) -> Column:
    return F.size(F.filter("w", lambda x: x == term))


def counted_terms(docs: DataFrame, query: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(ord, keep, dl, tf0, tf1, ...) of every document as a written table: the counts of the query's different words.

    The one pass over the texts; all that follows reads these few numbers.
    """
    body = F.concat_ws(" ", F.col("title"), F.col("title"), F.col("snippet"))
    counted = docs.select("ord", *keep, T.words(body, 2).alias("w"))
    return materialize(counted.select("ord", *keep, F.size("w").alias("dl"), *[_count_of(t).alias(f"tf{i}") for i, t in enumerate(sorted(set(T.words_of(query, 2))))]), "counted")


def bm25(docs: DataFrame, query: str, k1: float = 1.5, b: float = 0.75, delta: float = 0.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(ord, keep, bm25_score) of every document; 0 without a match.

    Only the query's terms are kept of a document: their counts are columns, and document
    frequencies one aggregate, so that nothing is shuffled but that single row.
    """
    terms = T.words_of(query, 2)
    different = sorted(set(terms))
    counted = counted_terms(docs, query, keep)
    sums = counted.agg(F.count("*").alias("n"), (F.coalesce(F.sum("dl"), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(different))])
    met = counted.crossJoin(F.broadcast(sums))
    score = F.lit(0.0)
    for i, t in enumerate(different):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        one = idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))) + delta
        score = score + F.when(tf > 0, one * terms.count(t)).otherwise(0.0)
    return met.select("ord", *keep, score.alias("bm25_score"))


def bm25_hybrid(docs: DataFrame, query: str, as_of: Column, trusted: list[str] = TRUSTED) -> DataFrame:
    """(ord, url, ts, bm25_score, score) of docs: 0.6 normalised BM25, 0.2 recency, 0.2 authority, 1 at most."""
    ranked = bm25(docs, query, keep=("url", "ts"))
    most = ranked.agg(F.greatest(F.coalesce(F.max("bm25_score"), F.lit(1.0)), F.lit(1.0)).alias("most"))
    mixed = F.col("bm25_score") / F.col("most") * 0.6 + recency(F.col("ts"), as_of) * 0.2 + authority(F.col("url"), trusted, suffix=False) * 0.2
    return ranked.crossJoin(F.broadcast(most)).withColumn("score", F.least(F.lit(1.0), mixed)).drop("most")


def cosine(a: Column, b: Column, strict: bool = True) -> Column:
    """Cosine of two arrays in doubles; 0 if either is zero; raises on unequal lengths.

    Not ``strict``: over the first array's places, and NaN if either is zero.
    """
    y = b if strict else F.slice(b, F.lit(1), F.size(a))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(y, y))
    if not strict:
        return F.when(norm == 0, F.lit(float("nan"))).otherwise(dot(a, y) / norm)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def similarities(vectors: DataFrame, query: DataFrame, strict: bool = True) -> DataFrame:
    """Each row with its ``similarity`` to the one row of ``query``; none if that has no row."""
    one = query.select(F.col("embedding").alias("qs_query")).limit(1)
    return vectors.crossJoin(F.broadcast(one)).withColumn("similarity", cosine(F.col("embedding"), F.col("qs_query"), strict)).drop("qs_query")


def nearest(vectors: DataFrame, query: DataFrame, n: int = 10, key: str = "vec_id", digits: int = 12) -> DataFrame:
    """The n rows of most cosine similarity (to so many digits) to the one row of ``query``."""
    near = similarities(vectors, query)
    return top(near.withColumn("similarity", F.round(F.coalesce("similarity", F.lit(0.0)), digits)), ["similarity"], n, key)


def semantic_hybrid(similar: DataFrame, keyword: DataFrame, keyword_weight: float = 0.5, semantic_weight: float = 0.5) -> DataFrame:
    """``similar`` (ord, similarity) with keyword scores joined: missing ones are 0, the largest counts as 1 at least."""
    met = similar.join(keyword.select("ord", F.col("bm25_score").alias("keyword_score")), "ord", "left").withColumn("keyword_score", F.coalesce("keyword_score", F.lit(0.0)))
    met = materialize(met, "similar")
    most = met.agg(F.greatest(F.coalesce(F.max("keyword_score"), F.lit(1.0)), F.lit(1.0)).alias("most"))
    return met.crossJoin(F.broadcast(most)).withColumn("score", F.col("keyword_score") / F.col("most") * keyword_weight + F.col("similarity") * semantic_weight).drop("most")
