"""Instant answers with topics nested to any depth, as results: payloads are read as variants, topics by recursion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import materialize

#: A topic and the topics inside it, down to the last; ``path`` is the place at each level, so that its order is depth first.
_TREE = """
with recursive tree(id, path, topic) max recursion level {depth} as (
  select id, array(5, pos), value from {answers}, lateral variant_explode(try_variant_get(v, '$.RelatedTopics', 'variant'))
  union all
  select id, concat(path, array(x.pos)), x.value from tree, lateral variant_explode(try_variant_get(topic, '$.Topics', 'variant')) as x
) select id, path, topic from tree
"""
#: Rows that a recursion may make; by default Spark stops at a million.
_ROWS = "spark.sql.cteRecursionRowLimit"


def _get(v: str, path: str) -> Column:
    return F.coalesce(F.try_variant_get(F.col(v), f"$.{path}", "string"), F.lit(""))


def topic_tree(answers: DataFrame, depth: int = 100) -> DataFrame:
    """(id, path, topic variant) of every related topic of ``answers`` (id, v variant), at any of ``depth`` levels."""
    spark = answers.sparkSession
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, "-1")
    try:
        return materialize(spark.sql(_TREE.replace("{depth}", str(depth)), answers=answers).select("id", "path", F.to_json("topic").alias("topic")), "topics").withColumn("topic", F.parse_json("topic"))
    finally:
        spark.conf.set(_ROWS, before)


def _topic(v: str, kind: str) -> list[Column]:
    """Result columns of a topic or a direct result."""
    text = _get(v, "Text")
    anchor = T.anchor_title(_get(v, "Result"), text)
    return [_get(v, "FirstURL").alias("url"), anchor.alias("title"), text.alias("snippet"), F.lit(kind).alias("type"), F.nullif(_get(v, "Icon.URL"), F.lit("")).alias("icon"), ((_get(v, "FirstURL") != "") & (text != "")).alias("good")]


def _filled(*options: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in options])


def _component(text: Column) -> Column:
    """Percent-encoding that leaves the marks ! ' ( ) as they are and writes a space as %20."""
    out = F.url_encode(text)
    for code, mark in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def instant_answers(df: DataFrame, as_of: Column, limit: int = 20) -> DataFrame:
    """(ord, url, title, snippet, source, ts, metadata): abstract, answer, definition, results, then topics depth first.

    ``df`` has a JSON column ``payload``; no more than ``limit`` rows come of one. ``ord`` counts from a
    payload's own ``ord``, if it has one, which then must tell payloads apart. A payload that is no JSON has no rows.
    """
    first = F.col("ord").cast("long") if "ord" in df.columns else F.lit(0).cast("long")
    rows = materialize(df.select(first.alias("first"), F.monotonically_increasing_id().alias("id"), "payload"), "answers")
    answers = rows.select("id", F.try_parse_json("payload").alias("v"))
    get = lambda p: _get("v", p)
    none = F.lit(None).cast("string")
    heads = [
        (get("AbstractURL"), _filled(get("Heading"), get("AbstractSource"), F.lit("DuckDuckGo Result")), get("AbstractText"), "abstract", _filled(get("Image")), (get("AbstractURL") != "") & (get("AbstractText") != "")),
        (F.concat(F.lit("https://duckduckgo.com/?q="), _component(get("Heading"))), F.concat(F.lit("Answer: "), get("AnswerType")), get("Answer"), "answer", none, (get("Answer") != "") & (get("AnswerType") != "")),
        (get("DefinitionURL"), F.concat(F.lit("Definition from "), _filled(get("DefinitionSource"), F.lit("Unknown"))), get("Definition"), "definition", none, (get("DefinitionURL") != "") & (get("Definition") != "")),
    ]
    head = lambda i, h: F.struct(F.array(F.lit(i)).alias("path"), h[0].alias("url"), h[1].alias("title"), h[2].alias("snippet"), F.lit(h[3]).alias("type"), h[4].alias("icon"), h[5].alias("good"))
    top = answers.select("id", F.explode(F.array(*[head(i, h) for i, h in enumerate(heads)])).alias("h")).select("id", "h.*")
    spark = df.sparkSession
    direct = spark.sql("select id, array(4, x.pos) as path, x.value as t from {answers}, lateral variant_explode(try_variant_get(v, '$.Results', 'variant')) as x", answers=answers)
    direct = direct.select("id", "path", *_topic("t", "result"))
    related = topic_tree(answers).select("id", "path", *_topic("topic", "related"))
    found = top.unionByName(direct).unionByName(related).filter("good")
    place = F.row_number().over(Window.partitionBy("id").orderBy("path"))
    best = found.withColumn("place", place).filter(F.col("place") <= limit).join(rows.select("id", "first"), "id")
    extra = F.when(F.col("icon").isNotNull(), F.create_map(F.lit("type"), F.col("type"), F.when(F.col("type") == "abstract", "image").otherwise("icon"), F.col("icon"))).otherwise(F.create_map(F.lit("type"), F.col("type")))
    return best.select((F.col("first") + F.col("place") - 1).alias("ord"), "url", "title", "snippet", F.lit("duckduckgo").alias("source"), as_of.alias("ts"), extra.alias("metadata"))
