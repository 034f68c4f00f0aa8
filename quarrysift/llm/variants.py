"""Spelling variants: words that differ by one code point, by merging the light parts of a trie.

The words make a trie. At each node the child with most words below it (ties: the greatest
code point) is the heavy one, the others are light, and so is the end of a word at a node that
has children. Two words at one edit part at some node, so at least one of them goes on by a
light edge there, and a word has no more than log2(words) light edges. Only these are copied:

* replaced: the light subtrees of a node are merged below a joker; words whose ends coincide
  there differ by that one code point, and the heavy subtree is asked for the same end;
* skipped: the light subtree without its first code point is merged into its parent's trie;
* put in: the light subtree is merged into the heavy child's, behind its code point.

A merge is an equi-join of terminals by their path. Of a run of one code point the last is
skipped, so each pair is found once, at one node. The code points that meet below a joker
are different, so such a group is no larger than the alphabet.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

RUN = r"[A-Za-zÀ-ÿ]+"
#: One in so many (document, run) pairs loses a code point, so that variants exist to be found.
DAMAGE = 31
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Different words that a task counts together.
HELD = 300_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def damaged(doc_id: int | None, word: str, start: int, one_in: int) -> str:
    """The run without one code point, if the crc32 of ``<doc_id>:<run>`` says so; ``start`` is that of ``<doc_id>:``."""
    h = zlib.crc32(word.encode(), start)
    if h % one_in:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _count_batches(batches: Iterator[pa.RecordBatch], run: str, least: int, one_in: int | None) -> Iterator[pa.RecordBatch]:
    find, total = re.compile(run).findall, Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
            own = Counter(find((text.as_py() or b"").translate(_LOWER).decode()))
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for word, k in own.items():
                if len(word) < least:
                    continue
                if one_in:
                    word = damaged(doc_id, word, start, one_in)
                    if len(word) < least:
                        continue
                total[word] += k
            if len(total) > HELD:
                yield rows()
                total.clear()
    if total:
        yield rows()


def vocabulary(docs: DataFrame, run: str = RUN, least: int = LEAST_LENGTH, count: int = LEAST_COUNT, one_in: int | None = DAMAGE) -> DataFrame:
    """(word, n): the runs of at least ``least`` code points and ``count`` uses in ``docs`` (doc_id, text), only A-Z lower-cased.

    One in ``one_in`` pairs of a document and a run loses a code point (None: no run does).
    Null and empty texts have no words; repeated rows count each; a null doc_id counts as empty.
    """
    counted = docs.select("doc_id", "text").mapInArrow(partial(_count_batches, run=run, least=least, one_in=one_in), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= count)


def _head(word: str, n) -> F.Column:
    return F.substring(word, F.lit(1), n)


def light_edges(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, n, p, c, s, h): each word (p, c, s in a row) at each light edge c of its path, h the node's heavy child;
    and (word, n, h): the words that end at a node with children."""
    paths = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("d")).withColumn("q", _head("word", F.col("d")))
    nodes = materialize(paths.groupBy("q").agg(F.count("*").alias("m")).select("q", _head("q", F.length("q") - 1).alias("p"), F.substring("q", -1, 1).alias("c"), "m"), "trie")
    heavy = materialize(nodes.groupBy("p").agg(F.max_by("c", F.struct("m", "c")).alias("h"), F.count("*").alias("k")), "heavy")
    light = nodes.join(heavy.filter("k > 1").select("p", "h"), "p").filter("c <> h").select("q", "h")
    inner = paths.join(light, "q").select("word", "n", _head("word", F.col("d") - 1).alias("p"), F.substring("word", F.col("d"), F.lit(1)).alias("c"), F.substring("word", F.col("d") + 1, F.length("word")).alias("s"), "h")
    ends = words.join(heavy.select(F.col("p").alias("word"), "h"), "word").select("word", "n", "h")
    return materialize(inner, "light"), ends


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n): how many of ``words`` (word, n) are one edit away, and the one of largest n (ties: the smallest).

    ``words`` is read several times and should be a table. Words without any have no row.
    """
    inner, ends = light_edges(words)
    other = words.select(F.col("word").alias("key"), F.col("n").alias("key_n"))
    skipped = inner.filter(F.substring("s", 1, 1) != F.col("c")).select("word", "n", F.concat("p", "s").alias("key"))
    put_in = inner.select("word", "n", F.concat("p", "h", "c", "s").alias("key")).unionByName(ends.select("word", "n", F.concat("word", "h").alias("key")))
    met = skipped.unionByName(put_in).join(other, "key")
    sides = F.array(F.struct("word", (-F.col("key_n")).alias("r"), F.col("key").alias("near")), F.struct(F.col("key").alias("word"), (-F.col("n")).alias("r"), F.col("word").alias("near")))
    apart = met.select(F.explode(sides).alias("x")).select("x.word", F.lit(1).alias("k"), F.struct("x.r", "x.near").alias("best"))
    # different code points below one joker: no more than the alphabet has
    joker = inner.groupBy("p", "s", "h").agg(F.collect_list(F.struct((-F.col("n")).alias("r"), F.col("word").alias("near"))).alias("m"))
    joker = joker.withColumn("key", F.concat("p", "h", "s")).join(other, "key", "left").select(F.when(F.col("key_n").isNull(), F.col("m")).otherwise(F.concat("m", F.array(F.struct((-F.col("key_n")).alias("r"), F.col("key").alias("near"))))).alias("m"))
    ranked = joker.filter(F.size("m") > 1).select(F.array_sort("m").alias("m"))
    replaced = ranked.select("m", F.posexplode("m").alias("i", "x")).select(F.col("x.near").alias("word"), F.size("m") - 1, F.when(F.col("i") == 0, F.col("m")[1]).otherwise(F.col("m")[0]))
    best = apart.union(replaced).groupBy("word").agg(F.sum("k").cast("long").alias("n_near"), F.min("best").alias("best"))
    return best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.r")).alias("near_n"))


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each of ``words`` (word, n).

    ``form`` is the near word of largest n, if that is ``ratio`` times the word's n or more,
    else null; ``root`` the last form on the way up, the word itself if it has none. An empty
    table gives no rows.
    """
    near = near_words(words)
    formed = words.join(near, "word", "left").withColumn("is", F.col("near_n") >= ratio * F.col("n"))
    formed = materialize(formed.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("is"), F.col("near")).alias("form"), F.when(F.col("is"), F.col("near_n")).alias("form_n")), "forms")
    up = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    # n grows by the ratio with each step, so that a way has fewer steps than a long has digits; each round doubles those taken
    for _ in range(max(1, (int(63 / max(1, ratio.bit_length() - 1))).bit_length())):
        up = materialize(up.join(up.select(F.col("word").alias("root"), F.col("root").alias("last")), "root", "left").select("word", F.coalesce("last", "root").alias("root")), "roots")
        if up.join(up.select(F.col("word").alias("root")), "root", "left_semi").isEmpty():
            break
    return formed.join(up, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_variants(spark, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = materialize(vocabulary(docs), "words")
    return variant_groups(words).select("word", "form", "root", "n", "n_near", "form_n")
