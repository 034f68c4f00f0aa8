"""Ranked lexical search by a tree of maxima over document ranges and best-first branch and bound.

Documents in a row make ranges of 32, and 32 of those a shard. For each term a tree holds the
largest value that any document of a range gives it: the leaves are the postings, the root is
kept beside them in the index, and the nodes between are made from the leaves as a shard is
opened. The sum of an item's weights times the values of a node bounds the score of every
document below. A search goes best first:

* Spark sums the roots' values of each item in each shard. The shard of highest bound is
  opened first; its tenth score is the item's floor.
* Then only shards whose bound reaches the floor are opened, and in them, by a heap, only
  nodes whose bound reaches the tenth score so far; equal ones too, as a smaller doc_id wins a tie.

Shards, and blocks of items, are rows of their own, so that no task holds more than one of
each, whatever the number of documents and items. All arithmetic is in integers below 2**53.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

FANOUT, LEVELS = 32, 2
SHARD = FANOUT**LEVELS
#: Terms with repeats after which a shard is closed early; items of a block.
SHARD_TERMS, BLOCK = 2_000_000, 1000
#: Any byte that is no term character is a space: terms are runs of ASCII letters, digits and all beyond ASCII.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and code points from 128 on, only A-Z lower-cased; null has none."""
    return (text or b"").translate(_TERMS).split()


def _texts(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    return (t.as_py() for t in batch.column("text").cast(pa.large_binary()))


def _size_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(terms(t)) for t in _texts(batch)]
        yield pa.RecordBatch.from_arrays([pa.array([sum(x > 0 for x in n)], pa.int64()), pa.array([sum(n)], pa.int64())], names=["n", "terms"])


class _Numbers(dict):
    """A number for each new term."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def _blobs(flat: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary for each run of ``flat`` that begins at ``starts``."""
    at = np.r_[starts, len(flat)].astype(np.int64) * flat.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


_INDEX = [("shard", pa.int64()), ("term", pa.string()), ("places", pa.binary()), ("values", pa.binary()), ("df", pa.int32()), ("best", pa.int32()), ("ids", pa.list_(pa.int64()))]
_INDEX_DDL = "shard long, term string, places binary, values binary, df int, best int, ids array<long>"


def _shard_rows(shard: int, ids: list, lists: list[np.ndarray], numbers: _Numbers, average: tuple[int, int]) -> pa.RecordBatch:
    """Postings of one shard, a row for each term, and one with the documents' ids."""
    n, total = average
    sizes = np.array([len(x) for x in lists], np.int64)
    keys, tf = np.unique(np.concatenate(lists) * SHARD + np.repeat(np.arange(len(lists)), sizes), return_counts=True)
    place, term = keys % SHARD, keys // SHARD
    m = 25 + (75 * sizes * n) // max(1, total)
    value = (1_000_000_000 * tf // (1000 * tf + 8 * m[place])).astype(np.int32)
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
    df = np.diff(np.r_[starts, len(term)]).astype(np.int32)
    best = np.maximum.reduceat(value, starts) if len(starts) else value
    k = len(starts)
    head = [pa.nulls(1, t) for _, t in _INDEX[:-1]]
    head[0] = pa.array([shard], pa.int64())
    body = [pa.array(np.full(k, shard)), pa.array(list(numbers), pa.binary()).cast(pa.string()), _blobs(place.astype(np.uint16), starts), _blobs(value, starts), pa.array(df), pa.array(best), pa.nulls(k, pa.list_(pa.int64()))]
    columns = [pa.concat_arrays([h, b]) for h, b in zip([*head, pa.array([ids], pa.list_(pa.int64()))], body, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[x for x, _ in _INDEX])


def _index_batches(batches: Iterator[pa.RecordBatch], average: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId() << 32  # the same again if the task is run again
    ids, lists, numbers, held = [], [], _Numbers(), 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), _texts(batch), strict=True):
            words = terms(text)
            if not words:
                continue
            ids.append(doc_id)
            lists.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            held += len(words)
            if len(ids) == SHARD or held >= SHARD_TERMS:
                yield _shard_rows(shard, ids, lists, numbers, average)
                shard, ids, lists, numbers, held = shard + 1, [], [], _Numbers(), 0
    if ids:
        yield _shard_rows(shard, ids, lists, numbers, average)


def build_index(docs: DataFrame) -> tuple[DataFrame, int]:
    """The index of ``docs`` (doc_id, text) as a written table, and how many documents have a term.

    A row for each shard and term: the documents' places in the shard, the value that each gives the
    term, how many they are and the largest value; and a row with a null term and the doc_ids. It
    holds every term of every document; null, empty and word-less texts are in no shard.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n, total = docs.select("text").mapInArrow(_size_batches, "n long, terms long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    return materialize(docs.mapInArrow(partial(_index_batches, average=(n, total)), _INDEX_DDL), "index"), n


class Shard:
    """Trees of the terms of one shard; term t's entries of a level are those from ``at[level][t]`` to ``at[level][t + 1]``."""

    def __init__(self, postings: list[dict], ids: list):
        self.ids = ids
        self.number = {p["term"]: i for i, p in enumerate(postings)}
        sizes = np.array([len(p["places"]) // 2 for p in postings], np.int64)
        place = np.frombuffer(b"".join(p["places"] for p in postings), np.uint16).astype(np.int64)
        term, value = np.repeat(np.arange(len(sizes)), sizes), np.frombuffer(b"".join(p["values"] for p in postings), np.int32).astype(np.int64)
        width = SHARD
        #: By level from the leaves up: keys (term * width + node), values, width.
        self.levels = [(term * width + place, value, width)]
        while width > FANOUT:
            key = self.levels[-1][0] // FANOUT  # widths are powers of the fan-out
            width //= FANOUT
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            self.levels.append((key[starts], np.maximum.reduceat(value, starts) if len(starts) else value, width))
            value = self.levels[-1][1]

    def below(self, level: int, node: int, who: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Bounds (at level 0: scores) of the children, at ``level``, of a node one level up."""
        key, value, width = self.levels[level]
        first = who * width + node * FANOUT
        lo, hi = np.searchsorted(key, first), np.searchsorted(key, first + min(FANOUT, width))
        size = hi - lo
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(key[at] % FANOUT, np.repeat(weight, size) * value[at], FANOUT)

    def search(self, wanted: list[dict], floor: int, most: int) -> list[tuple[int, int]]:
        """The ``most`` best (score, doc_id) of at least ``floor``; equal scores by doc_id, null last."""
        own = [(self.number[t["term"]], t["weight"]) for t in wanted if t["term"] in self.number]
        if not own:
            return []
        who, weight = (np.array(x, np.int64) for x in zip(*sorted(own), strict=True))
        found: list[tuple[int, float, int]] = []  # (score, -doc_id, place): a heap of the best, the worst first
        heap = [(-float("inf"), len(self.levels), 0)]
        while heap and -heap[0][0] >= floor:
            _, level, node = heapq.heappop(heap)
            bound = self.below(level - 1, node, who, weight)
            for k in np.flatnonzero(bound >= max(floor, 1)).tolist():
                if level > 1:
                    heapq.heappush(heap, (-bound[k], level - 1, node * FANOUT + k))
                    continue
                place = node * FANOUT + k
                doc_id = self.ids[place]
                entry = (int(bound[k]), -float("inf") if doc_id is None else -doc_id, place)
                if len(found) < most:
                    heapq.heappush(found, entry)
                else:
                    heapq.heappushpop(found, entry)
                if len(found) == most:
                    floor = max(floor, found[0][0])
        return [(score, self.ids[place]) for score, _, place in sorted(found, reverse=True)]


def _search_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            shard = Shard(row.column("postings")[0].as_py(), row.column("ids")[0].as_py())
            out = [(w["item"], doc_id, score) for w in row.column("wanted")[0].as_py() for score, doc_id in shard.search(w["terms"], w["floor"], most)]
            kinds = [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [()] * 3, kinds, strict=True)], names=["item", "doc_id", "score"])


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [[t.decode() for t in terms(x)] for x in _texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(lists, pa.list_(pa.string()))], names=["item", "terms"])


def search(index: DataFrame, n: int, items: DataFrame, most: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``most`` best documents with a score above 0 for each of ``items`` (item_id, text).

    ``index`` and ``n`` come from ``build_index``. Equal scores rank by doc_id, a null one last; rows of
    ``docs`` with one doc_id rank each. Equal rows of ``items`` are one item, other rows with one item_id
    are items of their own. An item without a term that some document holds has no row.
    """
    named = materialize(items.select("item_id", "text").distinct().select("item_id", F.xxhash64("item_id", "text").alias("item"), "text"), "items")
    own = materialize(named.select("item", "text").mapInArrow(_term_batches, "item long, terms array<string>").select("item", F.explode("terms").alias("term")).groupBy("item", "term").agg(F.count("*").alias("k")), "terms")
    asked = own.select("term").distinct()
    posting = F.struct("term", "places", "values", "df", "best")
    # a shard has so many documents and terms at most, whatever the table holds
    held = index.join(asked, "term", "left_semi").unionByName(index.filter("term is null")).groupBy("shard").agg(F.collect_list(F.when(F.col("term").isNotNull(), posting)).alias("postings"), F.max("ids").alias("ids"))
    held = materialize(held.filter(F.size("postings") > 0), "shards")
    roots = held.select("shard", F.explode(F.transform("postings", lambda p: F.struct(p["term"].alias("term"), p["df"].alias("df"), p["best"].alias("best")))).alias("r")).select("shard", "r.term", "r.df", "r.best")
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.sum("df") + 1)))
    weights = roots.groupBy("term").agg(weight.alias("w")).filter("w > 0")
    weighted = materialize(own.join(weights, "term").select("item", "term", (F.col("k") * F.col("w")).alias("weight")), "weights")
    bounds = materialize(weighted.join(roots, "term").groupBy("item", "shard").agg(F.sum(F.col("weight") * F.col("best")).alias("bound")), "bounds")
    # an item's terms are as many as its text has
    lists = weighted.groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    blocks = max(1, -(-named.count() // BLOCK))

    def opened(pairs: DataFrame, name: str) -> DataFrame:
        """The best of each (item, shard, floor)."""
        wanted = pairs.join(lists, "item").groupBy("shard", F.pmod("item", F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("item", "floor", "terms")).alias("wanted"))
        met = wanted.join(held.select("shard", F.transform("postings", lambda p: F.struct(p["term"].alias("term"), p["places"].alias("places"), p["values"].alias("values"))).alias("postings"), "ids"), "shard")
        spread = met.select("postings", "ids", "wanted").repartition(F.rand(7))
        return materialize(spread.mapInArrow(partial(_search_batches, most=most), "item long, doc_id long, score long"), name)

    firsts = materialize(bounds.groupBy("item").agg(F.max_by("shard", F.struct("bound", "shard")).alias("shard")), "firsts")
    begun = opened(firsts.select("item", "shard", F.lit(1).cast("long").alias("floor")), "begun")
    floors = begun.groupBy("item").agg(F.when(F.count("*") >= most, F.min("score")).otherwise(1).alias("floor"))
    rest = bounds.join(firsts.select("item", F.col("shard").alias("done")), "item").filter("shard <> done").join(floors, "item", "left").withColumn("floor", F.coalesce("floor", F.lit(1)).cast("long")).filter("bound >= floor")
    found = begun.unionByName(opened(rest.select("item", "shard", "floor"), "found"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = found.withColumn("rank", place).filter(F.col("rank") <= most)
    return best.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: the 10 best of ``documents`` for each item of ``benchmark``."""
    index, n = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return search(index, n, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SQL_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
with docs as materialized (select row_number() over () as rid, doc_id, {_SQL_TERMS} as t from documents),
size as (select rid, doc_id, cast(len(t) as bigint) as n from docs where len(t) > 0),
total as (select count(*) as big_n, cast(sum(n) as bigint) as big_l from size),
asked as (select item_id, term, count(*) as k from (select item_id, unnest({_SQL_TERMS}) as term from benchmark) group by all),
post as (select rid, term, count(*) as tf from (select rid, unnest(t) as term from docs) where term in (select term from asked) group by all),
weight as (select term, cast(floor(1000 * ln((2 * (select big_n from total) + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from post group by term),
value as (select p.rid, p.term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l)) as v from post p join size using (rid), total),
scored as (select item_id, rid, cast(sum(k * w * v) as bigint) as score from asked join weight using (term) join value using (term) group by all),
ranked as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from scored join size using (rid) where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""
