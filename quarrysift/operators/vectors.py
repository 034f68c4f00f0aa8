"""The nearest vectors of many queries: products of blocks, and the best of each block merged."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

#: Vectors and queries in a block; bytes of queries that are sent to all; parts among which one block of queries meets all vectors.
BLOCK, SENT, PARTS = 4096, 64 << 20, 64


def _matrix(column: pa.Array) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of up to ``BLOCK`` ids and vectors each, as they come."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            data = _matrix(pa.concat_arrays([part.column("embedding")])).astype(np.float64).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([data], pa.binary())], names=["ids", "data"])


def _unit(data: bytes, rows: int) -> np.ndarray:
    x = np.frombuffer(data).reshape(rows, -1)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm == 0, 1, norm)


def _best_batches(batches: Iterator[pa.RecordBatch], n: int, digits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):  # row by row: the blocks of a batch are not copied at once
            ids, queries = (batch.column(c)[at].values.to_numpy().astype(np.int64) for c in ("ids", "query_ids"))
            x, q = _unit(batch.column("data")[at].as_buffer(), len(ids)), _unit(batch.column("query_data")[at].as_buffer(), len(queries))
            if x.shape[1] != q.shape[1]:
                raise ValueError("vectors differ in length")
            out: list[tuple] = []
            for lo in range(0, len(queries), 256):
                near = np.round(q[lo : lo + 256] @ x.T, digits) + 0.0  # no negative zero
                few = min(n, len(ids))
                least = np.partition(near, len(ids) - few, axis=1)[:, len(ids) - few]
                for k, scores in enumerate(near):
                    at = np.flatnonzero(scores >= least[k])  # ties of the last one too
                    at = at[np.lexsort((ids[at], -scores[at]))][:few]
                    out.append((np.full(len(at), queries[lo + k]), ids[at], scores[at]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query", "id", "similarity"])


def nearest_many(vectors: DataFrame, queries: DataFrame, n: int = 10, key: str = "vec_id", digits: int = 12) -> DataFrame:
    """(query, rank, key, similarity): the n vectors of most cosine similarity (to so many digits) for each row of ``queries``.

    Both have ``key`` (a whole number) and ``embedding``; ties go by key. A vector of zeros is at 0 to
    all; null embeddings are left out; unequal lengths are an error. No more than queries times
    blocks times n rows move.
    """
    side = lambda df: df.filter("embedding is not null").select(F.col(key).cast("long").alias("id"), "embedding")
    pack = lambda df: df.mapInArrow(_block_batches, "ids array<long>, data binary")
    asked = materialize(pack(side(queries)).select(F.monotonically_increasing_id().alias("block"), F.col("ids").alias("query_ids"), F.col("data").alias("query_data")), "queries")
    total = asked.agg(F.coalesce(F.sum(F.length("query_data")), F.lit(0))).first()[0]
    blocks = pack(side(vectors))
    if total <= SENT:
        met = blocks.crossJoin(F.broadcast(asked))  # a checked size; a row for each pair of blocks
    else:
        part = F.sequence(F.lit(0), F.lit(PARTS - 1))
        met = blocks.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(PARTS)).cast("int")).join(asked.withColumn("part", F.explode(part)), "part")
    best = met.select("ids", "data", "query_ids", "query_data").mapInArrow(partial(_best_batches, n=n, digits=digits), "query long, id long, similarity double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return best.withColumn("rank", place).filter(F.col("rank") <= n).select("query", "rank", F.col("id").alias(key), "similarity")
