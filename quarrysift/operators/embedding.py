"""Vectors of results: a pluggable embedder over Arrow batches, an index by URL, search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import ranking
from .rounds import Buckets

Embedder = Callable[[list[str]], np.ndarray]


def hashed_words(size: int = 384) -> Embedder:
    """Unit vectors of signed counts of hashed words: a stand-in where no model is at hand."""

    def embed(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), size), np.float32)
        for row, text in zip(out, texts, strict=True):
            for w in T.words_of(text, 1):
                h = zlib.crc32(w.encode())
                row[h % size] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return embed


def embedded(df: DataFrame, text: str, embed: Embedder, together: int = 10) -> DataFrame:
    """``df`` with ``embedding`` of its ``text`` column, so many texts in a call; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            vectors = [embed(texts[i : i + together]) for i in range(0, len(texts), together)]
            flat = np.concatenate(vectors).astype(np.float32) if vectors else np.zeros((0, 1), np.float32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), flat.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "embedding"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, embedding array<float>")


class Index:
    """Vectors by URL in a bucketed table; a URL once indexed is not embedded again, nor its vector written."""

    def __init__(self, embed: Embedder):
        self.embed, self.table = embed, None

    def add(self, found: DataFrame) -> None:
        """Index results by title and snippet; of equal URLs among them the last one by ``ord``."""
        self.table = self.table or Buckets(found.sparkSession, "url")
        last = found.groupBy("url").agg(F.max_by(F.concat_ws(" ", "title", "snippet"), "ord").alias("text"))
        self.table.append(embedded(self.table.unknown(last), "text", self.embed).select("url", "embedding"))

    def search(self, query: str, n: int = 10) -> DataFrame:
        """(url, similarity) of the n nearest."""
        vector = [float(x) for x in self.embed([query])[0]]
        one = self.table.spark.range(1).select(F.array(*map(F.lit, vector)).alias("embedding"))
        return ranking.nearest(self.table.read(), one, n, "url").select("url", "similarity")

    def stats(self) -> dict:
        return {"vectors": 0 if self.table is None else self.table.read().count()}

    def available(self) -> bool:
        try:
            return len(self.embed(["x"])) == 1
        except Exception:
            return False

    def clear(self) -> None:
        if self.table is not None:
            self.table.drop()
        self.table = None
