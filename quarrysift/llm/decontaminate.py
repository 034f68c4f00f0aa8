"""Benchmark items in documents, by SimHash over item-sized windows.

Items go in blocks of bounded size; each block makes an index that every task holds:

* the items' word shingles, so that only windows that share one are looked at (a window
  without a common shingle has similarity 0, so nothing is lost);
* 256-bit SimHash fingerprints of the items, cut into 16 blocks of 16 bits with all values
  within ``radius // 16`` bits of an item's (multi-index hashing): two fingerprints within
  the radius agree that closely in at least one block, so every such pair is met.

Each window of an item's number of words gets its fingerprint by running sums of bits; the
windows whose fingerprints lie within the radius are candidates, and the exact similarity
of their weighted shingles (sum of the smaller over sum of the larger counts) decides. A text
of fewer words than an item is one window, compared exactly with each such item that shares
a shingle.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .substring import Rolling, WordHashes

SHINGLE, SIMILARITY = 5, 0.8
#: Bits: at similarity 0.8 about 39 of 256 differ, give or take 6; unrelated texts differ in 128.
RADIUS, BLOCK_ITEMS = 63, 1000
_BASE = 0x9E3779B97F4A7C15
_MIX = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def _bits(h: np.ndarray) -> np.ndarray:
    """256 pseudo-random bits of each shingle hash, as rows of 0 and 1."""
    out = []
    for m in _MIX:
        x = (h ^ np.uint64(m)) * np.uint64(m)
        x ^= x >> np.uint64(29)
        x *= np.uint64(_BASE)
        x ^= x >> np.uint64(32)
        out.append(np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1))
    return np.concatenate(out, axis=1)


def _pack(ones: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(2 * ones > n, axis=-1)


def _ball(bits: int, radius: int) -> np.ndarray:
    """All masks of ``bits`` bits with at most ``radius`` set."""
    return np.array([sum(1 << b for b in c) for k in range(radius + 1) for c in itertools.combinations(range(bits), k)], np.uint16)


@dataclass
class ItemIndex:
    """Index of one block of items; ``words`` are those of each item."""

    ids: list
    words: list[list[bytes]]
    radius: int = RADIUS
    shingle: int = SHINGLE
    rolling: Rolling = field(default_factory=lambda: Rolling(_BASE))

    def __post_init__(self) -> None:
        hashes = WordHashes()
        n = len(self.words)
        self.size = np.array([len(w) for w in self.words])
        self.width = np.minimum(self.size, self.shingle)
        self.prints = np.zeros((n, 32), np.uint8)
        self.counts: list[tuple[np.ndarray, np.ndarray]] = []
        owner, grams = [], []
        for i, w in enumerate(self.words):
            g = self.grams(hashes.of(w), int(self.width[i])) if len(w) else np.zeros(0, np.uint64)
            self.prints[i] = _pack(_bits(g).sum(axis=0), len(g))
            self.counts.append(np.unique(g, return_counts=True))
            grams.append(self.counts[-1][0])
            owner.append(np.full(len(grams[-1]), i))
        gram, owner = np.concatenate([*grams, np.zeros(0, np.uint64)]), np.concatenate([*owner, np.zeros(0, np.int64)])
        order = np.argsort(gram, kind="stable")
        #: Items by shingle, sorted, behind a table of the first bits of all shingles.
        self.gram, self.owner = gram[order], owner[order]
        self.likely = np.zeros(1 << 20, bool)
        self.likely[self.gram >> np.uint64(44)] = True
        #: By 16-bit block: items near each value, as ranges of one list.
        self.near_start, self.near_item = [], []
        ball = _ball(16, self.radius // 16)
        for k in range(16):
            mine = np.ascontiguousarray(self.prints[:, 2 * k : 2 * k + 2]).view(np.uint16)[:, 0]
            value = (mine[:, None] ^ ball[None]).ravel()
            item = np.repeat(np.arange(n, dtype=np.int32), len(ball))
            order = np.argsort(value, kind="stable")
            self.near_start.append(np.searchsorted(value[order], np.arange(65_537)).astype(np.int32))
            self.near_item.append(item[order])

    def grams(self, h: np.ndarray, width: int) -> np.ndarray:
        at = np.arange(len(h) - width + 1)
        return self.rolling.runs(self.rolling.sums(h), at, at + width)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius."""
        values = prints.view(np.uint16)
        pairs = []
        for k in range(16):
            lo, hi = self.near_start[k][values[:, k]], self.near_start[k][values[:, k].astype(np.int64) + 1]
            n = (hi - lo).astype(np.int64)
            w = np.repeat(np.arange(len(prints)), n)
            i = self.near_item[k][np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
            pairs.append(w * len(self.ids) + i)
        pair = np.unique(np.concatenate(pairs))
        w, i = pair // len(self.ids), pair % len(self.ids)
        apart = np.bitwise_count(prints[w] ^ self.prints[i]).sum(axis=1, dtype=np.int64)
        return w[apart <= self.radius], i[apart <= self.radius]

    def similarity(self, g: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of a window's shingles and an item's."""
        known, weight = self.counts[item]
        mine, n = np.unique(g, return_counts=True)
        _, a, b = np.intersect1d(mine, known, assume_unique=True, return_indices=True)
        both = np.minimum(n[a], weight[b]).sum()
        return float(both / (len(g) + weight.sum() - both))

    def matches(self, h: np.ndarray, least: float) -> list[tuple[int, int, float]]:
        """(item, first word, similarity): the best window of each item in a text's word hashes."""
        best: dict[int, tuple[float, int]] = {}
        for width in np.unique(self.width[self.width > 0]).tolist():
            if len(h) < width:
                continue
            g = self.grams(h, width)
            at = np.flatnonzero(self.likely[g >> np.uint64(44)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(self.gram, g[at], "left"), np.searchsorted(self.gram, g[at], "right")
            n = hi - lo
            item = self.owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
            pos = np.repeat(at, n)
            mine = self.width[item] == width
            item, pos = item[mine], pos[mine]
            sizes = self.size[item]
            for size in np.unique(sizes).tolist():
                m = size - width + 1  # shingles of a window
                if size > len(h):  # the whole text is the one window
                    for i in np.unique(item[sizes == size]).tolist() if len(g) >= least * m else ():
                        s = self.similarity(g, i)
                        if s >= least:
                            best[i] = (s, 0)
                    continue
                p = np.unique(pos[sizes == size])
                edge = np.zeros(len(g) + 1, np.int64)  # window starts that hold one of these shingles
                np.add.at(edge, np.maximum(0, p - m + 1), 1)
                np.add.at(edge, np.minimum(p, len(h) - size) + 1, -1)
                on = np.cumsum(edge[:-1]) > 0
                flips = np.flatnonzero(np.diff(np.r_[False, on, False]))
                for a, b in zip(flips[::2].tolist(), flips[1::2].tolist(), strict=True):
                    for lo_ in range(a, b, 4096):  # bounds the memory of the sums
                        hi_ = min(b, lo_ + 4096)
                        sums = np.cumsum(np.concatenate([np.zeros((1, 256), np.int32), _bits(g[lo_ : hi_ + m - 1])]), axis=0, dtype=np.int32)
                        prints = _pack(sums[m:] - sums[:-m], m)
                        for w, i in zip(*(x.tolist() for x in self.near(prints)), strict=True):
                            if self.size[i] == size:
                                s = self.similarity(g[lo_ + w : lo_ + w + m], i)
                                if s >= least and (s, -(lo_ + w)) > best.get(i, (0.0, 0)):
                                    best[i] = (s, -(lo_ + w))
        return [(i, -start, s) for i, (s, start) in sorted(best.items())]


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _match_batches(batches: Iterator[pa.RecordBatch], shared, least: float) -> Iterator[pa.RecordBatch]:
    index, hashes = shared.value, WordHashes()
    for batch in batches:
        row, item, start, size, similarity = [], [], [], [], []
        for at, text in enumerate(batch.column("text").cast(pa.large_binary()).to_pylist()):
            words = (text or b"").lower().split()
            for i, s, x in index.matches(hashes.of(words), least):
                row.append(at)
                item.append(index.ids[i])
                start.append(s)
                size.append(min(int(index.size[i]), len(words)))
                similarity.append(x)
        arrays = [batch.column("doc_id").take(pa.array(row, pa.int32())), pa.array(item, pa.int64()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(similarity, pa.float64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "start_word", "n_words", "similarity"])


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity) for each row of ``docs`` and item in it.

    ``docs`` (doc_id, text, any others), ``benchmark`` (item_id, text, any others). A-Z are
    lower-cased; words are runs without ASCII white space; the best window, first of equal
    ones, is given. Items of fewer than five words make one shingle; items without words
    and null texts match nothing; null ids are carried like any other. Repeated rows give
    repeated matches. The benchmark is read in blocks of ``block_items``, each one pass
    over ``docs`` with an index of bounded size.
    """
    spark, out, block = docs.sparkSession, None, []

    def flush(found: DataFrame | None, items: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(ItemIndex([i for i, _ in items], [w for _, w in items], radius))
        mine = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_match_batches, shared=shared, least=least), "doc_id long, item_id long, start_word long, n_words long, similarity double")
        return mine if found is None else found.unionByName(mine)

    for r in benchmark.select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").toLocalIterator():
        if words := item_words(r.text):
            block.append((r.item_id, words))
        if len(block) >= block_items:
            out, block = flush(out, block), []
    return flush(out, block) if block or out is None else out


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity of benchmark items in all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return benchmark_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
