"""SimHash fingerprints and near-duplicate classes by a Gray-order hierarchical index.

Fingerprints are 64 bits. The pairs to find differ in at most ``radius`` bits. By the
pigeonhole principle such a pair agrees in at least one of ``radius + 1`` bit blocks, so
every distinct fingerprint is dealt to one bucket for each block; within a bucket an
index in Gray order finds the pairs:

* the fingerprints are sorted by Gray rank and grouped, 16 at a time, into a tree;
* a node holds the bits that all below it share, less those that its parent holds;
* a search carries the differences accumulated on the way down, drops a whole group once
  they pass the radius, and takes a whole group once no bit left can pass it.

A bucket gives a spanning forest of its links (never more edges than fingerprints), not
all pairs. Classes come from the edges by alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SEED = 42
FANOUT = 16
#: Distinct fingerprints of one bucket beyond which it is split by a second set of blocks.
HOT_BUCKET = 100_000
#: Rows of small buckets that are searched together, and pairs held at once in a search.
CHUNK_ROWS, CHUNK_PAIRS = 200_000, 1_000_000


def fingerprint(data: bytes | None, shingle: int = 3, seed: int = SEED) -> int:
    """SimHash of the word shingles of a UTF-8 text, as an unsigned integer.

    A-Z are lower-cased; words are runs without ASCII white space. Fewer words than
    ``shingle`` make one shingle of them all; no words (or null) give 0.
    """
    words = data.lower().split() if data else []
    if not words:
        return 0
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        part = words[at : min(at + 65_536, n) + shingle - 1]
        if len(part) < shingle:
            rows = [b" ".join(part)]
        else:
            rows = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        h = np.fromiter(map(digest, rows), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], shingle: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        fps = np.fromiter((fingerprint(x.as_py(), shingle, seed) for x in texts), np.uint64, len(texts))
        others = [batch.column(n) for n in batch.schema.names if n != "text"]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*others, pa.array(fps.view(np.int64))], names=[*names, "fp"])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = SEED) -> DataFrame:
    """(doc_id, fp long) of every row of ``docs``; fp holds the unsigned bits as signed."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(partial(_fingerprint_batches, shingle=shingle, seed=seed), f"doc_id {kind}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each 64-bit word in the reflected Gray code."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _gray_keys(fps: np.ndarray) -> list[np.ndarray]:
    """Sort keys of the Gray order, the last one first; a row may be of several words, the first of them highest."""
    if fps.ndim == 1:
        return [gray_rank(fps)]
    odd, keys = np.zeros(len(fps), np.uint64), []
    for word in fps.T:
        keys.append(gray_rank(word) ^ (np.uint64(0) - odd))
        odd ^= np.bitwise_count(word).astype(np.uint64) & np.uint64(1)
    return keys[::-1]


def _merge(comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the classes of a[i] and b[i]; comp[i] is the class's first member."""
    while True:
        ra, rb = comp[a], comp[b]
        m = ra != rb
        if not m.any():
            return comp
        a, b = a[m], b[m]
        np.minimum.at(comp, np.maximum(ra[m], rb[m]), np.minimum(ra[m], rb[m]))
        while True:
            up = comp[comp]
            if np.array_equal(up, comp):
                break
            comp = up


class GrayIndex:
    """Hierarchy over fingerprints, a tree for each bucket, for self-joins in a radius.

    Fingerprints are words of 64 bits, or rows of such words.
    """

    def __init__(self, bucket: np.ndarray, fps: np.ndarray):
        order = np.lexsort((*_gray_keys(fps), bucket))
        self.fps, self.order = fps[order], order
        b, every = bucket[order], np.uint64(0xFFFFFFFFFFFFFFFF)
        n = len(fps)
        pattern, shared = self.fps, np.full(fps.shape, every)
        first, last = np.arange(n), np.arange(1, n + 1)
        #: By level from the leaves up: pattern, shared bits, members' range, children's range.
        self.levels = [[pattern, shared, first, last, None, None]]
        buckets = len(np.unique(b))
        while len(b) > buckets:
            new = np.r_[True, b[1:] != b[:-1]]
            pos = np.arange(len(b))
            pos -= np.maximum.accumulate(np.where(new, pos, 0))
            starts = np.flatnonzero(pos % FANOUT == 0)
            ends = np.r_[starts[1:], len(b)]
            low = np.bitwise_and.reduceat(pattern & shared, starts, axis=0)
            high = np.bitwise_or.reduceat(pattern | ~shared, starts, axis=0)
            pattern, shared = low, ~(low ^ high)
            first, last, b = first[starts], last[ends - 1], b[starts]
            self.levels.append([pattern, shared, first, last, starts, ends])
        #: Bits that a node adds to what its parent holds.
        self.residual = []
        for k, (_, shared, *_rest) in enumerate(self.levels):
            if k + 1 < len(self.levels):
                up, starts, ends = self.levels[k + 1][1], self.levels[k + 1][4], self.levels[k + 1][5]
                self.residual.append(shared & ~np.repeat(up, ends - starts, axis=0))
            else:
                self.residual.append(shared)
        tops = self.levels[-1]
        self.root = np.repeat(np.arange(len(tops[2])), tops[3] - tops[2])

    def classes(self, radius: int, wide: np.ndarray | None = None, apart: int = 0) -> np.ndarray:
        """For each fingerprint in the given order, the index of its class's representative.

        Two fingerprints of a bucket within ``radius`` bits are in one class; classes are
        closed under such links. With ``wide`` (a row of words each), a link also needs
        wide fingerprints of at most ``apart`` different bits.
        """
        n = len(self.fps)
        wide = None if wide is None else wide[self.order]
        comp = np.arange(n)
        step = 4096 if len(self.levels) > 2 else max(4096, n)
        for at in range(0, n, step):
            q = np.arange(at, min(at + step, n))
            low = high = None
            if len(self.levels) > 2:  # classes that fill whole groups need no further search
                low = [np.minimum.reduceat(comp, x[2]) for x in self.levels]
                high = [np.maximum.reduceat(comp, x[2]) for x in self.levels]
            a, b, chain = [], [], np.zeros(n + 1, np.int64)
            top = len(self.levels) - 1
            stack = [(top, q, self.root[q], np.zeros(len(q), np.uint8))]
            while stack:
                level, q, node, acc = stack.pop()
                if len(q) > CHUNK_PAIRS:
                    half = len(q) // 2
                    stack += [(level, q[:half], node[:half], acc[:half]), (level, q[half:], node[half:], acc[half:])]
                    continue
                pattern, shared, first, last, starts, ends = self.levels[level]
                fq = self.fps[q]
                acc = acc + np.bitwise_count((fq ^ pattern[node]) & self.residual[level][node])
                keep = (acc <= radius) & (last[node] > q + 1)
                if low is not None:
                    keep &= (low[level][node] != comp[q]) | (high[level][node] != comp[q])
                q, node, acc = q[keep], node[keep], acc[keep]
                if level == 0:
                    if wide is not None:
                        near = np.bitwise_count(wide[q] ^ wide[node]).sum(axis=1, dtype=np.int64) <= apart
                        q, node = q[near], node[near]
                    a.append(q)
                    b.append(node)
                    continue
                whole = acc + np.bitwise_count(~shared[node]) <= radius
                if wide is None and whole.any():
                    lo, hi = first[node[whole]], last[node[whole]]
                    a.append(q[whole])
                    b.append(lo)
                    np.add.at(chain, lo, 1)
                    np.add.at(chain, hi - 1, -1)
                    q, node, acc = q[~whole], node[~whole], acc[~whole]
                size = ends[node] - starts[node]
                if size.sum():
                    # children of each node, in pieces that bound the memory
                    cut = np.searchsorted(np.cumsum(size), np.arange(CHUNK_PAIRS, size.sum() + CHUNK_PAIRS, CHUNK_PAIRS))
                    lo = 0
                    for hi in np.unique(np.minimum(cut + 1, len(q))):
                        s = size[lo:hi]
                        off = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
                        stack.append((level - 1, np.repeat(q[lo:hi], s), np.repeat(starts[node[lo:hi]], s) + off, np.repeat(acc[lo:hi], s)))
                        lo = hi
            link = np.flatnonzero(np.cumsum(chain)[:n] > 0)
            a.append(link)
            b.append(link + 1)
            comp = _merge(comp, np.concatenate(a), np.concatenate(b))
        out = np.empty(n, np.int64)
        out[self.order] = self.order[comp]
        return out

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, bits): all pairs of a bucket within ``radius``, each once; fingerprints are rows of words."""
        words = [[(pattern[:, k].copy(), residual[:, k].copy()) for k in range(pattern.shape[1])] for (pattern, *_), residual in zip(self.levels, self.residual, strict=True)]
        n, top, most = len(self.fps), len(self.levels) - 1, CHUNK_PAIRS // FANOUT
        for at in range(0, n, most):
            q = np.arange(at, min(at + most, n))
            stack = [(top, q, self.root[q], np.zeros(len(q), np.int16))]
            while stack:
                level, q, node, acc = stack.pop()
                if len(q) > most:
                    stack += [(level, q[most:], node[most:], acc[most:])]
                    q, node, acc = q[:most], node[:most], acc[:most]
                last, starts, ends = self.levels[level][3:]
                ahead = last[node] > q + 1
                q, node, acc = q[ahead], node[ahead], acc[ahead]
                for (own, _), (pattern, residual) in zip(words[0], words[level], strict=True):
                    acc = acc + np.bitwise_count((own[q] ^ pattern[node]) & residual[node])
                keep = acc <= radius
                q, node, acc = q[keep], node[keep], acc[keep]
                if level == 0:
                    yield self.order[q], self.order[node], acc
                elif len(q):
                    size = ends[node] - starts[node]
                    off = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    stack.append((level - 1, np.repeat(q, size), np.repeat(starts[node], size) + off, np.repeat(acc, size)))


def _bucket_edges(batches: Iterator[pa.RecordBatch], radius: int, apart: int | None = None) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the links in each bucket; rows come sorted by bucket.

    With ``apart``, rows hold a node number and a wide fingerprint (f0 to f3) beside fp, and
    edges are between nodes; else between fingerprints.
    """
    names = ["bucket", "fp"] if apart is None else ["bucket", "fp", "node", "f0", "f1", "f2", "f3"]

    def search(cols: list[np.ndarray]) -> pa.RecordBatch:
        index = GrayIndex(cols[0], cols[1].view(np.uint64))
        node = cols[1] if apart is None else cols[2]
        to = index.classes(radius) if apart is None else index.classes(radius, np.stack(cols[3:], axis=1).view(np.uint64), apart)
        m = np.flatnonzero(to != np.arange(len(to)))
        x, y = node[m], node[to[m]]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["u", "v"])

    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        held.append([batch.column(n).to_numpy() for n in names])
        rows += batch.num_rows
        if rows < CHUNK_ROWS:
            continue
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last bucket may go on
        if cut:
            yield search([c[:cut] for c in cols])
        held, rows = [[c[cut:] for c in cols]], len(cols[0]) - cut
    if rows:
        yield search([np.concatenate(x) for x in zip(*held, strict=True)])


def _deal(rows: DataFrame, radius: int, bits: int, hot: int) -> DataFrame:
    """``rows`` (fp and others, perhaps a ``part`` that keeps rows apart) with a bucket number.

    Two fingerprints of ``bits`` bits within ``radius`` meet in at least one bucket. A bucket
    of more than ``hot`` rows is dealt again by blocks of its other bits, so that no bucket
    needs to be held by one task; nothing is dropped.
    """
    n, keep = radius + 1, rows.columns
    cuts = [bits * i // n for i in range(n + 1)]
    width = max(b - a for a, b in zip(cuts, cuts[1:], strict=False))
    part = F.col("part").cast("long") if "part" in keep else F.lit(0).cast("long")

    def key(k: int):
        value = F.shiftrightunsigned("fp", cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1))
        return (part * n + k) * (1 << width) + value

    keyed = rows.select(*keep, F.explode(F.array(*[key(k) for k in range(n)])).alias("bucket"))
    # at most parts * n * 2**width keys, and no more than rows / hot
    large = [r[0] for r in keyed.groupBy("bucket").count().filter(F.col("count") > hot).select("bucket").collect()]
    if not large:
        return keyed
    flags = F.broadcast(rows.sparkSession.createDataFrame([(x, True) for x in large], "bucket long, large boolean"))
    keyed = keyed.join(flags, "bucket", "left")
    out = keyed.filter(F.col("large").isNull()).select(*keep, "bucket")
    for k in range(n):  # buckets of block k are split by blocks of the bits around it
        rest = [i for i in range(bits) if not cuts[k] <= i < cuts[k + 1]]
        step = [len(rest) * j // n for j in range(n + 1)]
        keys = []
        for j in range(n):
            mask = sum(1 << i for i in rest[step[j] : step[j + 1]])
            mask -= (mask >> 63) << 64
            keys.append(F.xxhash64(F.col("bucket"), F.lit(j), F.col("fp").bitwiseAND(F.lit(mask))))
        mine = keyed.filter(F.col("large") & (F.shiftright("bucket", width) % n == k))
        out = out.unionByName(mine.select(*keep, F.explode(F.array(*keys)).alias("bucket")))
    return out


def near_edges(reps: DataFrame, radius: int = 3, hot: int = HOT_BUCKET) -> DataFrame:
    """Edges (u > v) that connect all distinct fingerprints ``fp`` within ``radius`` bits."""
    dealt = _deal(reps.select("fp"), radius, 64, hot).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(partial(_bucket_edges, radius=radius), "u long, v long").distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root): for each node of ``edges`` (u, v) the smallest node that it reaches.

    Alternating large-star and small-star steps; each round is written to the shared
    folder. A node with very many neighbours is joined on the side that AQE can split.
    """
    e = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    stamp = None
    for _ in range(max_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == stamp or now[0] == 0:
            break
        stamp = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = materialize(small.select("x.u", "x.v").filter("u <> v").distinct(), "edges")
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def fingerprint_classes(fps: DataFrame, radius: int = 3, hot: int = HOT_BUCKET) -> DataFrame:
    """(fp, component_id): the smallest doc_id reachable over links of at most ``radius`` bits.

    ``fps`` (doc_id, fp) is read more than once and should be a table. Rows with equal
    fingerprints are one node. Null doc_ids take part as links but never name a class,
    unless it has no other.
    """
    reps = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    comp = materialize(components(near_edges(reps.select("fp"), radius, hot)), "classes")
    # a root is no child of any edge: give it a row of its own
    member = comp.unionByName(comp.select(F.col("root").alias("node"), "root").distinct())
    named = member.join(reps, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("rep").alias("least"))
    linked = member.join(named, "root").select(F.col("node").alias("fp"), "least")
    return reps.join(linked, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))


def simhash_classes(docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = SEED, hot: int = HOT_BUCKET) -> DataFrame:
    """(doc_id, fp long, component_id) for every row of ``docs`` (doc_id, text, any others).

    Null and empty texts, and texts of white space only, have fingerprint 0 and are linked
    like any other. Repeated rows each keep their row. An empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, shingle, seed), "fps")
    return fps.join(fingerprint_classes(fps, radius, hot), "fp", "left").select("doc_id", "fp", "component_id")


#: Seeds of a wide fingerprint's four words; bits in which candidates may differ. At 5-word
#: shingle similarity 0.8 about 39 of 256 differ, give or take 6; unrelated texts differ in 128.
WIDE_SEEDS, WIDE_APART = (42, 43, 44, 45), 80
#: Bits in which the first of its words may differ for texts to meet in pigeonhole buckets.
FIRST_APART = 3
#: Candidates share the least hashes of one of so many groups of so many orders.
BANDS, ROWS = 20, 3
_ORDERS = np.random.default_rng(SEED).integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A bucket with more pairs a row than this first links each row to the nearest one before it only.
DENSE = 3
#: Texts of a group that are compared together; shingles held at once in a comparison.
CELL, COLUMNS = 2048, 4096


def _shingles(data: bytes | None, shingle: int) -> np.ndarray:
    """Hashes of the word shingles of a text, words and shingles as for ``fingerprint``."""
    words = data.lower().split() if data else []
    if not words:
        return np.zeros(0, np.uint64)
    rows = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), rows), np.uint64)


def _elements(h: np.ndarray) -> np.ndarray:
    """A hash of each shingle and the number of its use, sorted, so that repeats are told apart."""
    h = np.sort(h)
    at = np.arange(len(h))
    use = at - np.maximum.accumulate(np.where(np.r_[True, h[1:] != h[:-1]], at, 0)) if len(h) else at
    x = (h ^ (use.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return np.sort(x ^ (x >> np.uint64(32)))


def _band_keys(e: np.ndarray) -> list[int]:
    if not len(e):
        return [0] * BANDS
    least = np.empty((BANDS, ROWS), np.uint64)
    for k in range(BANDS):
        for j in range(ROWS):
            least[k, j] = (e * _ORDERS[k, j]).min()
    return [xxhash.xxh64_intdigest(row.tobytes(), seed=k) for k, row in enumerate(least)]


def _wide_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, nodes, sizes, keys = [], [], [], []
        for t in batch.column("text").cast(pa.large_binary()).to_pylist():
            h = _shingles(t, shingle)
            e = _elements(h)
            prints.append(_wide(h))
            nodes.append(xxhash.xxh64_intdigest(e.tobytes(), seed=SEED))
            sizes.append(len(e))
            keys.append(_band_keys(e))
        f = np.array(prints, np.uint64).reshape(-1, 4).view(np.int64)
        k = pa.array(np.array(keys, np.uint64).reshape(-1).view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(k) + 1, BANDS, dtype=np.int32)), k)
        arrays = [batch.column("d"), batch.column("c"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), *(pa.array(f[:, i].copy()) for i in range(4)), lists]
        yield pa.RecordBatch.from_arrays(arrays, names=["d", "c", "node", "size", "f0", "f1", "f2", "f3", "keys"])


def _wide(h: np.ndarray) -> tuple[int, int, int, int]:
    if not len(h):
        return 0, 0, 0, 0
    ones = np.zeros(256, np.int64)
    for at in range(0, len(h), 16_384):
        part, many = h[at : at + 16_384], []
        for seed in WIDE_SEEDS:
            x = (part ^ (part >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * seed)
            many.append(x ^ (x >> np.uint64(27)))
        ones += np.unpackbits(np.stack(many, axis=1).view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return tuple(np.packbits(2 * ones > len(h), bitorder="little").view("<u8").tolist())


def wide_fingerprint(data: bytes | None, shingle: int) -> tuple[int, int, int, int]:
    """256-bit SimHash: words and shingles as for ``fingerprint``, each hash mixed four ways."""
    return _wide(_shingles(data, shingle))


def _index_pairs(bucket: np.ndarray, size: np.ndarray, wide: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (i, j) of each bucket, found by the index, and whether they are only some of very many.

    Those are a forest: each row with the nearest before it, so that a bucket has fewer pairs
    than rows. Sizes that rule the similarity out are skipped. ``bucket`` numbers come sorted.
    """
    rows = np.bincount(bucket)
    most = np.where(rows > DENSE, DENSE * rows, np.iinfo(np.int64).max)
    total, best = np.zeros(len(rows), np.int64), np.full(len(bucket), np.iinfo(np.int64).max)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i, j, bits in GrayIndex(bucket, wide).pairs(apart):
        ok = 5 * np.minimum(size[i], size[j]) >= 4 * np.maximum(size[i], size[j])
        i, j, bits = np.maximum(i, j)[ok], np.minimum(i, j)[ok], bits[ok]
        np.minimum.at(best, i, (bits.astype(np.int64) << 32) + j)
        few = (total <= most)[bucket[i]]
        total += np.bincount(bucket[i], minlength=len(rows))
        found.append((i[few], j[few]))
    dense = total > most
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    few = ~dense[bucket[i]]
    near = np.flatnonzero(dense[bucket] & (best < np.iinfo(np.int64).max))
    i, j = np.r_[i[few], near], np.r_[j[few], best[near] & 0xFFFFFFFF]
    return i, j, dense[bucket[i]]


def _bucket_pairs(node: np.ndarray, size: np.ndarray, wide: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The pairs of one bucket."""
    i, j, dense = _index_pairs(np.zeros(len(node), np.int64), size, wide, apart)
    return node[i], node[j], bool(dense.any())


def _by_key(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Tables of about so many rows that hold whole keys; rows come sorted by key."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held, count = table.slice(cut).to_batches(), len(keys) - cut
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def _pair_batches(batches: Iterator[pa.RecordBatch], apart: int) -> Iterator[pa.RecordBatch]:
    """(bucket, u, v, dense) of each bucket; rows come sorted by bucket."""
    for table in _by_key(batches, "bucket", CHUNK_ROWS):
        bucket, node, size, *wide = (table.column(n).to_numpy() for n in ("bucket", "node", "size", "f0", "f1", "f2", "f3"))
        wide = np.stack(wide, axis=1).view(np.uint64)
        new = np.r_[True, bucket[1:] != bucket[:-1]]
        several = np.flatnonzero(~new | ~np.r_[new[1:], True])
        if not len(several):
            continue
        i, j, dense = _index_pairs(np.cumsum(new[several]) - 1, size[several], wide[several], apart)
        i, j = several[i], several[j]
        for lo in range(0, len(i), CHUNK_ROWS):
            a, b = i[lo : lo + CHUNK_ROWS], j[lo : lo + CHUNK_ROWS]
            arrays = [bucket[a], np.maximum(node[a], node[b]), np.minimum(node[a], node[b]), dense[lo : lo + CHUNK_ROWS]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["bucket", "u", "v", "dense"])


def cell_links(size: np.ndarray, elements: np.ndarray, comp: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the classes ``comp`` of texts with similarity of 0.8 or more: a spanning forest.

    ``elements``: those of all texts, one after the other, so many as ``size`` says. Where the
    texts are of two chunks, only pairs across them are looked at.
    """
    n = len(size)
    _, dim, many = np.unique(elements, return_inverse=True, return_counts=True)
    shared = many > 1  # what one text alone holds is in no intersection
    owner, dim = np.repeat(np.arange(n), size)[shared[dim]], (np.cumsum(shared) - 1)[dim[shared[dim]]]
    order = np.argsort(dim, kind="stable")
    owner, dim = owner[order], dim[order]
    common = np.zeros((n, n), np.float32)
    for lo in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(dim, [lo, lo + COLUMNS])
        m = np.zeros((n, min(COLUMNS, int(dim[-1]) + 1 - lo)), np.float32)
        m[owner[a:b], dim[a:b] - lo] = 1
        common += m @ m.T
    name, label = np.unique(comp, return_inverse=True)
    root = np.arange(len(name))
    both = chunk.min(initial=0) != chunk.max(initial=0)
    for lo in range(0, n, 256):
        hi = min(n, lo + 256)
        c = common[lo:hi]
        ok = (5 * c >= 4 * (size[lo:hi, None] + size - c)) & (label[lo:hi, None] != label)
        if both:
            ok &= chunk[lo:hi, None] != chunk
        i, j = np.nonzero(ok)
        root = _merge(root, label[lo + i], label[j])
    moved = np.flatnonzero(root != np.arange(len(root)))
    return name[moved], name[root[moved]]


def _cell_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) of each cell's links; rows come sorted by cell."""
    for table in _by_key(batches, "cell", 1):
        cell, comp, chunk = (table.column(n).to_numpy() for n in ("cell", "comp", "chunk"))
        lists = table.column("elements").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        edge = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
        for a, b in zip(edge, edge[1:], strict=False):
            u, v = cell_links(np.diff(at[a : b + 1]), flat[at[a] - at[0] : at[b] - at[0]], comp[a:b], chunk[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])


def _element_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            e = [_elements(_shingles(t.as_py(), shingle)) for t in part.column("text").cast(pa.large_binary())]
            at = np.cumsum([0, *map(len, e)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(e).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("node"), lists], names=["node", "elements"])


def one_of_each(docs: DataFrame, shingle: int = 5, apart: int = WIDE_APART, hot: int = HOT_BUCKET, cell: int = CELL) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others), one for each near-duplicate class.

    Two texts are linked if the weighted Jaccard similarity of their word shingles is 0.8
    or more; it is worked out on the shingles of all candidates. Candidates differ in at most
    ``apart`` bits of their 256-bit SimHash and meet in one of ``BANDS`` buckets, keyed by the
    least hashes of their shingles in ``ROWS`` orders: a pair at 0.8 meets in none about once
    in 1.7 million, a closer one more rarely. Pairs whose first words differ in ``FIRST_APART`` bits
    at most meet surely, in pigeonhole buckets as in ``near_edges``. Buckets of both kinds are searched
    by the Gray-order index. Where a bucket has very many candidates, each
    text is linked to the nearest before it at first. What then is in different classes yet is compared, text
    by text, in cells of at most two times ``cell`` texts, which give a spanning forest.

    The row of smallest doc_id stays (null last, then by a hash of the row); of equal rows one.
    Null and empty texts are one class.
    """
    row = F.xxhash64(*[F.col(f"`{n}`") for n in docs.columns])
    own = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").cast("long").alias("d"), row.alias("c"))
    base = docs.select(F.col("doc_id").cast("long").alias("d"), row.alias("c"), "text")
    f = ["f0", "f1", "f2", "f3"]
    wide = materialize(base.mapInArrow(partial(_wide_batches, shingle=shingle), "d long, c long, node long, size long, f0 long, f1 long, f2 long, f3 long, keys array<long>"), "wide")
    firsts = F.min(F.struct(F.col("d").isNull().alias("z"), "d", "c")).alias("first")
    reps = materialize(wide.groupBy("node").agg(firsts, *[F.min(x).alias(x) for x in ("size", *f, "keys")]), "reps")
    dealt = reps.select("node", "size", *f, "keys", F.explode("keys").alias("bucket"))
    large = [r[0] for r in reps.select(F.explode("keys").alias("bucket")).groupBy("bucket").count().filter(F.col("count") > hot).select("bucket").collect()]
    if large:  # split by a second key, in which a similar pair meets as surely as in the first
        flags = F.broadcast(docs.sparkSession.createDataFrame([(x, True) for x in large], "bucket long, large boolean"))
        marked = dealt.join(flags, "bucket", "left").withColumn("second", F.explode(F.when(F.col("large"), F.col("keys")).otherwise(F.array(F.lit(0).cast("long")))))
        dealt = marked.withColumn("bucket", F.when(F.col("large"), F.xxhash64("bucket", "second")).otherwise(F.col("bucket")))
    dealt = dealt.select("bucket", "node", "size", *f)

    def elements(nodes: DataFrame) -> DataFrame:
        """(node, elements) of distinct ``nodes``."""
        named = nodes.join(reps.select("node", "first.d", "first.c"), "node")
        held = base.alias("t").join(named.alias("n").hint("shuffle_hash"), F.col("n.d").eqNullSafe(F.col("t.d")) & (F.col("n.c") == F.col("t.c"))).select("node", "text").dropDuplicates(["node"])
        return materialize(held.mapInArrow(partial(_element_batches, shingle=shingle), "node long, elements array<long>"), "held")

    inside = dealt.repartition("bucket").sortWithinPartitions("bucket", "node")  # rows of two buckets in one order give the same pairs
    pairs = materialize(inside.mapInArrow(partial(_pair_batches, apart=apart), "bucket long, u long, v long, dense boolean"), "pairs")
    # first words of few different bits meet in pigeonhole buckets as well, surely, as in op1
    blocks = _deal(reps.select("node", F.col("f0").alias("fp"), *f), FIRST_APART, 64, hot).repartition("bucket").sortWithinPartitions("bucket")
    close = blocks.mapInArrow(partial(_bucket_edges, radius=FIRST_APART, apart=apart), "u long, v long")
    few = materialize(pairs.select("u", "v", F.lit(False).alias("close")).unionByName(close.withColumn("close", F.lit(True))).groupBy("u", "v").agg(F.max("close").alias("close")), "few")
    held = elements(few.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    both = few.join(held.select(F.col("node").alias("u"), F.col("elements").alias("a")), "u").join(held.select(F.col("node").alias("v"), F.col("elements").alias("b")), "v")
    both = both.withColumn("common", F.size(F.array_intersect("a", "b")))
    links = materialize(both.filter(5 * F.col("common") >= 4 * (F.size("a") + F.size("b") - F.col("common"))).select("u", "v", "close"), "links")
    # classes of what the blocks met, then of these classes by what the other buckets met
    early = materialize(components(links.filter("close").select("u", "v")), "early")
    rest = links.filter("not close").select("u", "v")
    for x in ("u", "v"):
        rest = rest.join(early.select(F.col("node").alias(x), F.col("root").alias("to")), x, "left").withColumn(x, F.coalesce("to", x)).drop("to")
    later = materialize(components(rest), "later")
    moved = early.join(later.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    comp = materialize(moved.unionByName(later), "classes")
    dense = pairs.filter("dense").select("bucket").distinct()
    members = materialize(dealt.select("bucket", "node").join(dense, "bucket").join(comp, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("comp")), "members")
    open_ = members.groupBy("bucket").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.min("node").alias("first")).filter("least <> most").select("bucket", "first")
    groups = materialize(members.join(open_, "bucket").select(F.col("node").alias("u"), F.col("first").alias("v"), "comp"), "groups")
    if not groups.isEmpty():  # one group of buckets that share texts, so that each text moves once for each of its cells
        # by the buckets' first texts: a text's buckets are joined through the least of them, so few edges are left
        texts = materialize(groups.groupBy("u", "comp").agg(F.min("v").alias("least"), F.collect_set("v").alias("firsts")), "texts")
        joined = components(texts.select(F.explode("firsts").alias("u"), F.col("least").alias("v"))).withColumnRenamed("node", "least")
        texts = texts.join(joined, "least", "left").select(F.col("u").alias("node"), "comp", F.coalesce("root", "least").alias("group"))
        many = texts.groupBy("group").agg(F.ceil(F.count("*") / F.lit(cell)).alias("parts"))
        chunk = texts.join(many, "group").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("parts")))
        cells = chunk.select("node", "comp", "chunk", "group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        cells = cells.select("node", "comp", "chunk", F.xxhash64("group", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("cell"))
        full = cells.join(elements(texts.select("node")), "node").repartition("cell").sortWithinPartitions("cell")
        more = full.select("cell", "comp", "chunk", "elements").mapInArrow(_cell_batches, "u long, v long")
        comp = materialize(components(more.unionByName(comp.select(F.col("node").alias("u"), F.col("root").alias("v")))), "classes")
    stay = reps.join(comp, "node", "left").groupBy(F.coalesce("root", "node").alias("class")).agg(F.min("first").alias("first")).select("first.z", "first.d", "first.c")
    marked = docs.select(F.struct("*").alias("doc"), own.alias("own"))
    kept = marked.join(stay.hint("shuffle_hash"), (F.col("own.d").eqNullSafe(F.col("d"))) & (F.col("own.c") == F.col("c")), "left_semi")
    return kept.dropDuplicates(["own"]).select("doc.*")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of ``documents`` at 3-word shingles and 3 bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = simhash_classes(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
