"""Jaccard join of word n-gram sets, size-aware: subsets of small sets, inverted lists of large ones.

A document is the set of its distinct 5-word shingles, as 64-bit hashes. Two sets of s and t
elements link at a similarity of 0.8 or more, that is at ceil(4 (s + t) / 9) common elements.
Equal sets are one node, so copies cost one row each and no pairs.

* Light sets: all subsets of c elements are enumerated, for each c that a partner may ask for.
  Whoever holds a subset shares its c elements, so that a group of one subset needs no
  comparison: its smallest set links to each other one whose size allows it, and this star
  connects all that the group's pairs would.
* Heavy sets: elements are put in an order fixed for all, frequent ones last (by a sketch of
  fixed size that counts every document). Two similar sets share one of the first fifth of
  their elements, so only these have inverted lists. A list is scanned against the least of its nodes
  first (in each batch of documents, then of all); then, in lists that hold several classes yet, what is not of the list's largest class is
  compared with all others of that list. Each pair must pass a parity sketch (its differing bits never
  outnumber the elements that differ) before elements are compared; that decides.
* The boundary is the size at which enumerating subsets costs more rows than scanning lists.
  It is chosen from the sizes of all sets.

A comparison within one class changes nothing and is left out; no other is. Hashes of 64 bits
stand for shingles and for sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .simhash import _by_key, _merge, components

SHINGLE = 5
#: Slots of the sketch of frequencies (a power of two), least words of 64 parity bits.
SLOT_BITS, WORDS = 18, 8
#: Largest size at which subsets are thought of at all; rows that one element in a list costs, against one of a subset.
LIGHT_MOST, SCAN = 24, 6
#: Lists up to this length are compared by a join, longer ones in cells; texts and elements in a chunk, two chunks a cell.
LIST, CHUNK, CHUNK_ELEMENTS = 32, 4096, 2_000_000
#: Texts asked for by name up to which the names are sent to all tasks; beyond, all texts are dealt by name.
NAMED = 1_000_000
#: Bytes of texts whose words are hashed together; bytes of a word that is hashed with others.
PART, WORD = 1 << 20, 64
_FACTORS = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(64)]
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: Masks of an eight's first bytes, by their number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``data``, runs without ASCII white space, and where they begin; all at once.

    A word is read by eights of bytes, the last one cut to its length. Words of more than ``WORD``
    bytes are hashed one by one.
    """
    raw = np.frombuffer(b" " + data + b" " * 8, np.uint8)
    space = _SPACE.take(raw)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, n = edge[::2], np.diff(edge)[::2]
    eights = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    h = n.astype(np.uint64) * np.uint64(_FACTORS[20])
    h ^= eights[start] & _FIRST.take(np.minimum(n, 8))
    _stir(h)
    longer, k = np.flatnonzero((n > 8) & (n <= WORD)), 8
    while len(longer):
        left = n[longer] - k
        x = h[longer] ^ (eights[start[longer] + k] & _FIRST.take(np.minimum(left, 8)))
        _stir(x)
        h[longer] = x
        longer, k = longer[left > 8], k + 8
    for i in np.flatnonzero(n > WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(raw[start[i] : start[i] + n[i]], seed=7)
    return h, start - 1


def _stir(h: np.ndarray) -> None:
    """Mixes 64-bit values in place."""
    for factor, shift in ((_FACTORS[21], 32), (_FACTORS[22], 29)):
        h *= np.uint64(factor)
        h ^= h >> np.uint64(shift)


def elements_of(texts: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted hashes of the distinct word shingles of each text; about ``PART`` bytes are hashed together.

    A-Z are lower-cased; words are runs without ASCII white space. Fewer words than ``shingle``
    are one shingle of them all; null and texts without words have none.
    """
    held: list[bytes] = []
    size = 0
    for text in texts.cast(pa.large_binary()):
        held.append(text.as_py() or b"")
        size += len(held[-1])
        if size >= PART:
            yield from _elements(held, shingle)
            held, size = [], 0
    yield from _elements(held, shingle)


def _elements(texts: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    h, start = word_hashes(b" ".join(texts).lower())
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    edge = np.searchsorted(start, begin).tolist()

    def shingles(h: np.ndarray, width: int) -> np.ndarray:
        x = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            x += h[k : k + len(x)] * np.uint64(_FACTORS[k])
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return x

    whole = shingles(h, shingle) if len(h) >= shingle else h[:0]
    for a, b in zip(edge, edge[1:], strict=False):
        e = whole[a : b - shingle + 1].copy() if b - a >= shingle else shingles(h[a:b], b - a) if b > a else h[:0]
        e.sort()
        yield e[np.r_[True, e[1:] != e[:-1]]] if len(e) > 1 else e


def needed(s, t):
    """Common elements at which sets of s and t link; numbers or arrays."""
    return (4 * (s + t) + 8) // 9


def _slot(e: np.ndarray) -> np.ndarray:
    return (e >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _sketch_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    total, width = np.zeros(1 << SLOT_BITS, np.int64), 4096
    for batch in batches:
        slots, held = [], 0
        for e in elements_of(batch.column("text"), shingle):
            slots.append(_slot(e))
            held += len(slots[-1])
            if held > 500_000:
                total += np.bincount(np.concatenate(slots), minlength=len(total))
                slots, held = [], 0
        if slots:
            total += np.bincount(np.concatenate(slots), minlength=len(total))
    rows = total.reshape(-1, width)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(list(rows), pa.list_(pa.int64()))], names=["block", "counts"])


def frequency_order(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """For each slot of a shingle's hash, the bit length of how many documents hold one of its shingles; a fixed size."""
    parts = docs.select("text").mapInArrow(partial(_sketch_batches, shingle=shingle), "block long, counts array<long>")
    summed = parts.select("block", F.posexplode("counts").alias("at", "n")).groupBy((F.col("block") * 4096 + F.col("at")).alias("slot")).agg(F.sum("n").alias("n"))
    order = np.zeros(1 << SLOT_BITS, np.uint8)
    for row in summed.select("slot", F.ceil(F.log2(F.col("n") + 1)).alias("b")).toArrow().to_batches():
        order[row.column("slot").to_numpy()] = row.column("b").to_numpy()
    return order


def _parity(e: np.ndarray) -> np.ndarray:
    """Parities of how many elements fall on each of 512 bits or, of larger sets, a power of two above their size."""
    bits = 64 * WORDS << (len(e) // (64 * WORDS)).bit_length()
    odd = np.bincount((e * np.uint64(_FACTORS[9]) >> np.uint64(32)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Parities over fewer bits."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words))


_SETS = "doc_id long, c long, node long, size long, head array<long>, bits array<long>, few array<long>"


def _set_batches(batches: Iterator[pa.RecordBatch], shingle: int, order: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, size, heads, bits, few = [], [], [], [], []
        for e in elements_of(batch.column("text"), shingle):
            node.append(xxhash.xxh64_intdigest(e.tobytes(), seed=1))
            size.append(len(e))
            rank = (order[_slot(e)].astype(np.uint64) << np.uint64(57)) | (e >> np.uint64(7))
            first = np.argpartition(rank, len(e) // 5)[: len(e) // 5 + 1] if len(e) else slice(0)
            heads.append(e[first].view(np.int64))
            bits.append(_parity(e))
            few.append(e.view(np.int64) if len(e) <= LIGHT_MOST else None)
        longs = pa.list_(pa.int64())
        at = np.cumsum([0, *map(len, heads)], dtype=np.int32)
        head = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(heads or [np.zeros(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("c"), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int64()), head, pa.array(bits, longs), pa.array(few, longs)], names=["doc_id", "c", "node", "size", "head", "bits", "few"])


def subsets_of(size: int) -> int:
    """How many subsets are enumerated of a set of so many elements."""
    return sum(comb(size, c) for c in range((4 * size + 4) // 5, size + 1))


def boundary(sizes: dict[int, int]) -> int:
    """The size up to which sets are light, by the rows that either way costs; ``sizes``: how many sets have each size."""
    best, cost, least = 0, 0, 0
    for s in range(1, LIGHT_MOST + 1):
        cost += sizes.get(s, 0) * (subsets_of(s) - SCAN * (s // 5 + 1))
        if cost <= least:
            best, least = s, cost
    return best


def _subset_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, check, c) of each subset that a partner of the set may share with it; sums of mixed hashes name a subset."""
    mix = [np.uint64(f) for f in _FACTORS[10:12]]
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            out: list[list[np.ndarray]] = []
            for node, values in zip(part.column("node").to_pylist(), part.column("few").to_pylist(), strict=True):
                e = np.array(values, np.int64).view(np.uint64)
                s = len(e)
                mixed = [(x := e * m) ^ (x >> np.uint64(32)) for m in mix]
                for gone in range(s // 5 + 1):
                    drop = np.array(list(combinations(range(s), gone)), np.int64).reshape(comb(s, gone), gone)
                    sums = [(m.sum(dtype=np.uint64) - m[drop].sum(axis=1, dtype=np.uint64)).view(np.int64) for m in mixed]
                    k = len(drop)
                    out.append([*sums, np.full(k, s - gone), np.full(k, node), np.full(k, s)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["key", "check", "c", "node", "size"])


def light_links(small: DataFrame) -> DataFrame:
    """(u, v): stars in the groups of one subset of ``small`` (node, few); links between all of its similar sets."""
    rows = materialize(small.select("node", "few").mapInArrow(_subset_batches, "key long, check long, c long, node long, size long"), "subsets")
    first = rows.groupBy("key", "check", "c").agg(F.min(F.struct("size", "node")).alias("first"), F.count("*").alias("k")).filter("k > 1").drop("k")
    met = rows.join(first, ["key", "check", "c"]).filter((F.col("node") != F.col("first.node")) & (4 * (F.col("size") + F.col("first.size")) <= 9 * F.col("c")))
    return met.select(F.col("node").alias("u"), F.col("first.node").alias("v")).distinct()


def _head_batches(batches: Iterator[pa.RecordBatch], least_only: bool) -> Iterator[pa.RecordBatch]:
    """(token, node, pivot) of the nodes of each token in a batch: the least one, or all others; pivot is the least."""
    for batch in batches:
        lists = pa.concat_arrays([batch.column("head")])
        token = lists.flatten().to_numpy()
        node = np.repeat(batch.column("node").to_numpy(), np.diff(lists.offsets.to_numpy()))
        order = np.lexsort((node, token))
        token, node = token[order], node[order]
        new = np.r_[True, token[1:] != token[:-1]] if len(token) else np.zeros(0, bool)
        once = new | np.r_[True, node[1:] != node[:-1]] if len(token) else new
        least = node[np.maximum.accumulate(np.where(new, np.arange(len(node)), 0))] if len(node) else node
        keep = new if least_only else once & ~new
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, node, least)], names=["token", "node", "pivot"])


def _list_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, node, pivot) of all but the least node of each token; rows come sorted by token and node."""
    last_token, last_node, least = None, None, None
    for batch in batches:
        token, node = batch.column("token").to_numpy(), batch.column("node").to_numpy()
        if not len(token):
            continue
        new, other = np.r_[token[0] != last_token, token[1:] != token[:-1]], np.r_[node[0] != last_node, node[1:] != node[:-1]]
        at = np.maximum.accumulate(np.where(new, np.arange(len(token)), -1))
        pivot = np.where(at >= 0, node[np.maximum(at, 0)], least if least is not None else 0)
        last_token, last_node, least = token[-1], node[-1], pivot[-1]
        keep = ~new & other
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, node, pivot)], names=["token", "node", "pivot"])


def _element_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            e = list(elements_of(batch.column("text").slice(lo, 1000), shingle))
            node = np.array([xxhash.xxh64_intdigest(x.tobytes(), seed=1) for x in e], np.uint64).view(np.int64)
            at = np.cumsum([0, *map(len, e)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("c").slice(lo, 1000), pa.array(node), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(e).view(np.int64)))], names=["c", "node", "elements"])


def cell_links(node: np.ndarray, comp: np.ndarray, size: np.ndarray, bits: list[np.ndarray], minor: np.ndarray, lists: list[np.ndarray] | None) -> list[tuple[int, int]]:
    """A spanning forest, over the classes ``comp``, of the links between a minor text and any other of a cell.

    Without ``lists``, the texts' elements: a forest over the nodes of what size and parities leave as possible
    links between different classes.
    """
    name, label = np.unique(comp, return_inverse=True)
    root, out = np.arange(len(name)), []
    near = np.arange(len(node))
    words = np.array([len(b) for b in bits])
    lesser = np.isin(near, minor)
    by = {n: f[np.argsort(~lesser[f], kind="stable")] for n in np.unique(words).tolist() for f in [np.flatnonzero(words == n)]}  # minor texts first
    for n, m in ((n, m) for n in by for m in (n // 2, n, 2 * n) if m in by):  # sizes that may link
        few = min(n, m)
        mine = by[n][lesser[by[n]]]
        # a pair of two minor texts is met once: of two sizes from the smaller one, of one size from the first
        others = by[m] if m >= n else by[m][~lesser[by[m]]]
        if not len(mine) or not len(others):
            continue
        bit = np.stack([_folded(bits[j], few) for j in others])
        for lo in range(0, len(mine), 256):
            q, at = mine[lo : lo + 256], lo if m == n else 0
            own = np.stack([_folded(bits[i], few) for i in q])
            apart = np.zeros((len(q), len(others) - at), np.int32)
            for k in range(few):
                apart += np.bitwise_count(own[:, k][:, None] ^ bit[None, at:, k])
            rest = others[at:]
            s, t = size[q][:, None], size[rest]
            # differing bits are odd if s + t is, so that this is apart <= s + t - 2 * needed(s, t)
            ok = (9 * apart <= s + t) & (root[label[q]][:, None] != root[label[rest]]) & (5 * np.minimum(s, t) >= 4 * np.maximum(s, t))
            if lists is None:
                i, j = np.nonzero(ok)
                near = _merge(near, q[i], rest[j])
                continue
            for i, j in zip(*(x.tolist() for x in np.nonzero(ok)), strict=True):
                i, j = q[i], rest[j]
                a, b = root[label[i]], root[label[j]]
                if a != b and len(np.intersect1d(lists[i], lists[j], assume_unique=True)) >= needed(size[i], size[j]):
                    out.append((int(name[label[i]]), int(name[label[j]])))
                    root = _merge(root, np.array([a]), np.array([b]))
    moved = np.flatnonzero(near != np.arange(len(near)))
    return out + list(zip(node[moved].tolist(), node[near[moved]].tolist(), strict=True))


def _cell_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _by_key(batches, "cell", 1):
        cell, node, comp, size, side = (table.column(n).to_numpy() for n in ("cell", "node", "comp", "size", "minor"))
        bits = [np.array(x.values) for x in table.column("bits")]
        lists = [np.array(x.values) for x in table.column("elements")] if "elements" in table.column_names else None
        edge = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
        for a, b in zip(edge, edge[1:], strict=False):
            found = cell_links(node[a:b], comp[a:b], size[a:b], [x.view(np.uint64) for x in bits[a:b]], np.flatnonzero(side[a:b]), lists and lists[a:b])
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["u", "v"])


def _may_link(s: str, t: str, a: str, b: str) -> Column:
    """Whether sizes and parity bits of two sets allow a link."""
    size, other = F.col(s), F.col(t)
    # sizes that may link have equal numbers of bits, or one twice the other's
    n = F.least(F.size(a), F.size(b))
    fold = lambda x: F.when(F.size(x) > n, F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(x))
    differ = F.aggregate(F.zip_with(fold(a), fold(b), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda x, y: x + y)
    common = F.floor((4 * (size + other) + 8) / 9)
    return (5 * F.least(size, other) >= 4 * F.greatest(size, other)) & (differ <= size + other - 2 * common)


def heavy_links(reps: DataFrame, texts: DataFrame, heads: DataFrame, links: DataFrame, shingle: int = SHINGLE, most: int = LIST, chunk: int = CHUNK, repeated: bool = True) -> DataFrame:
    """(node, root) over all links: ``links`` (u, v), and those of the lists of ``heads`` (node, head: its listed elements).

    ``reps``: (node, c, size, bits) of each set; ``texts``: (c, text) of each row. All are written tables.
    ``repeated``: whether rows of ``texts`` may be equal in c.
    """
    # a frequent token leaves one row of a batch, so that none is much for the task that its rows meet in
    ddl = "token long, node long, pivot long"
    firsts = heads.mapInArrow(partial(_head_batches, least_only=True), ddl).select("token", "node").repartition("token").sortWithinPartitions("token", "node")
    lists = materialize(firsts.mapInArrow(_list_batches, ddl).unionByName(heads.mapInArrow(partial(_head_batches, least_only=False), ddl)), "lists")
    part = reps.select("node", "size", "bits")
    side = lambda x, y: part.select(F.col("node").alias(x), F.col("size").alias(f"s{y}"), F.col("bits").alias(f"b{y}"))
    sieve = lambda pairs: pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").filter(_may_link("sa", "sb", "ba", "bb"))

    def held(nodes: DataFrame) -> DataFrame:
        """(node, elements) of ``nodes``."""
        named = materialize(nodes.distinct().join(reps.select("node", "c"), "node").select("c"), "named")
        few = F.broadcast(named) if named.count() <= NAMED else named.hint("shuffle_hash")
        found = texts.join(few, "c", "left_semi").mapInArrow(partial(_element_batches, shingle=shingle), "c long, node long, elements array<long>")
        if repeated:
            found = found.dropDuplicates(["node"])
        return materialize(found.select("node", "elements"), "held")

    def similar(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) whose elements are similar."""
        own = held(pairs.select(F.explode(F.array("u", "v")).alias("node")))
        both = pairs.select("u", "v").join(own.select(F.col("node").alias("u"), F.col("elements").alias("a")), "u").join(own.select(F.col("node").alias("v"), F.col("elements").alias("b")), "v")
        return both.filter(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v")

    def classes(edges: DataFrame) -> DataFrame:
        return materialize(components(edges), "classes")

    def of(nodes: DataFrame, comp: DataFrame, name: str, to: str) -> DataFrame:
        return nodes.join(comp.select(F.col("node").alias(name), F.col("root").alias(to)), name, "left").withColumn(to, F.coalesce(to, name))

    # each node and the pivots of its lists, those first that share most lists with it
    pairs = lists.groupBy(F.col("node").alias("u"), F.col("pivot").alias("v")).agg(F.count("*").alias("k"))
    near = materialize(sieve(pairs).select("u", "v", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("k"), "v")).alias("rank")), "near")
    found = links.unionByName(similar(near.filter("rank = 1")))
    comp = classes(found)
    tie = lambda c: c.select(F.col("node").alias("u"), F.col("root").alias("v"))

    def in_cells(edges: DataFrame, comp: DataFrame) -> DataFrame:
        """``comp`` with the links between all nodes that ``edges`` (u, v) connect; a text moves once for each of its cells."""
        group = classes(edges)
        nodes = group.select("node").unionByName(group.select(F.col("root").alias("node"))).distinct()
        whole = of(of(nodes, group, "node", "group"), comp, "node", "comp").join(reps.select("node", "size"), "node")
        cells = materialize(dealt_out(whole, 1), "cells")
        full = cells.join(part, "node").join(held(cells.select("node")), "node").repartition("cell").sortWithinPartitions("cell")
        return classes(tie(comp).unionByName(full.mapInArrow(_cell_batches, "u long, v long")))

    def possible(lists: DataFrame) -> DataFrame:
        """(u, v): a forest of the possible links between the nodes of each list of ``lists`` (group, node, comp); only parities move.

        Lists stay apart: those that common passages chain to each other would be one group of very many texts.
        """
        cells = dealt_out(lists.join(reps.select("node", "size"), "node"), 8)
        full = cells.join(part, "node").repartition("cell").sortWithinPartitions("cell")
        return materialize(full.mapInArrow(_cell_batches, "u long, v long").distinct(), "possible")

    def dealt_out(nodes: DataFrame, slim: int) -> DataFrame:
        """(cell, node, comp, minor): ``nodes`` (group, node, comp, size), each in all cells that compare it; ``slim``: so many times the elements in a chunk."""
        whole = materialize(nodes, "grouped")
        counted = whole.groupBy("group", "comp").agg(F.count("*").alias("k"), F.sum("size").alias("e"))
        largest = counted.groupBy("group").agg(F.max_by("comp", F.struct("k", "comp")).alias("top"))
        parts = counted.join(largest, "group").withColumn("minor", F.col("comp") != F.col("top")).groupBy("group", "minor").agg(F.ceil(F.greatest(F.sum("k") / chunk, F.sum("e") / (CHUNK_ELEMENTS * slim))).alias("n"))
        parts = parts.groupBy("group").agg(F.coalesce(F.max(F.when(F.col("minor"), F.col("n"))), F.lit(0)).alias("m"), F.coalesce(F.max(F.when(~F.col("minor"), F.col("n"))), F.lit(0)).alias("n")).filter("m > 0")
        dealt = whole.join(largest, "group").join(parts, "group").withColumn("minor", F.col("comp") != F.col("top"))
        dealt = dealt.withColumn("at", F.when(F.col("minor"), F.pmod(F.xxhash64("node"), "m")).otherwise(F.pmod(F.xxhash64("node"), "n")))
        # a cell is a chunk of minor texts with another one, with itself, or with one of the largest class
        pair = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.cast("long").alias("x"), y.cast("long").alias("y"))
        inner = F.transform(F.sequence(F.lit(0).cast("long"), F.col("m") - 1), lambda j: pair(0, F.least("at", j), F.greatest("at", j)))
        outer = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda j: pair(1, F.col("at"), j))
        across = F.transform(F.sequence(F.lit(0).cast("long"), F.col("m") - 1), lambda i: pair(1, i, F.col("at")))
        cells = dealt.withColumn("cell", F.explode(F.when(F.col("minor"), F.concat(inner, outer)).otherwise(across)))
        return cells.select(F.xxhash64("group", "cell").alias("cell"), "node", "comp", "minor")

    late = of(of(near.filter("rank > 1"), comp, "u", "cu"), comp, "v", "cv").filter("cu <> cv")
    late = materialize(late.select("u", "v"), "late")
    if not late.isEmpty():
        comp = in_cells(late, comp)

    # lists of three or more nodes that hold several classes yet: pairs of short ones, all of long ones
    members = lists.select("token", "node").unionByName(lists.select("token", F.col("pivot").alias("node"))).distinct()
    members = of(members, comp, "node", "comp")
    open_ = members.groupBy("token").agg(F.count("*").alias("k"), F.min("comp").alias("a"), F.max("comp").alias("b"), F.bit_xor(F.xxhash64("node")).alias("nodes")).filter("k > 2 and a <> b")
    open_ = open_.groupBy("k", "nodes").agg(F.min("token").alias("token"))  # lists of the same nodes are one
    members = materialize(members.join(open_.select("token", "k"), "token").select("token", "node", "comp", "k"), "members")
    short = members.filter(F.col("k") <= most).join(part, "node")
    half = lambda x, y: short.select("token", F.col("node").alias(x), F.col("comp").alias(f"c{y}"), F.col("size").alias(f"s{y}"), F.col("bits").alias(f"b{y}"))
    cross = half("u", "a").join(half("v", "b"), "token").filter((F.col("u") < F.col("v")) & (F.col("ca") != F.col("cb")) & _may_link("sa", "sb", "ba", "bb"))
    cross = materialize(cross.select("u", "v").distinct(), "cross")
    wide = members.filter(F.col("k") > most).select(F.col("token").alias("group"), "node", "comp")
    if not wide.isEmpty():  # nodes of long lists have little in common: sieved first
        cross = cross.unionByName(possible(wide))
    return comp if cross.isEmpty() else in_cells(cross, comp)


def jaccard_classes(docs: DataFrame, shingle: int = SHINGLE, most: int = LIST, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text, any others).

    Null texts and texts without words have no shingles, are linked with nothing and keep their own
    doc_id. Rows of equal sets are linked, repeated rows too. A null doc_id takes part as a link
    but never names a class, unless it has no other. An empty table gives no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("c"), "text")
    order = frequency_order(base, shingle)
    sets = materialize(base.mapInArrow(partial(_set_batches, shingle=shingle, order=order), _SETS), "sets")
    some = sets.filter("size > 0")
    reps = materialize(some.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("c").alias("c"), F.min("size").alias("size"), F.min("bits").alias("bits"), F.min("few").alias("few")), "reps")
    light = boundary({r[0]: r[1] for r in reps.filter(F.col("size") <= LIGHT_MOST).groupBy("size").count().collect()})
    links = materialize(light_links(reps.filter(F.col("size") <= light)), "links")
    # whoever may be similar to a heavy set
    heads = some.filter(F.col("size") >= F.lit((4 * (light + 1) + 4) // 5)).select("node", "head")
    repeated = not sets.groupBy("c").count().filter("count > 1").isEmpty()
    comp = heavy_links(reps.select("node", "c", "size", "bits"), base.select("c", "text"), heads, links, shingle, most, chunk, repeated)
    member = comp.unionByName(comp.select(F.col("root").alias("node"), "root").distinct())
    named = member.join(reps.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("least"))
    linked = reps.select("node", F.col("least").alias("own")).join(member.join(named, "root").select("node", "least"), "node", "left").select("node", F.coalesce("least", "own").alias("component_id"))
    out = sets.select("doc_id", "node", "size").join(linked, "node", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op13_ngram_join(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of ``documents`` at 5-word shingles and similarity 0.8."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
with recursive docs as materialized (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda w: w <> '') as ws from documents),
sets as materialized (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [md5(array_to_string(ws, ' '))] else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: md5(array_to_string(list_slice(ws, i, i + 4), ' ')))) end as s from docs),
rows as materialized (select doc_id, len(s) as n, unnest(s) as h from sets),
links as materialized (select a.doc_id as u, b.doc_id as v from rows a join rows b on a.h = b.h and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach as (select doc_id, doc_id as r from sets union select reach.doc_id, links.v from reach join links on links.u = reach.r),
least as (select doc_id, min(r) as component_id from reach group by doc_id)
select doc_id, cast(len(s) as bigint) as n_shingles, component_id from sets join least using (doc_id)
"""
