"""Removal of long word passages that an earlier document already holds.

A relative Lempel-Ziv parse against blocks of all documents. Each document is cut into
reference blocks whose bounds depend on content alone: every window of ``width`` words
picks its smallest 8-word hash as anchor, and the windows with one anchor make a block.
Equal passages pick equal anchors, so a window can only recur in blocks of its own anchor.

* A block whose whole text occurs in an earlier document is a factor as it stands.
* Where blocks of one anchor differ, they are parsed in order of document against an index
  of the blocks before them: from the first word on, the window that begins there is looked
  up; if an earlier document has it, the factor is extended along that reference block as far
  as the two agree, else the parse goes on a word later. A factor has ``width`` words at least.
  After a factor the parse goes on with the windows over its end, so none is missed there.
* Neighbouring factors run together into the longest duplicate spans.

Only blocks that differ send their windows' hashes, so the rows that move are about a
twentieth of the words. Blocks and windows are compared by an anchor hash and a hash of
their own, 128 bits together. An anchor with very many different blocks, more than a task
should index, has its windows joined by hash instead, with the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

WIDTH, ANCHOR = 50, 8
#: Different blocks of one anchor that a task indexes.
INDEXED = 20_000
_A, _B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class WordHashes(dict):
    """XXH64 by word, kept for words seen before; emptied when it has grown large."""

    MOST = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, seed=7)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Rolling:
    """Polynomial hashes modulo 2**64 of runs of word hashes."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up), 4096)
            for name, step in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                a = np.full(n, step, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))

    def sums(self, h: np.ndarray) -> np.ndarray:
        self._powers(len(h) + 1)
        return np.r_[np.uint64(0), np.cumsum(h * self.up[: len(h)])]

    def runs(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64)


def _blocks(batches: Iterator[pa.RecordBatch], width: int, anchor: int) -> Iterator[pa.RecordBatch]:
    words_of, by_anchor, by_text = WordHashes(), Rolling(_A), Rolling(_B)
    for batch in batches:
        parts: list[list[np.ndarray]] = []
        texts = batch.column("text").cast(pa.large_binary())
        for text, d, c in zip(texts, batch.column("d").to_pylist(), batch.column("c").to_pylist(), strict=True):
            words = (text.as_py() or b"").split()
            if d is None or len(words) < width:
                continue
            h = words_of.of(words)
            at = np.arange(len(h) - anchor + 1)
            g = by_anchor.runs(by_anchor.sums(h), at, at + anchor)
            low = np.lib.stride_tricks.sliding_window_view(g, width - anchor + 1).argmin(axis=1) + np.arange(len(h) - width + 1)
            s = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
            e = np.r_[s[1:], len(low)]
            u = by_text.runs(by_text.sums(h), s, e + (width - 1))
            k = len(s)
            parts.append([g[low[s]].view(np.int64), u.view(np.int64), np.full(k, d), np.full(k, c, np.int32), s.astype(np.int32), (e - s).astype(np.int32)])
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["g", "u", "d", "c", "s", "n"])


def _open_blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The blocks in ``parts``, each with the hashes of its windows."""
    words_of, by_text = WordHashes(), Rolling(_B)
    for batch in batches:
        g, u, d, c, starts, sizes, hashes, held = [], [], [], [], [], [], [], 0

        def rows() -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate(hashes).view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(u, pa.int64()), pa.array(d, pa.int64()), pa.array(c, pa.int32()), pa.array(starts, pa.int32()), lists], names=["g", "u", "d", "c", "s", "w"])

        texts = batch.column("text").cast(pa.large_binary())
        for text, doc, code, blocks in zip(texts, batch.column("d").to_pylist(), batch.column("c").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            sums = by_text.sums(words_of.of(text.as_py().split()))
            for b in blocks:
                at = np.arange(b["s"], b["s"] + b["n"])
                g.append(b["g"])
                u.append(b["u"])
                d.append(doc)
                c.append(code)
                starts.append(b["s"])
                sizes.append(b["n"])
                hashes.append(by_text.runs(sums, at, at + width))
                held += b["n"]
            if held > 200_000:
                yield rows()
                g, u, d, c, starts, sizes, hashes, held = [], [], [], [], [], [], [], 0
        if g:
            yield rows()


def parse(windows: list[int], doc: int, index: dict[int, tuple[int, list[int], int]]) -> list[tuple[int, int]]:
    """Greedy factors (first window, windows) of a block against the blocks of earlier documents in ``index``.

    The block's own windows are added to the index: by window the first document, its block, and the place there.
    """
    out, at, n = [], 0, len(windows)
    while at < n:
        ref = index.get(windows[at])
        if ref is None or ref[0] >= doc:
            at += 1
            continue
        _, block, place = ref
        k = 1
        while at + k < n and place + k < len(block) and windows[at + k] == block[place + k]:
            k += 1
        out.append((at, k))
        at += k
    for i, w in enumerate(windows):
        index.setdefault(w, (doc, windows, i))
    return out


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Factors (d, c, s, n) of the blocks; rows come sorted by anchor and document."""
    last, index = None, {}
    for batch in batches:
        out = []
        for g, d, c, s, w in zip(*(batch.column(x).to_pylist() for x in ("g", "d", "c", "s", "w")), strict=True):
            if g != last:
                last, index = g, {}
            out += [(d, c, s + a, k) for a, k in parse(w, d, index)]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)], names=["d", "c", "s", "n"])


def join_factors(n_words: int, starts: list[int], counts: list[int], width: int) -> list[tuple[int, int]]:
    """Longest spans [start, end) of words that the factors cover."""
    edge = np.zeros(n_words + 1, np.int64)
    s, n = np.array(starts, np.int64), np.array(counts, np.int64)
    np.add.at(edge, s, 1)
    np.add.at(edge, s + n - 1 + width, -1)
    covered = np.cumsum(edge[:-1]) > 0
    flips = np.flatnonzero(np.diff(np.r_[False, covered, False]))
    return list(zip(flips[::2].tolist(), flips[1::2].tolist(), strict=True))


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, spans, removed, kept = [], [], [], []
        texts = batch.column("text").cast(pa.large_binary())
        for text, factors in zip(texts, batch.column("factors").to_pylist(), strict=True):
            words = (text.as_py() or b"").split()
            n_words.append(len(words))
            found = join_factors(len(words), [f["s"] for f in factors], [f["n"] for f in factors], width) if factors else []
            spans.append([{"start": a, "end": b} for a, b in found])
            removed.append(sum(b - a for a, b in found))
            mask = np.ones(len(words), bool)
            for a, b in found:
                mask[a:b] = False
            kept.append(b" ".join(compress(words, mask.tolist()) if found else words))
        names = [n for n in batch.schema.names if n != "factors"]
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        new = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, spans_type), "kept": pa.array(kept, pa.binary()).cast(pa.string())}
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new.values()], names=[*names, *new])


def remove_repeats(docs: DataFrame, width: int = WIDTH, indexed: int = INDEXED) -> DataFrame:
    """(doc, n_words, n_removed, spans, kept) for every row of ``docs``.

    ``doc`` is a struct of the row's own columns, whatever their names. A word goes if a
    window of ``width`` consecutive words covers it whose words also start in a document
    of smaller doc_id; windows are judged on the texts as given. ``spans`` are the word
    ranges removed, ``kept`` the other words joined by one space.

    Null or empty texts have no words. A row with a null doc_id neither loses words nor
    counts as earlier. Repeated rows (one doc_id) don't count against each other; equal ones are parsed once. A text
    shorter than ``width`` words stays whole.
    """
    base = docs.select(F.struct("*").alias("doc")).select(F.col("doc.doc_id").cast("long").alias("d"), F.shiftright(F.xxhash64("doc.text"), 32).cast("int").alias("c"), F.col("doc.text").alias("text"), F.struct(*[F.col(f"doc.`{n}`").alias(n) for n in docs.columns if n != "text"]).alias("rest"))
    blocks = materialize(base.select("text", "d", "c").mapInArrow(partial(_blocks, width=width, anchor=min(ANCHOR, width)), "g long, u long, d long, c int, s int, n int"), "blocks")
    # equal rows have equal blocks: they are parsed once
    repeated = not blocks.filter("s = 0").groupBy("d", "c").count().filter("count > 1").isEmpty()
    if repeated:
        blocks = materialize(blocks.distinct(), "blocks")
    texts = blocks.groupBy("g", "u").agg(F.min("d").alias("m"), F.count("*").alias("k"))
    split = texts.groupBy("g").agg(F.count("*").alias("t")).filter("t > 1").select("g", F.lit(True).alias("differ"))
    known = texts.join(split, "g", "left").filter("k > 1 or differ")
    found = blocks.join(known, ["g", "u"]).filter("m < d or differ").select("d", "c", F.struct("s", "n", F.expr("if(m < d, null, g)").alias("g"), F.expr("if(m < d, null, u)").alias("u")).alias("x"))
    # one text's blocks: as many as its words allow
    flags = materialize(found.groupBy("d", "c").agg(F.collect_list("x").alias("x")), "flags")
    joined = base.join(flags.hint("shuffle_hash"), ["d", "c"], "left")
    held = materialize(joined.select("d", "c", "text", "rest", F.expr("filter(x, b -> b.g is null)").alias("factors"), F.expr("filter(x, b -> b.g is not null)").alias("parts")), "held")
    open_ = held.filter("size(parts) > 0")
    once = open_.select("d", "c", "text", "parts")
    once = once.dropDuplicates(["d", "c"]) if repeated else once
    rows = materialize(once.mapInArrow(partial(_open_blocks, width=width), "g long, u long, d long, c int, s int, w array<long>"), "open")
    hot = materialize(rows.groupBy("g", "u").agg(F.lit(1)).groupBy("g").count().filter(F.col("count") > indexed).select("g"), "hot")
    some = not hot.isEmpty()
    dealt = (rows.join(hot, "g", "left_anti") if some else rows).select("g", "d", "c", "s", "w").repartition("g").sortWithinPartitions("g", "d", "s")
    factors = dealt.mapInArrow(_parse_batches, "d long, c int, s int, n int")
    if some:
        windows = rows.join(hot, "g", "left_semi").select("g", "d", "c", "s", F.posexplode("w").alias("i", "w")).select("g", "w", "d", "c", (F.col("s") + F.col("i")).alias("s"))
        first = windows.groupBy("g", "w").agg(F.min("d").alias("m"), F.max("d").alias("z")).filter("m < z").select("g", "w", "m")
        factors = factors.unionByName(windows.join(first, ["g", "w"]).filter("m < d").select("d", "c", "s", F.lit(1).alias("n")))
    late = factors.groupBy("d", "c").agg(F.collect_list(F.struct("s", "n")).alias("x"))
    slim = "transform({}, b -> struct(b.s as s, b.n as n))"
    checked = open_.join(late.hint("shuffle_hash"), ["d", "c"], "left").select("text", "rest", F.expr(f"concat({slim.format('factors')}, coalesce(x, array()))").alias("factors"))
    whole = held.filter("parts is null or size(parts) = 0").select("text", "rest", F.expr(slim.format("factors")).alias("factors"))
    cut = whole.unionByName(checked)
    rest = docs.select([n for n in docs.columns if n != "text"]).schema.simpleString()
    made = cut.mapInArrow(partial(_cut, width=width), f"text string, rest {rest}, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string")
    doc = F.struct(*[F.col("text").alias(n) if n == "text" else F.col(f"rest.`{n}`").alias(n) for n in docs.columns])
    return made.select(doc.alias("doc"), "n_words", "n_removed", "spans", "kept")


def kept_digest(words: str) -> str:
    return hashlib.sha256(words.encode()).hexdigest()


def op3_substring(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of ``documents`` at windows of 50 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs.select("doc_id", "text")).select("doc.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
with docs as (select row_number() over () as rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '') as ws from documents),
windows as (select rid, doc_id, s, md5(array_to_string(list_slice(ws, s, s + 49), ' ')) as k from (select rid, doc_id, ws, unnest(range(1, greatest(len(ws) - 48, 1))) as s from docs)),
first as (select k, min(doc_id) as m from windows group by k),
gone as (select distinct rid, unnest(range(s, s + 50)) as p from windows join first using (k) where m < doc_id),
words as (select rid, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as p from docs),
kept as (select rid, string_agg(w, ' ' order by p) as t, count(*) as n from words anti join gone using (rid, p) group by rid)
select doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from docs left join kept using (rid)
"""
