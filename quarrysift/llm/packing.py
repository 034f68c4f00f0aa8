"""Packing of token pieces into sequences by exact complements, then best fit.

Only the lengths matter to a plan, and there are at most ``size`` different ones, so the
driver plans with a histogram: for the longest pieces first, it looks in hashed sums of one,
two and three available lengths for a combination that fills the gap exactly, and uses it as
often as the counts allow; what is left goes by best fit. The plan is a list of patterns
with multiplicities, whose size follows the number of lengths and not of pieces. Each piece
finds its place by its rank among those of its length.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from ..session import materialize
from .tokens import vocabulary

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SIZE, END_ID = 2048, 0
#: Parts remembered in each of two generations, and parts encoded together.
REMEMBERED, TOGETHER = 400_000, 200
#: Ranks within a length are counted in so many groups, as one length may hold most pieces.
GROUPS = 64
#: Latin letters and what follows, if that does not begin with a letter or number of any script.
_CORE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]++)(?![^\W_])(.+)", re.DOTALL)
_CUT, _ODD = re.compile(r" (?=\S)"), re.compile(r" (?:\s|$)")


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, by parts of text remembered.

    In byte-level BPE a space before a visible character always begins a pre-token, so a
    text's ids are those of its parts cut there. Each different part is encoded once while
    it is remembered. New parts are encoded many at a time, joined as in a text: a part's
    first token begins with a space, and none else if the part has no space inside. Where
    the sum of such tokens is another, or an added token is met, each part goes alone. A run
    of letters and what follows are different pre-tokens, so "word," needs "word" and ",".
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True  # the model's sign for a space
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
            self.tails = {}
        new = self._recall(parts)
        halves, whole = [], []
        for p in new:
            if m := _CORE.fullmatch(p):
                halves.append((p, m[1], m[2]))
            else:
                whole.append(p)
        self._add([*whole, *self._recall({core for _, core, _ in halves}.difference(whole))])
        tails = list({tail for _, _, tail in halves}.difference(self.tails))
        self.tails.update(zip(tails, self._encode(tails), strict=True))
        self.known.update((p, self.known[core] + self.tails[tail]) for p, core, tail in halves)

    def _recall(self, parts: set[str]) -> set[str]:
        """Those of ``parts`` that neither generation holds; what the older holds is taken over."""
        new = parts.difference(self.known)
        again = [p for p in new if p in self.older]  # intersection() would go through all that is older
        self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
        return new.difference(again)

    def _add(self, new: list[str]) -> None:
        groups = [new[lo : lo + TOGETHER] for lo in range(0, len(new), TOGETHER)]
        joined = [" " + " ".join(g) for g in groups]
        for group, text, ids in zip(groups, joined, self._encode(joined), strict=True):
            starts = np.flatnonzero(self.spaced[np.frombuffer(ids, "<u4")]) * 4
            if len(starts) != len(group) or self.added.search(text):
                self.known.update(zip(group, self._encode([" " + p for p in group]), strict=True))
                continue
            edges = [*starts.tolist(), len(ids)]
            self.known.update(zip(group, map(ids.__getitem__, map(slice, edges, edges[1:])), strict=True))

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        parts = [_CUT.split(t) if _ODD.search(t) else t.split(" ") for t in texts]
        flat = [p for text in parts for p in text[1:]]
        ids = list(map(self.known.get, flat))
        new = [at for at, x in enumerate(ids) if x is None]
        self._learn({flat[at] for at in new})
        for at in new:
            ids[at] = self.known[flat[at]]
        at = 0
        for first, text in zip(self._encode([p[0] for p in parts]), parts, strict=True):
            yield first + b"".join(ids[at : at + len(text) - 1])
            at += len(text) - 1


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(path)


def _piece_batches(batches: Iterator[pa.RecordBatch], path: str, size: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = encoder(path).batch
    end = np.array([END_ID], "<u4").tobytes()
    for whole in batches:
        for lo in range(0, whole.num_rows, 128):
            batch = whole.slice(lo, 128)
            rows: list[tuple] = []
            for at, ids in enumerate(encode([t or "" for t in batch.column("text").to_pylist()])):
                ids += end
                n = len(ids) // 4
                edges = [0, *range(n - (n - 1) // size * size, n + 1, size)]
                rows += [(at, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), ids[4 * a : 4 * b] if with_ids else None) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [batch.column("doc").take(pa.array(cols[0])), *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays[: None if with_ids else -1], names=["doc", "piece", "start", "length", "ids_crc32", "ids"][: None if with_ids else -1])


def token_pieces(docs: DataFrame, path: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """(doc, piece, start, length, ids_crc32[, ids]): each row's text as pieces of at most ``size`` tokens.

    ``doc`` is a struct of the row's columns but ``text``. Null texts count as empty; every
    text ends with id 0, so that each row has a piece. Only the first piece of a text that
    is cut may be shorter than ``size``.
    """
    rest = [F.col(f"`{n}`") for n in docs.columns if n != "text"]
    packed = docs.select(F.struct(*rest).alias("doc"), "text")
    fields = [packed.schema["doc"], T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32"))]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)
    return packed.mapInArrow(partial(_piece_batches, path=path, size=size, with_ids=with_ids), schema)


def plan(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how often) for so many pieces of each length; counts[n]: pieces of length n."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...]) -> int:
        uses: dict[int, int] = {}
        for n in lengths:
            uses[n] = uses.get(n, 0) + 1
        times = int(min(left[n] // k for n, k in uses.items()))
        if times:
            for n, k in uses.items():
                left[n] -= k * times
            out.append((lengths, times))
        return times

    have = lambda: left > 0
    for n in range(size, 0, -1):
        gap = size - n
        if not left[n]:
            continue
        if not gap:
            take((n,))
            continue
        take((n, gap))
        if left[n]:  # two lengths that fill the gap, the longer first
            b = np.arange(gap - 1, (gap - 1) // 2, -1)
            for x in b[have()[b] & have()[gap - b]].tolist():
                take((n, x, gap - x))
                if not left[n]:
                    break
        if left[n] and gap >= 3:  # three, by the sums that two available lengths make
            on = have()
            sums = np.zeros(gap + 1, bool)
            some = np.flatnonzero(on[: gap + 1])
            for x in some.tolist():
                sums[x + 1 :] |= on[1 : gap + 1 - x]
            c = np.arange(gap - 2, 0, -1)
            for x in c[on[c] & sums[gap - c]].tolist():
                rest = gap - x
                b = np.arange(rest - 1, (rest - 1) // 2, -1)
                for y in b[have()[b] & have()[rest - b]].tolist():
                    take((n, x, y, rest - y))
                    if not left[n]:
                        break
                if not left[n]:
                    break
    top = np.flatnonzero(left)
    while len(top):  # best fit: the longest piece left that still fits, again and again
        n = int(top[-1])
        lengths, gap = [n], size - n
        spare = left.copy()
        spare[n] -= 1
        while gap:
            fits = np.flatnonzero(spare[: gap + 1])
            if not len(fits):
                break
            x = int(fits[-1])
            lengths.append(x)
            spare[x] -= 1
            gap -= x
        take(tuple(lengths))
        top = np.flatnonzero(left)
    return out


class Places:
    """Sequence and offset of the r-th piece of each length under a plan."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        used: dict[int, int] = {}
        keys, sequence, offset, base = [], [], [], 0
        for lengths, times in patterns:
            at = 0
            for n in lengths:
                r = used.get(n, 0)
                used[n] = r + times
                keys.append((n << 44) + r)
                sequence.append(base)
                offset.append(at)
                at += n
            base += times
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.sequence, self.offset = (np.array(x, np.int64)[order] for x in (keys, sequence, offset))

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << 44) + rank
        at = np.searchsorted(self.keys, key, side="right") - 1
        return self.sequence[at] + key - self.keys[at], self.offset[at]


def _place_batches(batches: Iterator[pa.RecordBatch], places: Places, before: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, group, rank = (batch.column(n).to_numpy() for n in ("length", "qs_group", "qs_rank"))
        sequence, offset = places(length, before[length, group] + rank - 1)
        keep = [n for n in batch.schema.names if n not in ("qs_group", "qs_rank")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])


def pack(pieces: DataFrame, size: int = SIZE, groups: int = GROUPS) -> DataFrame:
    """``pieces`` (length from 1 to size, any others) with sequence_id and offset.

    A table that is read twice: it should be written. Pieces of equal rows are told apart
    by rank alone. An empty table gives none.
    """
    by = [n for n in pieces.columns if n not in ("length", "ids")]
    dealt = pieces.withColumn("qs_group", F.pmod(F.xxhash64(*by), F.lit(groups)).cast("int"))
    counts = np.zeros((size + 1, groups), np.int64)
    for r in dealt.groupBy("length", "qs_group").count().collect():  # at most size * groups rows
        counts[r[0], r[1]] = r[2]
    before = np.cumsum(counts, axis=1) - counts
    places = Places(plan(counts.sum(axis=1), size))
    rank = F.row_number().over(Window.partitionBy("length", "qs_group").orderBy(*by)).cast("long")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.withColumn("qs_rank", rank).mapInArrow(partial(_place_batches, places=places, before=before), schema)


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, any others) tokenized, cut and packed.

    Gives doc_id, piece, start, length, ids_crc32, sequence_id, offset. The pieces are
    written to the shared folder before they are packed, so that their ranks hold.
    """
    pieces = token_pieces(docs.select("doc_id", "text"), path or vocabulary("byte_bpe_50k.json"), size)
    return pack(materialize(pieces.select("doc.doc_id", "piece", "start", "length", "ids_crc32"), "pieces"), size)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all ``documents`` with their places in sequences of 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
