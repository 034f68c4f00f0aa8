"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its words (A-Z lower-cased) and an end. Before each token one bit says whether the
text ends. The words, each with a stop byte behind it, are then coded byte by byte along a
fixed code tree (a Huffman code of the training words' bytes), so a byte is some four bits.
Four predictors look back from each bit over the text's bytes, across words:

* the last 3 bytes, and the last 5;
* the word so far;
* the word so far and the whole word before it.

Each holds counts of zeros and ones in a table, found by a hash of its context, and by the
node of the code tree. Their stretched probabilities are combined by a set of weights that a
gate selects (which of a byte's two word contexts have counts). Weights begin alike and
learn online: after every ``RANGE`` bytes of a text those of each gate take a gradient step
(after its first ``LATER`` bytes, every ``LATER``).
Two more predictors refine the result. The first is the text itself: words that it has used
before, with a weight that follows how often it told better. The second is the memory of the
corpus: a text is cut into segments at places that its words alone decide, and how often each
segment followed the one before it in other training texts is mixed in. These counts, and
those of words, are tables that grow with the corpus and meet the texts in joins; the bit
predictors' tables have one size whatever the corpus.

A training text is scored as if it were not in the training set: its own bits, and its own
segments, are taken out of the counts. So texts that occur twice stand out.

All sums over the corpus are of integers, so the scores do not depend on how rows are dealt
to tasks (but for the last digits).
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_batches, materialize

#: Bytes that the first predictors look at; slots of each predictor's table, as powers of two: those, the word so far, with the word before.
ORDERS, TABLE_BITS = (3, 5), (20, 21, 22, 22)
PREDICTORS, GATED, GATES, STOP = len(TABLE_BITS), 2, 4, 32
_BEGIN = np.concatenate([[0], np.cumsum([1 << b for b in TABLE_BITS])]).astype(np.int64)
_DROP = np.array([32 - b for b in TABLE_BITS], np.uint32)[:, None]
_BLOCK = 1 << 12
_UP = np.multiply.accumulate(np.r_[np.uint64(1), np.full(65_535, 0xD6E8FEB86659FD93, np.uint64)])
#: Count added to zeros and ones; steps of a stretched probability; weight of each predictor as a text begins.
PRIOR, STEP, FIRST = 0.4, 0.1, 0.35
#: Bytes hashed together, and coded between two steps of a text's own weights, at first and after as many as ``LATER``.
PIECE, RANGE, LATER, RATE = 1 << 16, 512, 4096, 10.0
#: Bytes that are coded at once, of as many texts as have a range next.
TOGETHER = 3 * LATER
#: Bytes counted together, and their different (context, byte) spread out at once; words held by a task before it gives their counts; words sent to all tasks.
COUNTED, SPREAD, HELD, FREQUENT = 1 << 20, 1 << 14, 300_000, 150_000
#: A text is cut after about every so many words.
SEGMENT = 16


class Code:
    """Binary code of byte values from their counts (each one more than given)."""

    def __init__(self, counts: list[int]):
        heap = [(int(c) + 1, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        children: dict[int, tuple[int, int]] = {}
        for inner in range(256, 511):
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            children[inner] = (x, y)
            heapq.heappush(heap, (a + b, inner))
        paths: dict[int, tuple] = {510: ()}
        for inner in range(510, 255, -1):
            for bit, child in enumerate(children[inner]):
                paths[child] = (*paths[inner], (510 - inner, bit))
        self.length = np.array([len(paths[v]) for v in range(256)], np.int64)
        self.offset = np.cumsum(self.length) - self.length
        #: Nodes by falling count, the root 0: those of one context are neighbours in its table.
        self.node = np.array([n for v in range(256) for n, _ in paths[v]], np.uint32)
        self.bit = np.array([b for v in range(256) for _, b in paths[v]], np.uint8)
        #: Twice the node, and the bit.
        self.step = self.node * np.uint32(2) + self.bit

    def steps(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits of each byte, where they begin, and node and value of every bit (twice the node, and the bit)."""
        n = self.length.take(data)
        end = np.cumsum(n)
        begin = end - n
        at = np.repeat(self.offset.take(data) - begin, n)
        at += np.arange(len(at))
        return n, begin, self.step.take(at)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    return x * np.uint32(0x846CA68B)


def _fold(x: np.ndarray) -> np.ndarray:
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


@dataclass
class Piece:
    """Bytes of some texts' words: ``hashes`` (predictors, bytes: slots of the code tree's root), and the words that begin or end in it."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray  # of words, the first perhaps begun earlier
    goes_on: bool  # whether the first word began earlier
    ended: np.ndarray  # hashes of the words that end here
    texts: np.ndarray  # where texts begin; none if the first began earlier


def pieces(texts: Iterable[list[bytes]], size: int = PIECE) -> Iterator[Piece]:
    """The bytes of texts' words, each with a stop byte behind, and the slots of their contexts.

    Short texts come together; a long one comes in pieces of its own. Contexts end at a text's
    beginning. Texts without words have no bytes.
    """
    held: list[list[bytes]] = []
    length = 0
    for words in texts:
        n = sum(map(len, words)) + len(words)
        if held and length + n > size:
            yield from _pieces(held, size)
            held, length = [], 0
        if n:
            held.append(words)
            length += n
    if held:
        yield from _pieces(held, size)


def _pieces(texts: list[list[bytes]], size: int) -> Iterator[Piece]:
    """One piece, or several if there is one text, and it is longer than ``size``."""
    joined = [b" ".join(words) + b" " for words in texts]
    at = np.cumsum([0, *map(len, joined)])[:-1]
    whole = np.frombuffer(b"".join(joined), np.uint8)
    before, prev, done, within = np.full(5, STOP, np.uint32), np.uint64(0), np.uint64(0), 0
    for lo in range(0, len(whole), size):
        data = whole[lo : lo + size]
        stops = np.flatnonzero(data == STOP)
        starts = np.r_[0, stops + 1]
        starts = starts[starts < len(data)]
        n = np.diff(np.r_[starts, len(data)])
        inside = np.arange(len(data)) - np.repeat(starts, n)
        inside[: n[0]] += within
        v = (data.astype(np.uint64) + np.uint64(1)) * _UP[inside & 65_535]
        prefix = np.cumsum(v) - v
        prefix -= np.repeat(prefix[starts], n)
        prefix[: n[0]] += done
        ended = prefix[stops]
        prevs = np.r_[prev, ended][: len(starts)]
        here = at if not lo else at[:0]
        prevs[np.searchsorted(starts, here)] = 0
        h = np.empty((PREDICTORS, len(data)), np.uint32)
        padded = np.r_[before, data.astype(np.uint32)]
        run = np.zeros(len(data), np.uint32)
        for k in range(1, 6):
            back = padded[5 - k : 5 - k + len(data)].copy()
            fix = (here[:, None] + np.arange(k)).ravel()
            back[fix[fix < len(data)]] = STOP
            run = (run + back + np.uint32(1)) * np.uint32(0x9E3779B1)
            run ^= run >> np.uint32(15)
            if k in ORDERS:
                h[ORDERS.index(k)] = _mix(run)
        h[2] = _fold(prefix)
        h[3] = _fold(prefix ^ np.repeat(prevs * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1), n))
        h >>= _DROP
        yield Piece(data, h, starts, within > 0, ended, here)
        before = padded[-5:]
        if data[-1] == STOP:
            prev, done, within = ended[-1], np.uint64(0), 0
        else:
            done = (prefix[-1:] + v[-1:])[0]
            prev, within = prevs[-1], int(inside[-1]) + 1


class Counts:
    """Zeros and ones of every slot, over the texts of a task."""

    def __init__(self, code: Code):
        self.code, self.held, self.bytes = code, [], 0
        self.n = np.zeros(2 * int(_BEGIN[-1]), np.int32)

    def add(self, texts: Iterable[list[bytes]]) -> None:
        for p in pieces(texts):
            self.held.append((p.hashes, p.data))
            self.bytes += len(p.data)
            if self.bytes >= COUNTED:
                self.flush()

    def flush(self) -> None:
        """A byte's bits are counted once for each different (context, byte), with its number."""
        if not self.held:
            return
        data = np.concatenate([d for _, d in self.held]).astype(np.uint64)
        for k in range(PREDICTORS):
            key = np.concatenate([h[k] for h, _ in self.held]).astype(np.uint64)
            key <<= np.uint64(8)
            key |= data
            key.sort()
            edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            times = np.diff(np.r_[edge, len(key)]).astype(np.int32)
            key = key[edge]
            table = self.n[2 * _BEGIN[k] : 2 * _BEGIN[k + 1]]
            for lo in range(0, len(key), SPREAD):
                part = key[lo : lo + SPREAD]
                n, _, step = self.code.steps(part.astype(np.uint8))
                x = np.repeat((part >> np.uint64(7)).astype(np.int64) & -2, n)
                x ^= step
                np.add.at(table, x, np.repeat(times[lo : lo + SPREAD], n))
        self.held, self.bytes = [], 0

    def blocks(self) -> Iterator[pa.RecordBatch]:
        self.flush()
        rows = self.n.reshape(-1, 2 * _BLOCK)
        at = np.flatnonzero(rows.any(axis=1))
        for lo in range(0, len(at), 256):
            part = at[lo : lo + 256]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([rows[i].tobytes() for i in part], pa.binary())], names=["block", "n"])


def stretch(n: np.ndarray) -> np.ndarray:
    """Stretched probabilities of slots (zeros, ones) in ``STEP``s: as they are, less a zero, less a one.

    A slot without counts, or with as many zeros as ones, gives 0.
    """
    n = n.reshape(-1, 2)
    z, o = n[:, 0].astype(np.float64), n[:, 1].astype(np.float64)
    out = np.empty((3, len(z)), np.int8)
    for row, a, b in zip(out, (z, np.maximum(0, z - 1), z), (o, o, np.maximum(0, o - 1)), strict=True):
        row[:] = np.clip(np.rint(np.log((b + PRIOR) / (a + PRIOR)) / STEP), -127, 127)
    return out


@dataclass
class Model:
    """Tables of stretched probabilities: ``all`` by slot; ``less`` by slot and bit, without one such bit."""

    code: Code
    all: np.ndarray
    less: np.ndarray

    def inputs(self, p: Piece, lo: np.ndarray, hi: np.ndarray, own: bool) -> Bits:
        """The bits of the bytes from lo to hi of some texts, those of a text in order of their gates."""
        size = hi - lo
        place = np.repeat(lo - np.cumsum(size) + size, size)
        place += np.arange(len(place))
        data = p.data.take(place)
        first = self.code.bit.take(self.code.offset.take(data)) if own else None
        part = np.repeat(np.arange(0, GATES * len(size), GATES, np.uint16), size)
        for k in range(PREDICTORS - GATED, PREDICTORS):
            h = p.hashes[k].take(place)
            seen = (self.less[2 * _BEGIN[k] : 2 * _BEGIN[k + 1]].take(h * np.int64(2) + first) if own else self.all[_BEGIN[k] : _BEGIN[k + 1]].take(h)) != 0
            part += seen.view(np.uint8) << np.uint8(k - PREDICTORS + GATED)
        order = np.argsort(part, kind="stable")
        place = place.take(order)
        n, begin, step = self.code.steps(data.take(order))
        bit = (step & np.uint32(1)).astype(np.uint8)
        root = p.hashes.take(place, axis=1)
        if own:
            root <<= np.uint32(1)
        else:
            step >>= np.uint32(1)
        x = np.empty((PREDICTORS, len(bit)), np.float32)
        for k in range(PREDICTORS):
            at = np.repeat(root[k], n)
            at ^= step
            x[k] = self.less[2 * _BEGIN[k] : 2 * _BEGIN[k + 1]].take(at) if own else self.all[_BEGIN[k] : _BEGIN[k + 1]].take(at)
        many = np.bincount(part, minlength=GATES * len(size))
        parts = np.flatnonzero(many)
        return Bits(x, bit, begin, place, parts, begin.take((np.cumsum(many) - many)[parts]))


@dataclass
class Bits:
    """Bits, grouped by text and gate."""

    x: np.ndarray  # stretched probabilities (predictors, bits)
    bit: np.ndarray
    begin: np.ndarray  # where each byte's bits begin
    place: np.ndarray  # the bytes' places
    parts: np.ndarray  # numbers of the groups: GATES times the text, and the gate
    edge: np.ndarray  # where each group's bits begin

    def mixed(self, weights: np.ndarray) -> np.ndarray:
        """``weights``: (texts, gates, predictors)."""
        w = weights.reshape(-1, PREDICTORS)[self.parts].T
        size = np.diff(np.r_[self.edge, len(self.bit)])
        t = np.repeat(w[0], size)
        t *= self.x[0]
        for k in range(1, PREDICTORS):
            v = np.repeat(w[k], size)
            v *= self.x[k]
            t += v
        return np.clip(t, -12, 12, out=t)

    def steps(self, error: np.ndarray, texts: int) -> np.ndarray:
        """What the weights lose, given by how much each bit's one was expected too much."""
        out = np.zeros((texts * GATES, PREDICTORS), np.float32)
        for k, x in enumerate(self.x):
            slope = np.add.reduceat(x * error, self.edge)
            slope *= np.float32(RATE)
            slope /= np.maximum(np.float32(1e4), np.add.reduceat(x * x, self.edge))
            out[self.parts, k] = slope
        return out.reshape(texts, GATES, PREDICTORS)


def _rounds(p: Piece) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(texts, from, to, whether one goes on): the first range of every text, then the second of those that have one, and so on."""
    begun = not len(p.texts)
    at = np.zeros(1, np.int64) if begun else p.texts.astype(np.int64)
    end = np.r_[at[1:], len(p.data)]
    live, done, alone = np.arange(len(at)), LATER if begun else 0, len(at) == 1
    while len(live):
        step = RANGE if done < LATER else LATER
        lo = at[live]
        hi = np.minimum(lo + step, end[live])
        edge = np.flatnonzero(np.diff(np.cumsum(hi - lo) // TOGETHER, prepend=-1))
        for a, b in zip(edge, [*edge[1:], len(live)], strict=True):
            yield live[a:b], lo[a:b], hi[a:b], alone or bool((hi[a:b] < end[live[a:b]]).any())
        at[live] = hi
        done += step
        live = live[hi < end[live]]


def spell(model: Model, texts: list[list[bytes]], own: bool) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each word's bytes and stop, and the words' hashes, over all texts.

    ``own``: the texts' bits are in the tables, and each is left out for itself.
    """
    out, at, ended = np.zeros(sum(map(len, texts))), 0, [np.zeros(0, np.uint64)]
    weights = np.zeros(0)
    for p in pieces(texts):
        if len(p.texts):
            weights = np.full((len(p.texts), GATES, PREDICTORS), FIRST * STEP, np.float32)
        cost = np.empty(len(p.data))
        for which, lo, hi, goes_on in _rounds(p):
            bits = model.inputs(p, lo, hi, own)
            t = bits.mixed(weights[which])
            sign = 1 - 2 * bits.bit.astype(np.float32)
            t *= sign  # the loss is log(1 + exp(t))
            u = np.exp(t)
            cost[bits.place] = np.log(np.multiply.reduceat((u + 1).astype(np.float64), bits.begin))
            if goes_on:
                u /= 1 + u
                u *= sign
                weights[which] -= bits.steps(u, len(which))
        word = np.add.reduceat(cost, p.starts)
        first = at - 1 if p.goes_on else at
        out[first : first + len(word)] -= word
        at = first + len(word)
        ended.append(p.ended)
    return out / np.log(10), np.concatenate(ended)


#: Weight of the text's own words by gate, before it has told anything.
SELF, SELF_WEIGHT = np.array([0.02, 0.3, 0.7, 0.9]), 8.0


def own_words(ids: np.ndarray, spelt: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """log10 probability of each word, with the words that its text has used before mixed in.

    ``texts``: where texts begin among the words. The gate counts how many of the last three
    words the text would have told better.
    """
    n = len(ids)
    size = np.diff(np.r_[texts, n])
    text = np.repeat(np.arange(len(texts)), size)
    place = np.arange(n) - np.repeat(texts, size)
    key = (ids ^ (ids >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + text.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    seen = np.arange(n)
    before = np.empty(n)
    before[order] = seen - np.maximum.accumulate(np.where(new, seen, 0))
    cache = before / np.maximum(1, place)
    plain = 10.0**spelt
    better = cache > 3 * plain
    gate = np.zeros(n, np.int64)
    for k in (1, 2, 3):
        gate[k:] += better[:-k] & (place[k:] >= k)
    weight = np.empty(n)
    for g in range(4):
        on = np.flatnonzero(gate == g)
        hits = np.r_[0, np.cumsum(better[on])]
        first = np.searchsorted(on, texts)[text[on]]  # the text's first word of this gate
        tries = np.arange(len(on))
        weight[on] = (SELF[g] * SELF_WEIGHT + hits[:-1] - hits[first]) / (SELF_WEIGHT + tries - first)
    weight = np.clip(weight, 1e-3, 1 - 1e-3)
    weight[place == 0] = 0.0  # nothing is used before
    told = before > 0
    out = spelt + np.log10(1 - weight)
    out[told] = np.log10(weight[told] * cache[told] + (1 - weight[told]) * plain[told])
    return out


def segments(ids: np.ndarray, cost: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where segments begin; hash of the one before, own hash, different ones after that, whether new, cost.

    A text is cut after a word if a hash of it and the word before says so, about every
    ``SEGMENT`` words. Nothing is before a text's first segment, which gets 0.
    """
    n = len(ids)
    if not n:
        return texts[:0], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool), np.zeros(0)
    mul = np.uint64(0x9E3779B97F4A7C15)
    pair = (ids[1:] * mul + ids[:-1]) * np.uint64(0xC2B2AE3D27D4EB4F)
    cut = np.zeros(n + 1, bool)
    cut[2:] = (pair >> np.uint64(32)) % np.uint64(SEGMENT) == 0
    size = np.diff(np.r_[texts, n])
    one = texts[size > 1] + 1  # a cut after a text's first word would ask the text before
    cut[one] = False
    cut[texts] = True
    starts = np.flatnonzero(cut[:n])
    inside = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
    own = np.add.reduceat((ids ^ (ids >> np.uint64(29))) * _UP[(inside + 1) & 65_535], starts)
    own = (own ^ (own >> np.uint64(31))) * mul
    text = np.searchsorted(texts, starts, "right")
    before = np.r_[np.uint64(0), own[:-1]]
    before[np.searchsorted(starts, texts)] = 0
    order = np.lexsort((own, before, text))
    b, o, t = before[order], own[order], text[order]
    group = np.r_[True, (b[1:] != b[:-1]) | (t[1:] != t[:-1])]
    fresh = group.copy()
    fresh[1:] |= o[1:] != o[:-1]
    number = np.cumsum(group) - 1
    after, first = np.empty(len(starts), np.int32), np.empty(len(starts), bool)
    after[order] = np.bincount(number, fresh)[number]
    first[order] = fresh
    return starts, before.view(np.int64), own.view(np.int64), after, first, np.add.reduceat(cost, starts)


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def word_ids(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, those that ``spell`` gives."""
    return np.concatenate([np.zeros(0, np.uint64), *(p.ended for p in pieces([words]))])


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the training words of a task."""
    train: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(train), pa.binary()).cast(pa.string()), pa.array(list(train.values()), pa.int64())], names=["word", "train"])
        train.clear()
        return out

    for batch in batches:
        for text in batch.column("text").cast(pa.large_binary()):
            train.update(_words(text.as_py()))
            if len(train) > HELD:
                yield flush()
    if train:
        yield flush()


def _byte_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each byte value stands in the words, with their stops."""
    n = np.zeros(256, np.int64)
    for batch in batches:
        words = batch.column("word").cast(pa.large_binary())
        data, at = np.frombuffer(words.buffers()[2], np.uint8), np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        times = batch.column("train").to_numpy()
        size = np.diff(at)
        n += np.bincount(data[at[0] : at[-1]], np.repeat(times, size), 256).astype(np.int64)
        n[STOP] += times.sum()
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(n)], names=["value", "n"])


def _count_batches(batches: Iterator[pa.RecordBatch], code: Code) -> Iterator[pa.RecordBatch]:
    counts = Counts(code)
    for batch in batches:
        counts.add(_words(t.as_py()) for t in batch.column("text").cast(pa.large_binary()))
    yield from counts.blocks()


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretched probabilities of each block of slots; rows come sorted by block."""
    last, total = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([stretch(total).tobytes()], pa.binary())], names=["block", "x"])

    for batch in batches:
        for block, n in zip(batch.column("block").to_pylist(), batch.column("n"), strict=True):
            n = np.frombuffer(n.as_buffer(), np.int32).astype(np.int64)
            if block == last:
                total += n
                continue
            if last is not None:
                yield row()
            last, total = block, n
    if last is not None:
        yield row()


def _score_batches(batches: Iterator[pa.RecordBatch], shared, frequent) -> Iterator[pa.RecordBatch]:
    """Base sums over the frequent words of each text, its other words with their counts, and its segments."""
    model, (keys, counts, total) = shared.value, frequent.value
    base = np.log10((counts + 1) / total)
    serial = TaskContext.get().partitionId() << 33
    names = ["row", "n_bytes", "n_words", "known", "base", "words", "times", "before", "own", "after", "fresh", "cost"]

    def lists(flat: pa.Array, sizes: list[int]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), flat)

    for batch in batches:
        for part in _sized(batch):
            plain = [t.as_py() or b"" for t in part.column("text").cast(pa.large_binary())]
            texts = [_words(t) for t in plain]
            simple = [(serial + i, len(t), len(words), 0, 0.0) for i, (t, words) in enumerate(zip(plain, texts, strict=True))]
            serial += len(texts)
            held = part.column("held_out").to_pylist()
            found: list = [None] * len(texts)
            rest: list = [()] * len(texts)
            for flag in (True, False):
                mine = [i for i, h in enumerate(held) if h == flag and texts[i]]
                begin = np.cumsum([0, *(len(texts[i]) for i in mine)])
                spelt, ids = spell(model, [texts[i] for i in mine], not flag)
                starts, *columns = segments(ids, own_words(ids, spelt, begin[:-1]), begin[:-1])
                edge = np.searchsorted(starts, begin)
                at = np.searchsorted(keys, ids)
                known = keys.take(at, mode="clip") == ids if len(keys) else np.zeros(len(ids), bool)
                for i, a, b, lo, hi in zip(mine, edge, edge[1:], begin, begin[1:], strict=False):
                    found[i] = [c[a:b] for c in columns]
                    mark = known[lo:hi]
                    rest[i] = Counter(compress(texts[i], (~mark).tolist()))
                    has = at[lo:hi][mark]
                    simple[i] = (*simple[i][:3], len(has), float(base[has].sum()))
            empty = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, bool, np.float64)]
            found = [f or empty for f in found]
            sizes = [len(f[0]) for f in found]
            arrays = [pa.array(c, pa.float64() if k == 4 else pa.int64()) for k, c in enumerate(zip(*simple, strict=True))]
            spare = [len(r) for r in rest]
            arrays.append(lists(pa.array([w for r in rest for w in r], pa.binary()).cast(pa.string()), spare))
            arrays.append(lists(pa.array([n for r in rest if r for n in r.values()], pa.int64()), spare))
            arrays += [lists(pa.array(np.concatenate(c)), sizes) for c in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *arrays], names=["doc_id", "held_out", *names])


def _sized(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about a megabyte of text, a longer text alone."""
    size, lo, held = batch.column("text").cast(pa.large_binary()), 0, 0
    for hi, text in enumerate(size):
        n = len(text.as_buffer() or b"") if text.is_valid else 0
        if held and held + n > most:
            yield batch.slice(lo, hi - lo)
            lo, held = hi, 0
        held += n + 1
    if lo < batch.num_rows:
        yield batch.slice(lo)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def learn(texts: DataFrame, words: DataFrame) -> Model:
    """The bit predictors' tables from the training ``texts`` (text).

    ``words`` (word, train) are their counted words. Counting tasks take eight input
    partitions each (or all cores, if those are more), as each gives up to a table's size.
    """
    spark = texts.sparkSession
    sums = words.mapInArrow(_byte_batches, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).collect()
    counts = [0] * 256
    for r in sums:
        counts[r.value] = r.n
    code = Code(counts)
    tasks = max(spark.sparkContext.defaultParallelism, texts.rdd.getNumPartitions() // 8)
    blocks = texts.coalesce(tasks).mapInArrow(partial(_count_batches, code=code), "block int, n binary")
    summed = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_sum_batches, "block int, x binary")
    got = materialize(summed, "predictors").toArrow()  # the tables' fixed size, three bytes a slot
    table = np.zeros((3, int(_BEGIN[-1])), np.int8)
    for block, x in zip(got["block"].to_pylist(), got["x"].to_pylist(), strict=True):
        table[:, block * _BLOCK : (block + 1) * _BLOCK] = np.frombuffer(x, np.int8).reshape(3, -1)
    return Model(code, table[0], np.ascontiguousarray(table[1:].T).ravel())


def _remembered(rows: DataFrame) -> DataFrame:
    """(row, cost): each text's log10 probability, with the memory of segments mixed in."""
    cut = rows.select("row", "held_out", F.explode(F.arrays_zip("before", "own", "after", "fresh", "cost")).alias("x")).select("row", "held_out", F.col("x.before").alias("g"), F.col("x.own").alias("u"), F.col("x.after").alias("after"), F.col("x.fresh").alias("fresh"), F.col("x.cost").alias("cost"))
    same = cut.filter("g <> 0 and fresh").groupBy("g", "u").agg(F.count_if(~F.col("held_out")).alias("same"))
    every = same.groupBy("g").agg(F.sum("same").alias("every")).filter("every > 0")
    known = same.join(every, "g")
    own = F.when(F.col("held_out"), 0).otherwise(1)
    met = cut.join(known, ["g", "u"], "left").select("row", "held_out", "cost", (F.col("same") - own).alias("same"), (F.col("every") - own * F.col("after")).alias("every"))
    met = materialize(met.withColumn("gate", F.when(F.col("every") > 0, F.least(F.lit(4), F.floor(F.log2("every")).cast("int")))), "segments")
    share = {r.gate: (r.hits + 0.5) / (r.n + 1) for r in met.filter("gate is not null and not held_out").groupBy("gate").agg(F.count("*").alias("n"), F.count_if(F.col("same") > 0).alias("hits")).collect()}
    trust = F.lit(0.5)
    for gate, x in share.items():
        trust = F.when(F.col("gate") == gate, F.lit(x)).otherwise(trust)
    told = F.when(F.col("gate").isNull(), F.col("cost")).when(F.col("same") > 0, F.log10(trust * F.col("same") / F.col("every") + (1 - trust) * F.pow(F.lit(10.0), F.col("cost")))).otherwise(F.col("cost") + F.log10(1 - trust))
    return met.groupBy("row").agg(F.sum(told).alias("cost"))


def score_texts(docs: DataFrame, held: F.Column | None = None, frequent: int = FREQUENT) -> DataFrame:
    """Counts, base score and model score of every row of ``docs`` (doc_id, text, any others).

    Gives doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and
    bits_per_byte. The model learns from rows where ``held`` is not true. Null texts count
    as empty; a text without words is its end alone. Repeated rows each count and each get
    a row. Without training rows every count is zero and probabilities are the priors.
    ``frequent`` words are sent to all tasks as 64-bit hashes, the rest are joined; scores
    are the same.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    marked = docs.select("doc_id", "text", (held_out() if held is None else held).alias("held_out"))
    texts = marked.filter(~F.col("held_out")).select("text")
    words = materialize(texts.mapInArrow(_word_batches, "word string, train long").groupBy("word").agg(F.sum("train").alias("train")), "words")
    ended = texts.count()
    n, v = words.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count("*")).first()
    n, v = n + ended, v + (ended > 0)
    total = float(n + v + 1)
    shared = spark.sparkContext.broadcast(learn(texts, words))
    top = words.orderBy(F.desc("train"), "word").limit(frequent).toArrow()
    keys = word_ids(top["word"].cast(pa.binary()).to_pylist())
    order = np.argsort(keys)
    lists = spark.sparkContext.broadcast((keys[order], top["train"].to_numpy()[order], total))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, held_out boolean, row long, n_bytes long, n_words long, known long, base double, words array<string>, times array<long>, before array<long>, own array<long>, after array<int>, fresh array<boolean>, cost array<double>"
    rows = materialize(marked.mapInArrow(partial(_score_batches, shared=shared, frequent=lists), ddl), "rows")
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    met = rare.join(words, "word", "left").withColumn("train", F.coalesce("train", F.lit(0)))
    sums = met.groupBy("row").agg(F.sum(F.expr("if(train > 0, times, 0)")).alias("k"), F.sum(F.col("times") * F.log10((F.col("train") + 1) / F.lit(total))).alias("b"))
    ends = (ended + 0.5) / (n + 1)  # the bit before each token: does the text end here?
    out = rows.select("doc_id", "held_out", "row", "n_bytes", "n_words", "known", "base").join(sums, "row", "left").join(_remembered(rows), "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    score = zero("cost") + F.col("n_words") * float(np.log10(1 - ends)) + float(np.log10(ends))
    return out.select(
        "doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"), (F.col("known") + zero("k") + F.lit(int(ended > 0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b") + float(np.log10((ended + 1) / total))).alias("base_score"), score.alias("score"), (score * float(-np.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """Scores of every row of ``documents``; crc32 of doc_id's text modulo 7 = 2 is held out."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
