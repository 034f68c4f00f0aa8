"""Toxic documents by a support vector machine on a subsequence string kernel.

Words are compared by the gap-weighted kernel over ordered letter triples: a triple whose
letters lie up to ``GAP`` places apart counts decay**span, so an insult with letters
inserted or left out keeps most of its kernel value. A sentence holds, for each Nystroem
landmark word, its largest kernel value over the sentence's words; the landmarks' kernel
matrix to the power -1/2 maps that to the features of a linear machine. Sentences take the
label of their document, and those of a toxic document that the machine itself finds clean
change sides, except the most toxic one (multiple-instance training). A document is as
toxic as its worst sentence; Platt's sigmoid makes that a probability.

Fitting reads a bounded sample of labelled rows (``Settings.max_rows`` of each label, in
order of a hash of doc_id); scoring reads every word of every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

GAP, DECAY, LONGEST = 3, 0.7, 24
#: Pieces of words whose triples are worked out at once, and whose kernel rows are.
CODED, TOGETHER = 1024, 64
_STEPS = [(a, b) for a in range(1, GAP + 1) for b in range(1, GAP + 1)]
_NOT_LETTER = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Settings:
    max_rows: int = 3000  # labelled documents of each label that are fitted on
    max_sentences: int = 20_000  # sentences of each label
    landmarks: int = 160
    evidence: float = 30.0  # log-likelihood ratio from which a word marks toxic documents
    floor: float = 0.4  # words below it against every landmark count as unlike all
    threshold: float = 0.3


def unit(word: str) -> str:
    """Letters of a lower-cased word: characters put between them fall away."""
    return _NOT_LETTER.sub("", word)


def _codes(units: list[str], alphabet: dict[str, int]) -> np.ndarray:
    """Letter codes, one row for each piece; -1 beyond the end. Longer units give several."""
    out = np.full((len(units), LONGEST), -1, np.int32)
    for i, u in enumerate(units):
        row = [alphabet.get(ch, 0) for ch in u]
        out[i, : len(row)] = row
    return out


def _pieces(u: str) -> list[str]:
    """A unit in overlapping pieces of at most LONGEST letters, so that none is cut off."""
    return [u] if len(u) <= LONGEST else [u[i : i + LONGEST] for i in range(0, len(u) - LONGEST // 2, LONGEST // 2)]


def _triples(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Triple numbers (-1: none) and weights of each row."""
    ids, weights = [], []
    for a, b in _STEPS:
        x, y, z = codes[:, : LONGEST - a - b], codes[:, a : LONGEST - b], codes[:, a + b :]
        ids.append(np.where(z >= 0, (x * size + y) * size + z, -1))
        weights.append(np.full(ids[-1].shape[1], DECAY ** (a + b + 1), np.float32))
    return np.concatenate(ids, axis=1), np.concatenate(weights)


def _norms(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Length of the feature vector of each row; equal triples of a row add up first."""
    order = np.argsort(ids, axis=1, kind="stable")
    s, w = np.take_along_axis(ids, order, 1), weights[order]
    w = np.where(s < 0, 0, w)
    new = np.ones(s.shape, bool)
    new[:, 1:] = s[:, 1:] != s[:, :-1]
    sums = np.add.reduceat(w.ravel(), np.flatnonzero(new.ravel()))
    rows = np.flatnonzero(new.ravel()) // s.shape[1]
    return np.sqrt(np.bincount(rows, sums.astype(np.float64) ** 2, len(s)))


class Kernel:
    """Normalised kernel values against fixed landmarks, by their explicit triples."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.alphabet = {ch: i + 1 for i, ch in enumerate(sorted(set("".join(landmarks))))}
        self.size = len(self.alphabet) + 1
        ids, weights = _triples(_codes([x[:LONGEST] for x in landmarks], self.alphabet), self.size)
        norms = np.maximum(_norms(ids, weights), 1e-9)
        known = np.unique(ids[ids >= 0])
        self.row = np.zeros(self.size**3 + 1, np.int32)  # the last is for "none"
        self.row[known] = np.arange(1, len(known) + 1)
        self.values = np.zeros((len(known) + 1, len(landmarks)), np.float32)
        for j in range(len(landmarks)):
            m = ids[j] >= 0
            np.add.at(self.values[:, j], self.row[ids[j][m]], weights[m] / norms[j])
        self.most = self.values.max(axis=1)

    def __call__(self, units: list[str], floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units that reach ``floor`` against a landmark, and their kernel rows.

        An upper bound from each triple's largest value skips the rest without loss.
        """
        pieces, of = [], []
        for i, u in enumerate(units):
            if len(u) >= 3:
                p = _pieces(u)
                pieces += p
                of += [i] * len(p)
        of = np.array(of, np.int64)
        found, rows = [], []
        for at in range(0, len(pieces), CODED):
            ids, weights = _triples(_codes(pieces[at : at + CODED], self.alphabet), self.size)
            least = np.sqrt((np.where(ids >= 0, weights, 0) ** 2).sum(axis=1))
            hit = self.row[ids]
            bound = (self.most[hit] * weights).sum(axis=1) / np.maximum(least, 1e-9)
            go = np.flatnonzero(bound >= floor)
            for lo in range(0, len(go), TOGETHER):
                g = go[lo : lo + TOGETHER]
                own = hit[g]
                r, c = np.nonzero(own)
                k = np.zeros((len(g), len(self.landmarks)), np.float32)
                if len(r):
                    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                    k[r[first]] = np.add.reduceat(self.values[own[r, c]] * weights[c][:, None], first, axis=0)
                k /= np.maximum(_norms(ids[g], weights), 1e-9)[:, None]
                m = k.max(axis=1) >= floor
                found.append(of[at + g[m]])
                rows.append(k[m])
        if not found:
            return np.zeros(0, np.int64), np.zeros((0, len(self.landmarks)), np.float32)
        at, k = np.concatenate(found), np.concatenate(rows)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]][: len(at)])
        return (at[first], np.maximum.reduceat(k, first, axis=0)) if len(at) else (at, k)


@dataclass
class Words:
    """What a worker keeps of words: 2 * row of kernel values + 1 if it ends a sentence."""

    kernel: Kernel
    floor: float
    known: dict[str, int] = field(default_factory=dict)
    rows: list[np.ndarray] = field(default_factory=list)
    MOST = 500_000

    def learn(self, words: set[str]) -> None:
        if len(self.known) > self.MOST:
            self.known.clear()
            self.rows.clear()
        new = [w for w in words if w not in self.known]
        at, k = self.kernel([unit(w) for w in new], self.floor)
        code = dict(zip(at.tolist(), range(len(self.rows) + 1, len(self.rows) + 1 + len(at)), strict=True))
        self.rows += list(k)
        for i, w in enumerate(new):
            self.known[w] = 4 * code.get(i, 0) + 2 * (len(w) == 1) + (w[-1] in ".!?")

    def sentences(self, text: str) -> np.ndarray:
        """Pooled kernel rows of the sentences that hold a word like a landmark."""
        words = text.lower().split()
        codes = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        sentence = np.cumsum(codes & 1) - (codes & 1)
        at = np.flatnonzero(codes > 3)
        number, k = sentence[at], [self.rows[i] for i in (codes[at] // 4 - 1).tolist()]
        single = codes & 2 > 0
        if len(words) > 3 and (run := single[:-3] & single[1:-2] & single[2:-1] & single[3:]).any():
            # letters set apart make a word of their own
            edge = np.diff(np.r_[False, single, False].astype(int))
            for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                if b - a > 3:
                    hit, row = self.kernel([unit("".join(words[a:b]))], self.floor)
                    if len(hit):
                        number, k = np.r_[number, sentence[a]], [*k, row[0]]
            order = np.argsort(number, kind="stable")
            number, k = number[order], [k[i] for i in order]
            del run
        if not k:
            return np.zeros((0, len(self.kernel.landmarks)), np.float32)
        return np.maximum.reduceat(np.array(k), np.flatnonzero(np.r_[True, number[1:] != number[:-1]]), axis=0)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@dataclass
class Model:
    kernel: Kernel | None
    floor: float
    weights: np.ndarray  # on pooled kernel values; the Nystroem map is folded in
    bias: float
    slope: float
    shift: float

    def margins(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.weights + self.bias

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def _unit_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document, its different units with the words around them."""
    for batch in _slices(batches):
        units, around, toxic = [], [], []
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = (text or "").lower().split()
            mine = {(u[:LONGEST], xxhash.xxh32_intdigest(f"{a} {b}")) for a, w, b in zip(["", *words], words, [*words[1:], ""], strict=False) if len(u := unit(w)) >= 3}
            units += [u for u, _ in mine]
            around += [x for _, x in mine]
            toxic += [label] * len(mine)
        yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array(around, pa.int64()), pa.array(toxic, pa.int32())], names=["unit", "around", "toxic"])


def _sentence_rows(batches: Iterator[pa.RecordBatch], kernel: Kernel, floor: float) -> Iterator[pa.RecordBatch]:
    words = Words(kernel, floor)
    for batch in _slices(batches):
        d, y, k, texts = [], [], [], [t or "" for t in batch.column("text").to_pylist()]
        words.learn({w for t in texts for w in t.lower().split()})
        for text, doc, label in zip(texts, batch.column("doc_id").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            rows = words.sentences(text)
            rows = rows if len(rows) else np.zeros((1, rows.shape[1]), np.float32)
            d += [doc] * len(rows)
            y += [label] * len(rows)
            k += [r.tobytes() for r in rows.astype(np.float32)]
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(y, pa.int32()), pa.array(k, pa.binary())], names=["doc_id", "toxic", "k"])


def linear_machine(x: np.ndarray, y: np.ndarray, cost: float = 1.0, steps: int = 30) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps; y is -1 or 1, classes weigh the same."""
    x = np.c_[x, np.ones(len(x))]
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * cost * 1000
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(steps):
        m = y * (x @ w) < 1
        xs, cs = x[m], c[m]
        new = np.linalg.solve(ridge + 2 * (xs * cs[:, None]).T @ xs, 2 * xs.T @ (cs * y[m]))
        if np.abs(new - w).max() < 1e-7:
            break
        w = 0.5 * w + 0.5 * new if _ > 8 else new
    return w


def choose_landmarks(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int, settings: Settings) -> list[str]:
    """Units that mark toxic documents, none close to one taken before.

    counts: contexts of a unit in toxic documents and in others; n_toxic, n_clean: of all.
    """
    share = n_toxic / max(1, n_toxic + n_clean)
    if not 0 < share < 1:
        return []

    def evidence(t: int, c: int) -> float:
        """Log-likelihood ratio of the word's own toxic share against that of all; signed."""
        n = t + c
        g = sum(2 * x * np.log(x / (n * p)) for x, p in ((t, share), (c, 1 - share)) if x)
        return float(g if t > n * share else -g)

    ranked = sorted(((evidence(t, c), u) for u, t, c in counts if evidence(t, c) >= settings.evidence and t > 2 * c * share / (1 - share)), reverse=True)
    taken: list[str] = []
    names = [u for _, u in ranked[: 4 * settings.landmarks]]
    if names:
        k = Kernel(names)
        at, near = k(names)
        gram = np.zeros((len(names), len(names)), np.float32)
        gram[at] = near
        free = np.ones(len(names), bool)
        for i in range(len(names)):
            if free[i] and len(taken) < settings.landmarks:
                taken.append(names[i])
                free &= gram[i] < 0.95
    return taken


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on ``labels`` (doc_id, toxic) and the texts of ``docs`` that they name.

    Null labels and ids, and ids without a text, are left out. Without rows of both
    labels, or without a word that marks toxic ones, the model finds every text clean.
    """
    none = Model(None, settings.floor, np.zeros(0), -1.0, 1.0, -4.0)
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    few = [known.filter(f"toxic = {y}").orderBy(*order).limit(settings.max_rows) for y in (1, 0)]
    chosen = few[0].unionByName(few[1])  # at most 2 * max_rows rows of two numbers
    sample = materialize(docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"), "sample")
    # copies of a document repeat a word's context, so that they count once
    units = sample.select("text", "toxic").mapInArrow(_unit_contexts, "unit string, around long, toxic int")
    by_unit = units.groupBy("unit", "around").agg(F.min("toxic").alias("toxic")).groupBy("unit").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    by_unit = materialize(by_unit, "units")
    n_toxic, n_clean = (int(x or 0) for x in by_unit.agg(F.sum("t"), F.sum("c")).first())
    marks = by_unit.filter("t >= 3").orderBy(F.desc(F.expr("sqrt(t) * ln((t + 0.5) / (c + 0.5))")), "unit").limit(40 * settings.landmarks)
    counts = {(r.unit, r.t, r.c) for r in marks.collect()}
    landmarks = choose_landmarks(sorted(counts), n_toxic, n_clean, settings)
    if not landmarks:
        return none
    kernel = Kernel(landmarks)
    rows = sample.mapInArrow(partial(_sentence_rows, kernel=kernel, floor=settings.floor), "doc_id long, toxic int, k binary").withColumn("o", F.xxhash64("doc_id", "k"))
    got = [r for y in (0, 1) for r in rows.filter(f"toxic = {y}").orderBy("o", "doc_id", "k").limit(settings.max_sentences).drop("o").collect()]
    y = np.array([r.toxic for r in got])
    if not (y == 1).any() or not (y == 0).any():
        return none
    d = np.array([r.doc_id for r in got])
    pooled = np.array([np.frombuffer(r.k, np.float32) for r in got], np.float64)
    at, gram = kernel(landmarks)
    assert len(at) == len(landmarks)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    nystroem = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    x = pooled @ nystroem
    side = np.where(y == 1, 1, -1)
    side[(y == 1) & (pooled.max(axis=1) == 0)] = -1
    docs_of = np.unique(d, return_inverse=True)[1]
    for _ in range(5):  # a toxic document has at least one toxic sentence, not only such
        w = linear_machine(x, side)
        margin = x @ w[:-1] + w[-1]
        best = np.full(docs_of.max() + 1, -np.inf)
        np.maximum.at(best, docs_of, margin)
        new = np.where((y == 1) & ((margin > 0) | (margin >= best[docs_of])) & (pooled.max(axis=1) > 0), 1, -1)
        if (new == side).all() or not (new == 1).any():
            break
        side = new
    label = np.zeros(len(best))
    np.maximum.at(label, docs_of, y)
    a, b = 2.0, 0.0
    z = np.clip(best, -5, 5)
    soft = np.where(label == 1, 1 - 1 / ((label == 1).sum() + 2), 1 / ((label == 0).sum() + 2))
    for _ in range(200):  # Platt's sigmoid, by gradient with unit curvature bounds
        p = 1 / (1 + np.exp(-(a * z + b)))
        v = np.maximum(p * (1 - p), 1e-3)
        g = np.array([((p - soft) * z).sum() + 1e-3 * a, (p - soft).sum()])
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - 0.5 * step[0], b - 0.5 * step[1]
        if np.abs(step).max() < 1e-6:
            break
    # the sample takes labels alike; the sigmoid is for the share of toxic ones among all
    every = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    b += np.log(every[1] / every[0]) - np.log((label == 1).sum() / (label == 0).sum())
    return Model(kernel, settings.floor, nystroem @ w[:-1], float(w[-1]), float(max(a, 1e-3)), float(b))


def _scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    words = Words(model.kernel, model.floor) if model.kernel else None
    for batch in _slices(batches):
        out, texts = [], [t or "" for t in batch.column("doc").field("text").to_pylist()]
        if words:
            words.learn({w for t in texts for w in t.lower().split()})
        for text in texts:
            rows = words.sentences(text) if words else ()
            out.append(model.probability(max(model.bias, float(model.margins(rows).max())) if len(rows) else model.bias))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc, score) for every row: ``doc`` is a struct of its own columns, whatever their names.

    Null and empty texts get the score of a text without a suspicious word.
    """
    packed = docs.select(F.struct("*").alias("doc"))  # the text moves once, within its row
    schema = T.StructType([*packed.schema.fields, T.StructField("score", T.DoubleType())])
    return packed.mapInArrow(partial(_scores, model=model), schema)


def held_out():
    """Rows that are never fitted on: crc32 of the doc_id's text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    model = fit(docs, labels)
    out = score(docs, model).select("doc.doc_id", "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= Settings().threshold).cast("int").alias("predicted"))
