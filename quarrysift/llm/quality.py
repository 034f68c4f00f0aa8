"""Quality by line: a linear-chain conditional random field marks content or boilerplate.

Each line of a text gets features; the field's weights score a line as boilerplate and a
pair of neighbours as alike or not, and Viterbi decoding gives the best labels of all lines
together. A text is kept if enough of its words stand in content lines.

The field is fitted on a bounded sample of labelled documents. Lines of good documents are
content; lines of bad ones start as boilerplate and are decoded again with each round (hard
expectation-maximisation), so that the good lines of bad documents change sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = b" \t\n\x0b\x0c\r"
_TAILS = bytes(range(0x80, 0xC0))
_SYMBOLS, _UPPER, _LETTERS, _DIGITS = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0x80, 0x100)), b"0123456789"
N_FEATURES = 14


@dataclass(frozen=True)
class Settings:
    max_rows: int = 1500  # labelled documents of each label that are fitted on
    rounds: int = 4
    min_words: int = 10
    most_repeated: int = 20  # percent of words in repeated 5-word windows


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words covered by windows of ``width`` words that occur twice or more in the list."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    key, size = ids, len(known)
    for k in range(1, width):  # exact ranks of windows of k + 1 words
        if size > 1 and size * len(known) >= 1 << 62:
            size = (key := np.unique(key, return_inverse=True)[1]).max() + 1
        key = key[: len(words) - k] * len(known) + ids[k:]
        size *= len(known)
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    edge[at] += 1
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _share(line: bytes, kind: bytes, n: int) -> float:
    return (len(line) - len(line.translate(None, kind))) / n


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Features and word counts of the lines that hold a word, and how many repeat an earlier line."""
    rows, sizes, seen, repeats = [], [], set(), 0
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        again = line in seen
        repeats += again
        seen.add(line)
        n, k = len(words), len(line)
        body = line.translate(None, _SPACE)
        m = len(body)
        letters = m - len(body.translate(None, _LETTERS))
        own = len(set(words))
        last = body[-1:]
        rows.append((
            1.0, min(n, 60) / 60, _share(body, _SYMBOLS, m), _share(body, _UPPER, max(1, letters)), min(1.0, 4 * _share(body, b"!", m)), _share(body, _DIGITS, m), (n - own) / n,
            min(1.0, sum(map(bytes.__eq__, words, words[1:])) / n), min(1.0, 2 * words.count(b"|") / n), float(last in (b".", b"!", b"?")), float(again), min(m / n, 20) / 20, 1 - letters / m, float(n < 4),
        ))
        sizes.append(n)
    return np.array(rows, np.float64).reshape(-1, N_FEATURES), np.array(sizes, np.int64), repeats


@dataclass
class Field:
    """weights: score of boilerplate over content; pair: score of two neighbours' labels."""

    weights: np.ndarray
    pair: np.ndarray
    least_share: float

    @staticmethod
    def _steps(lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Line numbers of all sequences' t-th lines, sequences in order of falling length."""
        order = np.argsort(-lengths, kind="stable")
        first = (np.cumsum(lengths) - lengths)[order]
        n = lengths[order]
        for t in range(int(lengths.max(initial=0))):
            yield t, first[: int(np.searchsorted(-n, -t, side="left"))] + t

    def decode(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Viterbi labels (1: boilerplate) of the lines of sequences laid end to end."""
        unary = np.c_[np.zeros(len(x)), x @ self.weights]
        back = np.zeros((len(x), 2), np.int8)
        best = np.zeros((len(x), 2))
        steps = list(self._steps(lengths))
        for t, at in steps:
            if t == 0:
                best[at] = unary[at]
                continue
            s = best[at - 1][:, :, None] + self.pair[None]
            back[at] = s.argmax(axis=1)
            best[at] = s.max(axis=1) + unary[at]
        out = np.zeros(len(x), np.int8)
        ends = np.cumsum(lengths)[lengths > 0] - 1
        out[ends] = best[ends].argmax(axis=1)
        for t, at in reversed(steps):
            if t:
                out[at - 1] = back[at, out[at]]
        return out

    def expectations(self, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of boilerplate of each line, and expected pair counts (forward-backward)."""
        unary = np.c_[np.zeros(len(x)), x @ self.weights]
        steps, n = list(self._steps(lengths)), len(x)
        fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
        for t, at in steps:
            fwd[at] = unary[at] + (np.logaddexp.reduce(fwd[at - 1][:, :, None] + self.pair, axis=1) if t else 0)
        for t, at in reversed(steps):
            if t:
                bwd[at - 1] = np.logaddexp.reduce(self.pair + (unary[at] + bwd[at])[:, None, :], axis=2)
        both = fwd + bwd
        z = np.logaddexp.reduce(both, axis=1)
        later = np.ones(n, bool)
        later[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
        at = np.flatnonzero(later)
        pairs = np.exp(fwd[at - 1][:, :, None] + self.pair + (unary[at] + bwd[at])[:, None, :] - z[at][:, None, None]).sum(axis=0)
        return np.exp(both[:, 1] - z), pairs


def train(x: np.ndarray, lengths: np.ndarray, labels: np.ndarray, start: Field | None = None, steps: int = 60) -> Field:
    """Field of largest penalised likelihood of the labels, by gradient ascent with momentum."""
    field = start or Field(np.zeros(x.shape[1]), np.zeros((2, 2)), 0.5)
    w, p = field.weights.copy(), field.pair.copy()
    later = np.ones(len(x), bool)
    later[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    at = np.flatnonzero(later)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[at - 1], labels[at]), 1)
    n, vw, vp, sw, sp = max(1, len(x)), np.zeros_like(w), np.zeros_like(p), np.zeros_like(w), np.zeros_like(p)
    for k in range(1, steps + 1):
        mean, pairs = Field(w, p, 0.5).expectations(x, lengths)
        gw = (labels - mean) @ x / n - 1e-4 * w
        gp = (seen - pairs) / n - 1e-4 * p
        vw, vp = 0.9 * vw + 0.1 * gw, 0.9 * vp + 0.1 * gp
        sw, sp = 0.99 * sw + 0.01 * gw * gw, 0.99 * sp + 0.01 * gp * gp
        rate = 0.4 * (1 - 0.9**k) ** -1 * (1 - 0.99**k) ** 0.5
        w, p = w + rate * vw / (np.sqrt(sw) + 1e-6), p + rate * vp / (np.sqrt(sp) + 1e-6)
    return Field(w, p, field.least_share)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [line_features(t or b"") for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array([x.astype(np.float32).tobytes() for x, _, _ in texts], pa.binary()), pa.array([n.tobytes() for _, n, _ in texts], pa.binary())], names=["quality", "x", "n"])


def content_shares(field: Field, x: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of words in content lines of each sequence (1 where it has none), and the labels."""
    labels = field.decode(x, lengths)
    of = np.repeat(np.arange(len(lengths)), lengths)
    every = np.bincount(of, sizes, len(lengths))
    good = np.bincount(of, sizes * (labels == 0), len(lengths))
    return np.where(every > 0, good / np.maximum(every, 1), 1.0), labels


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Field:
    """Fit on ``labels`` (doc_id, quality 0 or 1) and the texts of ``docs`` that they name.

    The sample is ``max_rows`` rows of each label in order of a hash of doc_id. Without rows
    of both labels the field marks every line as content.
    """
    none = Field(np.r_[-5.0, np.zeros(N_FEATURES - 1)], np.zeros((2, 2)), 0.5)
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    few = [known.filter(f"quality = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_rows) for y in (1, 0)]
    chosen = few[0].unionByName(few[1])  # at most 2 * max_rows rows of two numbers
    sample = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("text", "quality")
    got = sorted(sample.mapInArrow(_feature_batches, "quality int, x binary, n binary").collect(), key=lambda r: (r.quality, bytes(r.x)))
    got = [r for r in got if len(r.n)]
    good = np.array([r.quality == 1 for r in got])
    if not good.any() or good.all():
        return none
    x = np.concatenate([np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES) for r in got]).astype(np.float64)
    sizes = np.concatenate([np.frombuffer(r.n, np.int64) for r in got])
    lengths = np.array([len(r.n) // 8 for r in got])
    bad = np.repeat(~good, lengths)
    side, field = bad.astype(np.int8), None
    for _ in range(settings.rounds):
        field = train(x, lengths, side, field)
        new = np.where(bad, field.decode(x, lengths), 0).astype(np.int8)
        if (new == side).all() or not new.any():
            break
        side = new
    shares, _ = content_shares(field, x, sizes, lengths)
    cuts = np.unique(np.r_[0.05, np.round(shares, 3), 0.95])
    scores = [(shares[good] >= c).mean() + (shares[~good] < c).mean() for c in cuts]
    best = np.flatnonzero(np.isclose(scores, max(scores)))
    field.least_share = float((cuts[best[0]] + cuts[max(0, best[0] - 1)]) / 2) if best[0] else float(cuts[0])
    return field


def _rule_batches(batches: Iterator[pa.RecordBatch], field: Field, settings: Settings) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, 128):
            batch = whole.slice(lo, 128)
            out, xs, sizes = [], [], []
            for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                text = text or b""
                words = text.split()
                x, n, repeats = line_features(text)
                xs.append(x)
                sizes.append(n)
                chars = len(text.translate(None, _SPACE + _TAILS))
                again = repeated_words(words)
                failed = len(words) < settings.min_words or 100 * again > settings.most_repeated * len(words)
                out.append((len(words), chars, len(text) - len(text.translate(None, _SYMBOLS)), repeats, again, failed))
            lengths = np.array([len(n) for n in sizes])
            shares, labels = content_shares(field, np.concatenate(xs), np.concatenate(sizes), lengths)
            marks = np.split(labels, np.cumsum(lengths)[:-1])
            cols = list(zip(*out, strict=True))
            kept = [not f and s >= field.least_share for f, s in zip(cols[5], shares, strict=True)]
            arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(cols[5], pa.bool_()), pa.array(kept, pa.bool_()), pa.array(shares, pa.float64()), pa.array([(m == 0).tolist() for m in marks], pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *arrays], names=["doc", *NEW])


NEW = {"n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(), "n_dup_lines": T.LongType(), "n_repeat_words": T.LongType(), "base_failed": T.BooleanType(), "kept": T.BooleanType(), "content_share": T.DoubleType(), "content_lines": T.ArrayType(T.BooleanType())}


def judge(docs: DataFrame, field: Field, settings: Settings = Settings()) -> DataFrame:
    """(doc, counts, base_failed, kept, content_share, content_lines) for every row.

    ``doc`` is a struct of the row's own columns; ``content_lines`` has an entry for each
    line that holds a word. Null texts count as empty; texts of fewer than ``min_words``
    words fail the base rules, as do those with many repeated 5-word windows.
    """
    packed = docs.select(F.struct("*").alias("doc")).select("doc", F.col("doc.text").alias("text"))
    schema = T.StructType([packed.schema["doc"], *(T.StructField(n, t) for n, t in NEW.items())])
    return packed.mapInArrow(partial(_rule_batches, field=field, settings=settings), schema)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Base counts, base_failed, kept and content_share of every row of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    field = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, field).select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")
