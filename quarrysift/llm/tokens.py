"""Token counts of whole texts, with a shortcut for words that are one token.

The vocabulary's model splits text at white space and then by a fixed pattern into
pre-tokens, and merges each pre-token on its own. A proof made once, on the driver before
any text is read (``whole_tokens``), encodes every vocabulary string alone and keeps those
that give one token; the list, no longer than the vocabulary, is sent to all tasks. Such
pre-tokens count one without any merging; only the rest go through the merges, each
different one once while a worker remembers it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

#: Spark deals out the cores; the library is not to start threads of its own.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pre-tokens of the vocabulary's own pattern, for texts in lower case.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
REMEMBERED = 400_000


def _latin(text: str) -> bool:
    """Whether a text is printable Latin-1."""
    return text.isprintable() and (text.isascii() or max(text) <= "ÿ")


def whole_tokens(tokenizer: Tokenizer, end: str = "</w>") -> frozenset[str]:
    """Vocabulary strings that the tokenizer encodes alone as one token.

    Only lower-case printable Latin-1 strings that are one pre-token are tried: Latin-1 has
    no combining marks, so such a text is its own normal form, and what holds alone holds
    within any text.
    """
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    words = sorted({v.removesuffix(end) for v in tokenizer.get_vocab() if v not in special})
    words = [w for w in words if w and _latin(w) and w == w.lower() and " " not in w and PRE_TOKENS.findall(w) == [w]]
    return frozenset(w for w, e in zip(words, tokenizer.encode_batch(words, add_special_tokens=False), strict=True) if len(e.ids) == 1)


class Counter:
    """Counts tokens by white-space-free chunk; a chunk's count does not depend on others."""

    def __init__(self, path: str, whole: frozenset[str] | None = None):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.whole = whole_tokens(self.tokenizer) if whole is None else whole
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.known: dict[bytes, int] = {}

    def learn(self, chunks: set[bytes]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        merges: list[str] = []
        waiting: list[tuple[bytes, int, int]] = []
        for chunk in chunks - self.known.keys():
            text = chunk.decode()
            if _latin(text) and not any(s in text for s in self.special):
                parts = PRE_TOKENS.findall(text.lower())
                rest = [p for p in parts if p not in self.whole]
            else:
                parts, rest = [text], [text]
            merges += rest
            waiting.append((chunk, len(parts) - len(rest), len(rest)))
        counts = iter([len(e.ids) for e in self.tokenizer.encode_batch(merges, add_special_tokens=False)])
        for chunk, single, rest in waiting:
            self.known[chunk] = single + sum(next(counts) for _ in range(rest))

    def count(self, chunks: list[bytes]) -> int:
        return sum(map(self.known.__getitem__, chunks))


#: A worker's counters by vocabulary: the next task goes on with what the last remembered.
_COUNTERS: dict[str, Counter] = {}


def _count_batches(batches: Iterator[pa.RecordBatch], path: str, whole) -> Iterator[pa.RecordBatch]:
    counter = _COUNTERS.get(path) or _COUNTERS.setdefault(path, Counter(path, whole.value))
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            texts = [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            chunks = [t.split() for t in texts]
            counter.learn(set().union(*chunks))
            size, tokens = [len(t) for t in texts], [counter.count(c) for c in chunks]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(size, pa.int64()), pa.array(tokens, pa.int64())], names=["doc", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc, n_bytes, n_tokens) for every row of ``docs``; ``doc`` is a struct of its columns.

    ``path``: a tokenizer file whose merges stay within white-space-free chunks. Null texts
    count as empty. Special strings in texts are taken as the library does by default.
    """
    packed = docs.select(F.struct("*").alias("doc")).select("doc", F.col("doc.text").alias("text"))
    schema = T.StructType([packed.schema["doc"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(Tokenizer.from_file(path)))
    return packed.mapInArrow(partial(_count_batches, path=path, whole=whole), schema)


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_token_counts(spark, sf_dir: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, vocabulary("word_bpe_49k.json")).select("doc.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
