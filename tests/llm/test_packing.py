import random
import zlib

import numpy as np
import pytest
from quarrysift.llm import packing as P
from quarrysift.llm.tokens import vocabulary
from tokenizers import Tokenizer

PATH = vocabulary("byte_bpe_50k.json")


def test_encoder_against_library():
    rnd = random.Random(1)
    t = Tokenizer.from_file(PATH)
    bits = [" ", "  ", "\n", "\t", "a", "Word", "don't", "'s", ".", "12", "é", "日本", " ", "　", "\x1c", "\x85", "<|endoftext|>", "<|endo", "!!", "\r\n", "x y", "​", "½"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(30))) for _ in range(3000)] + ["", " ", "  ", "\n ", " a", "a ", "z" * 9000]
    got = list(P.Encoder(PATH).batch(texts))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.choice([1, 2, 7, 64, 300]))
    counts = rng.integers(0, [1, 3, 50][seed % 3] + 1, size + 1)
    counts[0] = 0
    patterns = P.plan(counts, size)
    used = np.zeros(size + 1, int)
    for lengths, times in patterns:
        assert sum(lengths) <= size and times > 0
        for n in lengths:
            used[n] += times
    assert (used == counts).all()
    places, spans = P.Places(patterns), {}
    for n in np.flatnonzero(counts):
        s, o = places(np.full(counts[n], n), np.arange(counts[n]))
        for a, b in zip(s.tolist(), o.tolist(), strict=True):
            spans.setdefault(a, []).append((b, int(n)))
    for v in spans.values():
        at = 0
        for b, n in sorted(v):
            assert b == at
            at += n
        assert at <= size
    least = max(counts @ np.arange(size + 1) / size, counts[size // 2 + 1 :].sum())
    assert sum(t for _, t in patterns) <= 1.05 * least + 2


def test_documents(spark):
    rnd = random.Random(4)
    texts = [None, "", "one", "a b " * 3000, "x " * 2047, "x " * 2046 + "x"] + [" ".join(rnd.choice(["tree", "house", "of"]) for _ in range(rnd.randrange(3000))) for _ in range(60)]
    rows = [(i, t, "l", 5) for i, t in enumerate(texts)] + [(3, texts[3], "l", 5), (None, "null id", "l", 5)]
    out = P.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, piece string, length int")).collect()
    t = Tokenizer.from_file(PATH)
    want = []
    for d, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        n = len(ids)
        first = (n - 1) % 2048 + 1
        edges = [0, *range(first, n + 1, 2048)]
        want += [(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in out)
    spans = {}
    for r in out:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in spans.values():
        v.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(v, v[1:], strict=False)) and v[0][0] == 0 and sum(v[-1]) <= 2048
    assert len(spans) <= sum(w[3] for w in want) // 2048 + 2


def test_empty(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
