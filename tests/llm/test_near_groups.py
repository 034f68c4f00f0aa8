"""Groups of very many near copies: few pairs and few edges, the whole result."""

import numpy as np
import pyarrow as pa

from quarrysift.llm import simhash as S


def test_dense_bucket_gives_a_forest():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (1, 4)).astype(np.uint64)
    for n in (40, 300):
        wide = base ^ (np.uint64(1) << rng.integers(0, 63, (n, 4)).astype(np.uint64))
        u, v, dense = S._bucket_pairs(np.arange(n), np.full(n, 100), wide, 80)
        assert dense and sorted(np.maximum(u, v).tolist()) == list(range(1, n))  # each but the first has one before it


def test_group_of_near_copies_joins_few_edges(spark, monkeypatch):
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(w if (i + j) % 97 else f"x{i}" for j, w in enumerate(words)) for i in range(80)]
    seen = []
    inner = S.components

    def counted(edges, *more):
        seen.append(edges.filter("u <> v").select("u", "v").distinct().count())
        return inner(edges, *more)

    monkeypatch.setattr(S, "components", counted)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = [r.doc_id for r in S.one_of_each(docs).collect()]

    def weighted(a, b):
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
        return 5 * len(x & y) >= 4 * len(x | y)

    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if weighted(texts[i], texts[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert sorted(kept) == sorted(set(root))
    assert max(seen) < 4 * len(texts)


def test_index_finds_all_pairs_of_wide_fingerprints():
    """The Gray-order index gives each pair in the radius once, within each bucket, and the buckets are searched by it."""
    rng = np.random.default_rng(8)
    n = 600
    bucket = np.sort(rng.integers(0, 40, n))
    base = rng.integers(0, 2**63, (60, 4)).astype(np.uint64) * np.uint64(2)
    wide = base[rng.integers(0, 60, n)]
    for _ in range(9):
        wide = wide ^ (np.uint64(1) << rng.integers(0, 64, (n, 4)).astype(np.uint64))
    apart = np.bitwise_count(wide[:, None] ^ wide[None]).sum(axis=2)
    for radius in (0, 40, 80, 256):
        got = [(min(i, j), max(i, j), d) for part in S.GrayIndex(bucket, wide).pairs(radius) for i, j, d in zip(*(x.tolist() for x in part), strict=True)]
        want = [(i, j, int(apart[i, j])) for i in range(n) for j in range(i + 1, n) if bucket[i] == bucket[j] and apart[i, j] <= radius]
        assert sorted(got) == want


def test_buckets_are_searched_by_the_index(monkeypatch):
    calls, inner = [], S.GrayIndex.pairs
    monkeypatch.setattr(S.GrayIndex, "pairs", lambda self, radius: calls.append(len(self.fps)) or inner(self, radius))
    bucket = np.array([1, 2, 2, 5, 5, 5, 5, 9])
    wide = np.zeros((8, 4), np.int64)
    wide[4] = -1
    names = ["bucket", "node", "size", "f0", "f1", "f2", "f3"]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket, np.arange(8), np.array([9, 9, 9, 9, 9, 9, 3, 9]), *wide.T)], names=names)
    got = pa.Table.from_batches(S._pair_batches(iter([batch]), 80)).to_pylist()
    assert calls == [6]  # one index for all buckets of several rows
    assert sorted((r["bucket"], r["u"], r["v"]) for r in got) == [(2, 2, 1), (5, 5, 3)] and not any(r["dense"] for r in got)
