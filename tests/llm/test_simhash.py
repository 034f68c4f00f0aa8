from collections import Counter

import numpy as np
import pytest
import xxhash
from quarrysift.llm import simhash as S

DDL = "doc_id long, text string, lang string, fp string"


def slow_fingerprint(text, k=3):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_classes(fps, radius):
    comp = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and comp[i] != comp[j]:
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return comp


@pytest.mark.parametrize("text", ["", None, " \n\t", "One", "one TWO", "a b c", "É Ä b c d\x0be", "x y z " * 50])
def test_fingerprint(text):
    assert S.fingerprint(None if text is None else text.encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("seed", range(4))
def test_index_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    near = [base]
    for k in range(60):
        f = base[rng.integers(0, 30, 20)].copy()
        for _ in range(rng.integers(0, 5)):
            f ^= np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64)
        near.append(f)
    fps = np.unique(np.concatenate(near))
    rng.shuffle(fps)
    got = S.GrayIndex(np.zeros(len(fps), np.int64), fps).classes(3)
    want = slow_classes([int(x) for x in fps], 3)
    groups = lambda c: {frozenset(i for i in range(len(c)) if c[i] == r) for r in set(c)}
    assert groups(list(got)) == groups(want)


@pytest.mark.parametrize("hot", [S.HOT_BUCKET, 3])
def test_classes_against_brute_force(spark, hot):
    rng = np.random.default_rng(7)
    rows, words = [], ["w%d" % i for i in range(40)]
    for d in range(60):
        text = [words[i] for i in rng.integers(0, 40, 60)]
        for c in range(rng.integers(1, 5)):
            t = list(text)
            for _ in range(c % 3):
                t[rng.integers(0, 60)] = "Z"
            rows.append((1000 - len(rows), " ".join(t), "en", "x"))
    rows += [(None, "alone here now"), (5000, None), (5001, ""), (5002, " "), (7, "same same same"), (7, "same same same"), (None, None)]
    rows = [(*r, "en", "x")[:4] for r in rows]
    got = {(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in S.simhash_classes(spark.createDataFrame(rows, DDL), hot=hot).collect()}
    fps = [slow_fingerprint(r[1]) for r in rows]
    comp = slow_classes(fps, 3)
    ids = [r[0] for r in rows]
    want = {(ids[i], fps[i], min((ids[j] for j in range(len(rows)) if comp[j] == comp[i] and ids[j] is not None), default=None)) for i in range(len(rows))}
    assert got == want


def test_chain_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in S.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def test_empty(spark):
    assert S.simhash_classes(spark.createDataFrame([], DDL)).count() == 0


def test_one_of_each(spark):
    rng = np.random.default_rng(5)
    words = lambda n: [f"v{i}" for i in rng.integers(0, 3000, n)]
    rows, group = [], []
    for g in range(40):
        text = words(150)
        for c in range(4):
            t = list(text)
            if c == 1:
                t[40] = "edit"  # 5 of 146 shingles
            elif c == 2:
                t += words(6)
            rows.append((int(10_000 - 7 * len(rows)), " ".join(t)))
            group.append(g)
    for g in range(20):  # half in common: no near copy
        half = words(100)
        for _ in range(2):
            rows.append((20_000 + len(rows), " ".join(half + words(100))))
            group.append(1000 + len(rows))
    rows += [(50_000, None), (50_001, ""), (None, rows[0][1]), (rows[3][0], rows[3][1]), (60_000, "short text"), (60_001, "short text"), (60_002, "other text"), (None, "only null")]
    group += [2000, 2000, 0, 0, 2001, 2001, 2002, 2003]
    df = spark.createDataFrame([(*r, "l", 3) for r in rows], "doc_id long, text string, d string, c int")
    for hot in (S.HOT_BUCKET, 20):
        out = S.one_of_each(df, hot=hot)
        assert out.columns == df.columns
        want = {}
        for (d, t), g in zip(rows, group):
            want[g] = min(want.get(g, (9e9, "")), (9e8 if d is None else d, t or ""))
        assert sorted((9e8 if r.doc_id is None else r.doc_id, r.text or "") for r in out.collect()) == sorted(want.values())
    assert S.one_of_each(df.limit(0)).count() == 0


def weighted(a, b):
    grams = lambda t: Counter(zip(*(t.split()[i:] for i in range(5)), strict=False))
    a, b = grams(a), grams(b)
    return sum((a & b).values()) / sum((a | b).values())


def test_similarity_decides(spark):
    """Pairs just over 0.8 are linked, pairs under it are not."""
    rng = np.random.default_rng(3)
    words = lambda n: [f"x{i}" for i in rng.integers(0, 100_000, n)]
    rows, want = [], set()
    for g in range(120):
        a = words(94)  # 90 shingles
        b = a[: 84 - g % 3 * 2] + words(10 + g % 3 * 2)  # 80, 78, 76 shingles in common
        same = weighted(" ".join(a), " ".join(b)) >= 0.8
        assert same == (g % 3 == 0)
        rows += [(2 * g, " ".join(a)), (2 * g + 1, " ".join(b))]
        want |= {2 * g} if same else {2 * g, 2 * g + 1}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in S.one_of_each(df).collect()} == want


@pytest.mark.parametrize(("edits", "cell"), [(4, S.CELL), (4, 15), (12, S.CELL), (12, 15)])
def test_dense_group(spark, edits, cell):
    """Many copies of one text, each with its own edits, against the closure of all similar pairs."""
    rng = np.random.default_rng(4)
    text, texts = [f"y{i}" for i in range(100)], []
    for c in range(80):
        t = list(text)
        for at in rng.choice(100, c % edits + 1, replace=False):
            t[at] = f"z{c}"
        texts.append(" ".join(t))
    comp = list(range(80))
    for i in range(80):
        for j in range(i):
            if weighted(texts[i], texts[j]) >= 0.8 and comp[i] != comp[j]:
                lo, hi = sorted((comp[i], comp[j]))
                comp = [lo if c == hi else c for c in comp]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in S.one_of_each(df, cell=cell).collect()} == set(comp)


def test_cell_links():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**62, 60)
    sets = [np.unique(np.r_[rng.choice(base, rng.integers(40, 60), replace=False), rng.integers(0, 2**62, rng.integers(0, 9))]) for _ in range(50)]
    size, flat, comp = np.array([len(x) for x in sets]), np.concatenate(sets).astype(np.int64), np.arange(50) // 2 * 7
    for chunk in (np.zeros(50, np.int64), np.arange(50) % 2):
        u, v = S.cell_links(size, flat, comp, chunk)
        want, got = {c: c for c in comp.tolist()}, {c: c for c in comp.tolist()}
        pairs = [(comp[i], comp[j]) for i in range(50) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) and (chunk.max() == 0 or chunk[i] != chunk[j])]
        for name, links in ((want, pairs), (got, zip(u.tolist(), v.tolist(), strict=True))):
            for x, y in links:
                lo, hi = sorted((name[x], name[y]))
                name.update({c: lo for c, r in name.items() if r == hi})
        assert want == got


def test_rows_that_share_an_id_and_a_text(spark):
    """Of rows alike but for another column the one of least hash stays, whatever the order."""
    rows = [(1, "a b c d e f", x) for x in ("p", "q", "r")] + [(2, "g h", "s")]
    got = [sorted(map(str, S.one_of_each(spark.createDataFrame(r, "doc_id long, text string, kept string")).collect())) for r in (rows, rows[::-1])]
    assert got[0] == got[1] and len(got[0]) == 2


def test_pairs_of_a_bucket_grow_with_its_rows():
    """A bucket of near copies gives a few pairs a row whatever its size; those left out are compared in cells."""
    for n in (12, 30, 60):
        wide = np.zeros((n, 4), np.uint64)
        wide[:, 0] = np.arange(n)
        u, v, dense = S._bucket_pairs(np.arange(n), np.full(n, 100), wide, 80)
        assert len(u) == len(v) <= 2 * S.DENSE * n and S.DENSE <= 4 and dense
