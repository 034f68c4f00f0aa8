import random

import duckdb
import numpy as np
import pyarrow as pa

from quarrysift.llm import ngram_join

SCHEMA = "doc_id long, text string, size long, c string"


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def slow(rows):
    sets = [(d, shingles(t)) for d, t, *_ in rows]
    comp = list(range(len(sets)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(sets)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, w, k):
    w = list(w)
    for _ in range(k):
        at = rng.randrange(len(w) + 1)
        w[at : at + rng.randint(0, 1)] = [f"x{rng.randrange(10**6)}"] * rng.randint(0, 1)
    return w


def test_near_copies_and_edges(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(40):  # pairs and chains about the threshold, of all sizes
        base = words(rng, rng.choice([3, 5, 8, 9, 13, 14, 18, 23, 30, 60, 200]))
        texts += [" ".join(edited(rng, base, k)) for k in (0, 0, 1, 2, 3, rng.randint(0, 8))]
    for n in (8, 9, 13, 14, 18, 19, 23, 24, 28, 29, 40):  # one word more or less at the end, so that sizes differ
        base = words(rng, n)
        texts += [" ".join(base[: n - k]) for k in range(6)]
    passage = words(rng, 60)
    texts += [" ".join(words(rng, 40) + passage + words(rng, 40)) for _ in range(50)]  # one passage, nothing else alike
    texts += ["A b C d", "a B c d", "a b c", "same words " * 300, "same words " * 299, " ".join(words(rng, 20_000)), "", " \n", None]
    rows = [(i, t, i % 3, "x") for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], (None, texts[5], 1, None), (None, None, None, None), (None, "only here and nowhere else at all", 0, "")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = slow(rows)
    assert got(ngram_join.jaccard_classes(df, most=2, chunk=5)) == want


def test_dense_groups(spark):
    """Copies of one text so far apart that few links exist, with common passages: lists of hundreds, several classes."""
    rng = random.Random(2)
    rows = []
    for g in range(3):
        base = words(rng, 120)
        rows += [" ".join(edited(rng, base, rng.randint(1, 6))) for _ in range(150)]
    rows = [(i, t, 0, "") for i, t in enumerate(rows)]
    want = slow(rows)
    assert 10 < len({c for *_, c in want}) < 400
    assert got(ngram_join.jaccard_classes(spark.createDataFrame(rows, SCHEMA))) == want


def test_lists_alone_and_subsets(spark, monkeypatch):
    """Lists alone give all links of small sets too; stars of subsets are links."""
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        base = words(rng, rng.randint(1, 18))
        rows += [" ".join(edited(rng, base, k)) for k in (0, 1, 1, 2)]
    rows = [(i, t, 0, "") for i, t in enumerate(rows)]
    want = slow(rows)
    monkeypatch.setattr(ngram_join, "boundary", lambda sizes: 0)
    assert got(ngram_join.jaccard_classes(spark.createDataFrame(rows, SCHEMA))) == want
    small = [r for r in rows if len(shingles(r[1])) <= 9]
    links = ngram_join.light_links(spark.createDataFrame([(i, [hash(x) for x in shingles(t)]) for i, t, *_ in small], "node long, few array<long>").filter("size(few) > 0")).collect()
    found = {frozenset((r.u, r.v)) for r in links}
    sets = {i: shingles(t) for i, t, *_ in small}
    assert all(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a, b in map(tuple, found)) and len(found) > 20


def test_boundary_follows_cost():
    assert ngram_join.subsets_of(4) == 1 and ngram_join.subsets_of(5) == 6 and ngram_join.subsets_of(10) == 56
    assert ngram_join.boundary({}) == ngram_join.LIGHT_MOST
    assert ngram_join.boundary({3: 5, 24: 1}) == 23
    assert ngram_join.boundary({4: 10, 9: 10, 14: 10, 20: 10}) == 13


def test_parity_never_exceeds_the_difference(spark):
    """Sets of all sizes, near the bounds at which the number of bits doubles too."""
    rng = np.random.default_rng(4)
    rows = []
    for n in [*rng.integers(1, 3000, 60), 511, 512, 513, 600, 1023, 1024, 1100, 2100]:
        e = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        gone = rng.integers(0, len(e) // 8 + 1)
        a, b = e[gone // 2 :], np.r_[e[: len(e) - gone], rng.integers(0, 2**64, gone // 3, dtype=np.uint64)]
        rows.append((len(a), len(b), ngram_join._parity(a).tolist(), ngram_join._parity(b).tolist(), 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b))))
        x, y = (ngram_join._folded(ngram_join._parity(z), ngram_join.WORDS).view(np.uint64) for z in (a, b))
        assert sum(int(np.bitwise_count(v)) for v in x ^ y) <= len(np.setxor1d(a, b))
    far = [(len(z), len(z), ngram_join._parity(z).tolist(), ngram_join._parity(y).tolist(), False) for n in (600, 5000, 40_000) for z, y in [rng.integers(0, 2**64, (2, n), dtype=np.uint64)]]
    df = spark.createDataFrame(rows + far, "sa long, sb long, a array<long>, b array<long>, link boolean")
    got = df.select("link", "sa", ngram_join._may_link("sa", "sb", "a", "b").alias("may")).collect()
    assert all(r.may for r in got if r.link) and sum(r.link for r in got) > 30
    assert not any(r.may for r in got[len(rows) :])


def test_empty(spark):
    assert ngram_join.jaccard_classes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_and_sql(spark, tmp_path):
    rng = random.Random(6)
    base = words(rng, 50)
    rows = [(i, " ".join(edited(rng, base, rng.randint(0, 5)))) for i in range(40)] + [(50, None), (51, "a b"), (52, "A b"), (53, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = ngram_join.op13_ngram_join(spark, str(tmp_path))
    want = slow(rows)
    assert out.columns == ["doc_id", "n_shingles", "component_id"] and got(out) == want
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(ngram_join.OP13_SQL).fetchall(), key=str) == want


def test_long_lists_are_sieved(spark):
    """Lists of over four texts go through both kinds of cells."""
    rng = random.Random(8)
    base, passage = words(rng, 100), words(rng, 30)
    rows = [(i, " ".join(edited(rng, base, rng.randint(1, 7))), 0, "") for i in range(70)] + [(100 + i, " ".join(words(rng, 8) + passage), 0, "") for i in range(30)]
    assert got(ngram_join.jaccard_classes(spark.createDataFrame(rows, SCHEMA), most=4, chunk=9)) == slow(rows)


def test_words_are_hashed_together(monkeypatch):
    """Hashes of a word, or of a set, differ with it alone, and no call is made for each word."""
    rng = random.Random(5)
    odd = [None, "", " \t\n", "a", "a b c d", "\x0b a\x0cb\r\n", "x" * 8, "x" * 9, "x" * 16 + " " + "x" * 17, "y" * 200 + " " + "y" * 201, "A é b É", "a\x00 a\x00\x00 a b"]
    texts = odd + [" ".join(f"{rng.choice('abc') * rng.randint(1, 30)}{rng.randint(0, 999)}" for _ in range(rng.randint(1, 60))) for _ in range(300)]
    calls, plain = [], ngram_join.xxhash.xxh64_intdigest
    monkeypatch.setattr(ngram_join.xxhash, "xxh64_intdigest", lambda *a, **k: calls.append(1) or plain(*a, **k))
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array(texts)], names=["doc_id", "c", "text"])
    (got,) = ngram_join._set_batches(iter([batch]), 5, np.zeros(1 << ngram_join.SLOT_BITS, np.uint8))
    assert len(calls) <= n + 2
    want = [shingles(t) for t in texts]
    assert got.column("size").to_pylist() == [len(s) for s in want]
    by = dict(zip(want, got.column("node").to_pylist(), strict=True))
    assert got.column("node").to_pylist() == [by[s] for s in want] and len(set(by.values())) == len(by)
    for part in (1, 64):
        monkeypatch.setattr(ngram_join, "PART", part)
        (again,) = ngram_join._set_batches(iter([batch]), 5, np.zeros(1 << ngram_join.SLOT_BITS, np.uint8))
        assert again.equals(got)


def test_lists_chained_by_passages_are_not_one_group(spark, monkeypatch, tmp_path):
    """Each passage is in the texts of two neighbours, so that their lists reach from the first text to the last."""
    rng = random.Random(9)
    passages = [words(rng, 20) for _ in range(60)]
    rows = [(6 * i + k, " ".join([*a, f"own{6 * i + k}", *b]), 0, "") for i, (a, b) in enumerate(zip(passages, passages[1:], strict=False)) for k in range(6)]
    rows += [(1000 + i, rows[12 * i][1] + " more", 0, "") for i in range(20)]
    inner, folder = ngram_join._cell_batches, str(tmp_path)

    def counted(batches):
        import uuid

        batches = list(batches)
        sizes: dict = {}
        for c in (c for b in batches for c in b.column("cell").to_pylist()):
            sizes[c] = sizes.get(c, 0) + 1
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(sum(n * n for n in sizes.values())))
        yield from inner(iter(batches))

    monkeypatch.setattr(ngram_join, "_cell_batches", counted)
    monkeypatch.setattr(ngram_join, "boundary", lambda sizes: 0)
    assert got(ngram_join.jaccard_classes(spark.createDataFrame(rows, SCHEMA), most=4)) == slow(rows)
    pairs = sum(int(f.read_text()) for f in tmp_path.iterdir())
    assert 0 < pairs < len(rows) ** 2 // 8, pairs


def test_cell_compares_each_pair_once():
    """A spanning forest over the classes, for sizes of one, two and four times the bits, minor texts or not."""
    rng = np.random.default_rng(10)
    sets = []
    for n in (20, 500, 530, 1000, 1050):
        base = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for _ in range(12):
            gone = rng.random(len(base)) < rng.choice([0.02, 0.09, 0.15])
            sets.append(np.sort(np.r_[base[~gone], rng.integers(0, 2**64, int(gone.sum()) // 2, dtype=np.uint64)]))
    size = np.array([len(e) for e in sets])
    bits = [ngram_join._parity(e).view(np.uint64) for e in sets]
    node = np.arange(len(sets)) * 7
    comp = np.where(rng.random(len(sets)) < 0.3, 1000, node)
    minor = np.flatnonzero(comp != 1000)

    def classes(pairs, name):
        root = {int(x): int(x) for x in name}
        for a, b in pairs:
            a, b = root[int(a)], root[int(b)]
            root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
        return root

    alike = [(comp[i], comp[j]) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= ngram_join.needed(size[i], size[j])]
    found = ngram_join.cell_links(node, comp, size, bits, minor, sets)
    assert classes(found, set(comp)) == classes(alike, set(comp)) and len(found) > 10
    sieved = classes(ngram_join.cell_links(node, comp, size, bits, minor, None), node)
    assert all(sieved[node[i]] == sieved[node[j]] for i in range(len(sets)) for j in range(i) if comp[i] != comp[j] and len(np.intersect1d(sets[i], sets[j])) >= ngram_join.needed(size[i], size[j]))
