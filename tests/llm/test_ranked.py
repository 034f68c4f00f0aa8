import math
import random
import re
from collections import Counter

import duckdb
import pytest

from quarrysift.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, most=10):
    """Every score of every document, by the formula."""
    sizes = [(d, Counter(split(t))) for d, t, *_ in docs]
    sizes = [(d, c, sum(c.values())) for d, c in sizes if c]
    big_n, big_l = len(sizes), sum(n for *_, n in sizes)
    df = Counter(t for _, c, _ in sizes for t in c)
    out = set()
    for item, text in items:
        scores = []
        for d, c, n in sizes:
            m = 25 + (75 * n * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in split(text) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out |= {(item, k, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scores)[:most], 1)}
    return out


def corpus(seed, n, words=40, length=30):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" if i % 3 else f"é{i}ß" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, length)))) for i in range(n)], vocabulary, rng


def got(df):
    rows = [(r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("shard", [8, 32, 512])
def test_tree_equals_scan(monkeypatch, shard):
    """One shard of several levels against all scores, floors included."""
    monkeypatch.setattr(ranked, "FANOUT", 8)
    monkeypatch.setattr(ranked, "SHARD", 512)
    docs, vocabulary, rng = corpus(shard, 400)
    lists, ids, numbers = [], [], ranked._Numbers()
    import numpy as np

    for i, t in docs[:shard]:
        if words := ranked.terms(t.encode()):
            ids.append(i)
            lists.append(np.array([numbers[w] for w in words]))
    total = sum(map(len, lists))
    rows = [r for r in ranked._shard_rows(0, ids, lists, numbers, (len(ids), total)).to_pylist() if r["term"] is not None]
    trees = ranked.Shard(rows, ids)
    for _ in range(30):
        wanted = [{"term": w, "weight": rng.randint(1, 50)} for w in rng.sample(vocabulary, 6)]
        scores = Counter()
        for r in rows:
            k = sum(w["weight"] for w in wanted if w["term"] == r["term"])
            for place, value in zip(np.frombuffer(r["places"], np.uint16), np.frombuffer(r["values"], np.int32), strict=True):
                scores[ids[place]] += k * int(value)
        want = sorted((-s, d) for d, s in scores.items() if s > 0)[:10]
        assert trees.search(wanted, 1, 10) == [(-s, d) for s, d in want]
        floor = -want[len(want) // 2][0] if want else 1
        assert trees.search(wanted, floor, 10) == [(-s, d) for s, d in want if -s >= floor]


def test_many_shards(spark, monkeypatch):
    """Several partitions and shards, ties, repeated rows, nulls, empty and long texts."""
    docs, vocabulary, rng = corpus(4, 3000)
    docs += [docs[5], docs[5], (None, "w1 w2 only"), (90_001, None), (90_002, ""), (90_003, " ,;\n"), (90_004, "w1 É " * 30_000), *((91_000 + i, "w2 w4 tie tie") for i in range(40))]
    docs = [(d, t, i, f"x{i}") for i, (d, t) in enumerate(docs)]
    items = [(i, " ".join(rng.choices(vocabulary, k=12))) for i in range(60)] + [(60, "tie"), (61, "nowhere"), (62, ""), (63, None), (None, "w1 W2, w2"), (3, "w4 w4"), (60, "tie")]
    index, n = ranked.build_index(spark.createDataFrame(docs, "doc_id long, text string, item long, terms string").repartition(3))
    frame = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, score int")
    want = slow(docs, items)
    assert got(ranked.search(index, n, frame)) == want
    assert [r for r in sorted(want, key=str) if r[0] == 60 and r[1] == 1] == [(60, 1, 91_000, max(x[3] for x in want if x[0] == 60))]
    monkeypatch.setattr(ranked, "BLOCK", 7)
    assert got(ranked.search(index, n, frame)) == want


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    item = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    index, n = ranked.build_index(none)
    assert ranked.search(index, n, item).collect() == []
    index, n = ranked.build_index(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    assert ranked.search(index, n, item.limit(0)).collect() == []


def test_query_and_sql(spark, tmp_path):
    docs, vocabulary, rng = corpus(9, 300)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(i, " ".join(rng.choices(vocabulary, k=9))) for i in range(20)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = slow(docs, items)
    assert got(ranked.op11_ranked_search(spark, str(tmp_path))) == want
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert set(con.sql(ranked.OP11_SQL).fetchall()) == want
