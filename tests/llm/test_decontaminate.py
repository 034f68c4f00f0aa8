import random
from collections import Counter

import pytest
from quarrysift.llm import decontaminate as D


def shingles(words, k):
    return Counter(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))


def slow(docs, items):
    out = set()
    for d, text in docs:
        words = (text or "").lower().split()
        for i, item in items:
            w = (item or "").lower().split()
            k = min(5, len(w))
            best = None
            for s in range(len(words) - len(w) + 1) if w else ():
                a, b = shingles(words[s : s + len(w)], k), shingles(w, k)
                x = sum((a & b).values()) / sum((a | b).values())
                if x >= 0.8 and (best is None or x > best[0]):
                    best = (x, s)
            if best:
                out.add((d, i, best[1], len(w), round(best[0], 9)))
    return out


@pytest.mark.parametrize("block", [D.BLOCK_ITEMS, 4])
def test_against_brute_force(spark, block):
    rnd = random.Random(11)
    word = lambda n, v=400: [f"w{rnd.randrange(v)}" for _ in range(n)]
    items = [(i, " ".join(word(rnd.choice([6, 20, 50, 90])))) for i in range(10)] + [(10, "one two three"), (11, ""), (12, None), (13, "a b c d e f a b c d e f a b c d e f")]
    items.append((14, items[3][1]))
    docs = []
    for d in range(60):
        t = word(rnd.randrange(120))
        for _ in range(rnd.randrange(3)):
            p = (rnd.choice(items)[1] or "x").split()
            for _ in range(rnd.randrange(3)):
                p[rnd.randrange(len(p))] = "EDIT"
            cut = rnd.randrange(len(t) + 1)
            t = t[:cut] + p + t[cut:]
        docs.append((d, rnd.choice([" ", "\n"]).join(t).upper()))
    docs += [(60, None), (61, ""), (62, "ONE two Three"), (None, items[1][1]), (63, (items[13][1] + " ") * 20)]
    a = spark.createDataFrame([(*r, 1, 2.0) for r in docs], "doc_id long, text string, item_id int, similarity double")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = [(r.doc_id, r.item_id, r.start_word, r.n_words, round(r.similarity, 9)) for r in D.benchmark_matches(a, b, block_items=block).collect()]
    assert len(got) == len(set(got)) and set(got) == slow(docs, items)


def test_empty(spark):
    a = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert D.benchmark_matches(a, b).count() == 0
    assert D.benchmark_matches(a.limit(0), a.selectExpr("doc_id item_id", "text")).count() == 0


def test_shorter_texts(spark):
    """Texts of fewer words than an item, against brute force."""
    rnd = random.Random(5)
    items = [(i, " ".join(f"w{rnd.randrange(60)}" for _ in range(n))) for i, n in enumerate([3, 4, 6, 9, 10, 15, 38, 59, 59])]
    docs = []
    for _, text in items:
        w = text.split()
        docs += [(len(docs) + k, " ".join(w[a : len(w) - b])) for k, (a, b) in enumerate([(0, 1), (1, 0), (0, 2), (1, 3), (4, 4), (0, len(w) // 2)])]
    want = set()
    for d, text in docs:
        for i, item in items:
            w, v = item.split(), text.split()
            if len(v) >= len(w):
                continue
            a, b = shingles(v, min(5, len(w))), shingles(w, min(5, len(w)))
            x = sum((a & b).values()) / sum((a | b).values())
            if x >= 0.8:
                want.add((d, i, 0, len(v), round(x, 9)))
    assert len(want) > 12
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.start_word, r.n_words, round(r.similarity, 9)) for r in D.benchmark_matches(a, b).collect()]
    assert len(got) == len(set(got)) and set(got) == want | slow(docs, items)
