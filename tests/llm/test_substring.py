import random

import pytest
from quarrysift.llm import substring as S
from pyspark.sql import functions as F


def split(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def slow(rows, width):
    first = {}
    for d, t in rows:
        w = split(t or "")
        for i in range(len(w) - width + 1):
            if d is not None:
                k = tuple(w[i : i + width])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = split(t or "")
        gone = set()
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i : i + width])] < d:
                gone |= set(range(i, i + width))
        out.append((d, len(w), len(gone), S.kept_digest(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=str)


def fast(spark, rows, width, indexed=S.INDEXED):
    df = spark.createDataFrame([(*r, "l", 1, 2) for r in rows], "doc_id long, text string, g string, x long, factors int")
    got = S.remove_repeats(df, width, indexed).select("doc.*", "n_words", "n_removed", F.sha2("kept", 256).alias("k"))
    assert got.columns == ["doc_id", "text", "g", "x", "factors", "n_words", "n_removed", "k"]
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.k) for r in got.collect()], key=str)


@pytest.mark.parametrize("width,vocabulary", [(50, 2000), (50, 3), (12, 200)])
def test_against_brute_force(spark, width, vocabulary):
    rnd = random.Random(width)
    word = lambda n: [f"é{rnd.randrange(vocabulary)}" for _ in range(n)]
    passages = [word(n) for n in (width - 1, width, width + 1, 3 * width, 5 * width)]
    rows = []
    for d in range(60):
        t = word(rnd.randrange(0, 3 * width))
        for _ in range(rnd.randrange(3)):
            p = list(rnd.choice(passages))
            if rnd.random() < 0.5:
                p[rnd.randrange(len(p))] = "other"
            cut = rnd.randrange(len(t) + 1)
            t = t[:cut] + p + t[cut:]
        rows.append((rnd.randrange(10_000), rnd.choice([" ", "\n", " \t"]).join(t)))
    rows += [(r[0] + 5, r[1]) for r in rows[:10]] + rows[20:24] + [(rows[0][0], "x " + rows[1][1]), (None, rows[0][1]), (1, None), (2, ""), (None, None)]
    want = slow(rows, width)
    assert fast(spark, rows, width) == want
    assert fast(spark, rows, width, 2) == want  # anchors with more blocks than a task indexes


def test_empty(spark):
    assert fast(spark, [(1, "a")], 50)[0][2] == 0
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_parse_takes_longest_factors_and_goes_on_at_their_ends():
    index = {}
    assert S.parse([1, 2, 3, 4, 5, 6], 10, index) == []
    assert S.parse([9, 2, 3, 4, 8, 5, 6, 7], 20, index) == [(1, 3), (5, 2)]
    assert S.parse([9, 2, 3], 20, index) == [(1, 2)]  # its own document's blocks are not earlier
    assert S.parse([8, 5, 6, 7, 2], 30, index) == [(0, 4), (4, 1)]  # along the second block


def test_parse_against_all_windows():
    rnd = random.Random(1)
    for _ in range(200):
        index, seen = {}, {}
        for doc in sorted(rnd.randrange(4) for _ in range(6)):
            block = [rnd.randrange(12) for _ in range(rnd.randrange(1, 15))]
            found = {a + i for a, n in S.parse(block, doc, index) for i in range(n)}
            assert found == {i for i, w in enumerate(block) if seen.get(w, doc) < doc}
            for w in block:
                seen.setdefault(w, doc)


def test_many_equal_rows(spark):
    """Ten thousand equal rows are parsed once: a block of theirs is in the index once, and all rows lose the same."""
    rnd = random.Random(9)
    word = lambda n: [f"w{rnd.randrange(3000)}" for _ in range(n)]
    passage = word(120)
    early = (1, " ".join(word(100) + passage + word(100)))
    late = (2, " ".join(word(60) + passage[:70] + ["changed"] + passage[70:] + word(60)))
    want = {r[0]: r for r in slow([early, late], 50)}
    assert want[2][2] >= 50
    df = spark.createDataFrame([early], "doc_id long, text string").union(spark.range(10_000).select(F.lit(2).cast("long"), F.lit(late[1])))
    got = S.remove_repeats(df).groupBy("doc.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("k")).count().collect()
    assert {tuple(r) for r in got} == {(*want[1], 1), (*want[2], 10_000)}
