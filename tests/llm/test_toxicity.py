import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from quarrysift.llm import toxicity as T


def slow_kernel(a, b):
    def features(w):
        out = {}
        for i in range(len(w)):
            for j in range(i + 1, min(i + 1 + T.GAP, len(w))):
                for k in range(j + 1, min(j + 1 + T.GAP, len(w))):
                    out[w[i], w[j], w[k]] = out.get((w[i], w[j], w[k]), 0) + T.DECAY ** (k - i + 1)
        return out

    x, y = features(a), features(b)
    norm = lambda f: sum(v * v for v in f.values()) ** 0.5
    return sum(v * y.get(t, 0) for t, v in x.items()) / max(norm(x) * norm(y), 1e-9)


def test_kernel_against_brute_force():
    marks = ["worthless", "banana", "scum"]
    words = ["worthless", "wortxhless", "worth", "ananas", "scumm", "banana", "smuc", "abc"]
    at, k = T.Kernel(marks)(words)
    full = np.zeros((len(words), 3))
    full[at] = k
    assert np.allclose(full, [[slow_kernel(w, m) for m in marks] for w in words], atol=1e-5)
    at, k = T.Kernel(marks)(words, 0.4)
    assert at.tolist() == [i for i in range(len(words)) if full[i].max() >= 0.4] and np.allclose(k, full[at])


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice(["ba", "ne", "ko", "li", "tu", "mar", "sen"]) for _ in range(rnd.randint(1, 4)))
    bad = ["grumblewitz", "fopdoodle", "scroundrel"]
    docs, labels = [], []
    for d in range(600):
        words = [word() + ("." if rnd.random() < 0.1 else "") for _ in range(rnd.randint(5, 80))]
        toxic = int(rnd.random() < 0.25)
        if toxic:
            for _ in range(2):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        docs.append((d, " ".join(words), "x", 0.5))
        labels.append((d, toxic))
    return docs, labels


def test_fit_and_score(spark, corpus):
    docs, labels = corpus
    extra = [(9001, None), (9002, ""), (9003, "ba ne fop.dood_le ko"), (9004, "ba ne f o p d o o d l e ko"), (9005, "grumbxlewitz " * 3), (None, "ba ne"), (9005, "x" * 5000)]
    df = spark.createDataFrame([*docs, *((*e, "x", 0.5) for e in extra)], "doc_id long, text string, doc string, score double")
    marks = spark.createDataFrame([*labels, (None, 1), (77777, 1), (5, None)], "doc_id long, toxic int").filter(~T.held_out())
    model = T.fit(df, marks)
    rows = T.score(df, model).select("doc.doc_id", T.held_out().alias("h"), F.col("score")).collect()
    assert len(rows) == len(docs) + len(extra) and all(0 <= r.score <= 1 for r in rows)
    known = dict(labels)
    held = [(known[r.doc_id], r.score >= 0.3) for r in rows if r.h and r.doc_id in known]
    assert len(held) > 100 and sum(a == b for a, b in held) / len(held) > 0.98
    by = {(r.doc_id, i): r.score for i, r in enumerate(rows)}
    got = {d: s for (d, _), s in by.items() if d in (9003, 9004, 9001, 9002)}
    assert got[9003] > 0.3 and got[9004] > 0.3 and got[9001] < 0.3 and got[9001] == got[9002]


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    model = T.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score < 0.3 for r in T.score(df, model).collect()] == [True, True]


def test_kernel_rows_are_worked_out_in_little_memory():
    import tracemalloc

    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(20))
    kernel, words = T.Kernel([word() for _ in range(160)]), [word() for _ in range(1500)]
    tracemalloc.start()
    kernel(words, 0.2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6
