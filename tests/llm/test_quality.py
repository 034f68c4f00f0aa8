import itertools
import random
import re

import numpy as np
import pytest
from quarrysift.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_base(text):
    text = text or ""
    words, lines = WORD.findall(text), text.split("\n")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def good_line(rnd):
    return " ".join(rnd.choice(["the", "house", "stands", "near", "a", "river", "été", "where", "boats", "pass"]) for _ in range(rnd.randint(6, 14))).capitalize() + "."


def bad_line(rnd):
    return rnd.choice([" | ".join(["Home", "About", "Contact", str(rnd.random())]), "BUY NOW!! CHEAP!! " + "WOW!! " * rnd.randint(1, 5), "x%%% y&&& z### " * 3])


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(2)
    docs, labels = [], []
    for d in range(300):
        bad = d % 3 == 0
        lines = [good_line(rnd) for _ in range(rnd.randint(2, 6))]
        if bad:
            lines = lines[:2] + [bad_line(rnd) for _ in range(rnd.randint(4, 9))]
        docs.append((d, "\n".join(lines)))
        labels.append((d, int(not bad)))
    return docs, labels


def test_base_counts_and_verdicts(spark, corpus):
    docs, labels = corpus
    rnd = random.Random(9)
    extra = [None, "", " \n\t", "a b c", "é ü ß\x0bx\x0cy\rz |<>#", "a a a a a a a a a a a a", "x y\n\nx y\nx  y\nx y", "w " * 3000 + "\n" * 50]
    extra += [" ".join(rnd.choice("abcd") + rnd.choice(["", "\n"]) for _ in range(rnd.randrange(80))) for _ in range(60)]
    rows = docs + [(1000 + i, t) for i, t in enumerate(extra)] + [(None, "n " * 20)]
    df = spark.createDataFrame([(*r, True, "k") for r in rows], "doc_id long, text string, kept boolean, doc string")
    marks = spark.createDataFrame([*labels, (None, 0), (4, None), (88888, 0)], "doc_id long, quality int")
    field = Q.fit(df, marks)
    got = Q.judge(df, field).selectExpr("doc.doc_id", "doc.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share").collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[2:8]) == slow_base(r.text), r
        assert not (r.base_failed and r.kept)
    known = dict(labels)
    judged = [(known[r.doc_id], int(r.content_share >= field.least_share)) for r in got if r.doc_id in known]
    assert np.mean([a == b for a, b in judged]) > 0.97


def test_viterbi_and_marginals_against_all_labellings():
    rng = np.random.default_rng(0)
    field = Q.Field(rng.normal(size=3), rng.normal(size=(2, 2)), 0.5)
    lengths = np.array([4, 0, 1, 6])
    x = rng.normal(size=(lengths.sum(), 3))
    labels, (mean, pairs) = field.decode(x, lengths), field.expectations(x, lengths)
    at, want_pairs = 0, np.zeros((2, 2))
    for n in lengths:
        u = x[at : at + n] @ field.weights
        score = {y: sum(u[i] * y[i] for i in range(n)) + sum(field.pair[a, b] for a, b in itertools.pairwise(y)) for y in itertools.product((0, 1), repeat=int(n))}
        z = np.logaddexp.reduce(list(score.values()))
        assert tuple(labels[at : at + n]) == max(score, key=score.get)
        for i in range(n):
            assert np.isclose(mean[at + i], sum(np.exp(s - z) for y, s in score.items() if y[i]))
        for y, s in score.items():
            for a, b in itertools.pairwise(y):
                want_pairs[a, b] += np.exp(s - z)
        at += n
    assert np.allclose(pairs, want_pairs)


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "doc_id long, text string")
    field = Q.fit(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert Q.judge(df, field).first().kept
    assert Q.judge(df.limit(0), field).count() == 0
