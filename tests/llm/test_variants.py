import random
import re
import zlib
from collections import Counter

import pytest

from quarrysift.llm import variants

SCHEMA = "doc_id long, text string, near string, n long"


def slow_words(rows, least=7, count=2, one_in=31):
    total = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if one_in and h % one_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                total[w] += 1
    return {w: n for w, n in total.items() if n >= count}


def one_edit(a, b):
    if a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_groups(words, ratio=10):
    out = {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x.encode()), default=None)
        form = best if best is not None and words[best] >= ratio * n else None
        out[w] = [n, len(near), form, words.get(form)]
    for w in out:
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        out[w].append(root)
    return {w: tuple(x) for w, x in out.items()}


def as_map(df):
    rows = df.collect()
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_of_short_words(spark, tmp_path, seed):
    """Words over two or three letters, so that runs, prefixes and dense neighbourhoods abound."""
    rng = random.Random(seed)
    words = {}
    while len(words) < 400:
        words["".join(rng.choice("abé" if seed == 1 else "ab") for _ in range(rng.randint(1, 9)))] = rng.choice([2, 3, 25, 25, 300, 4000])
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert as_map(variants.variant_groups(table)) == slow_groups(words)


def test_documents(spark):
    rng = random.Random(3)
    base = ["international", "Überraschung", "señorita", "Extraordinary", "comments", "comment", "running", "runnings", "ABÀÿcdefgh", "short"]
    rows = [(i, " ".join(rng.choice(base) for _ in range(80)) + rng.choice([" end.", ",x×y÷z", ""]), "x", 1) for i in range(60)]
    rows += [rows[0], (None, "comments international", None, None), (99, None, None, None), (100, "", "y", 2), (101, " \n", "", 0), (102, "communts " * 3000, "", 0)]
    got = as_map(variants.variant_groups(variants.vocabulary(spark.createDataFrame(rows, SCHEMA))))
    want = slow_groups(slow_words(rows))
    assert got == want
    assert any(x[2] for x in want.values()) and any(x[4] != w for w, x in want.items())


def test_chain_of_forms(spark):
    words = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaabbbb": 20_000, "aabbbbb": 200_000}
    got = as_map(variants.variant_groups(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == slow_groups(words)
    assert {x[4] for x in got.values()} == {"aabbbbb"}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert variants.variant_groups(variants.vocabulary(empty)).collect() == []


def test_query(spark, tmp_path):
    rng = random.Random(5)
    base = ["wonderful", "wonderfull", "telephone", "telefone", "marchandise"]
    rows = [(i, " ".join(rng.choice(base) for _ in range(50))) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = variants.op12_variants(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert as_map(got) == slow_groups(slow_words(rows))
