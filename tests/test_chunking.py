import math
import random
import re
import time

from pyspark.sql import functions as F

from quarrysift.operators import chunking


def slow_sentences(text, most, least):
    out, cur = [], ""
    for s in re.findall(r"[^.!?]+[.!?]+", text) or [text]:
        if len(cur) + len(s) <= most:
            cur += s
            continue
        if len(cur) >= least:
            out.append(cur.strip())
        cur = s
    return [*out, cur.strip()] if cur else out


def slow_paragraphs(text, most, least, overlap):
    out, cur = [], ""
    for p in re.split(r"\n\n+", text):
        if len(cur) + len(p) + 2 <= most:
            cur += ("\n\n" if cur else "") + p
            continue
        if len(cur) >= least:
            out.append(cur)
        cur = cur[-overlap:] + "\n\n" + p if overlap and cur else p
        if len(cur) > most:
            *done, cur = slow_sentences(cur, most, least) or [""]
            out += done
    return [*out, cur] if len(cur) >= least else out


def slow_lines(text, most, least, overlap):
    rows, keep = text.split("\n"), math.ceil(overlap / 80)
    out, first, size = [], 0, 0
    for i, line in enumerate(rows):
        if size + len(line) + 1 > most and i > first:
            out.append((first, i))
            first = max(first, i - keep)
            size = len("\n".join(rows[first:i])) if keep else 0
        size += len(line) + 1
    cut = [(a + 1, b, "\n".join(rows[a:b])) for a, b in [*out, (first, len(rows))]]
    return [c for c in cut if len(c[2]) >= least]


def random_text(rng):
    return "".join(rng.choice(["ab ", "c", ". ", "! ", "?", "\n", "\n\n", "\n\n\n", "word ", "é", "...", "long" * rng.randint(1, 30)]) for _ in range(rng.randint(0, 120)))


TEXTS = ["", ".", "...a.b", "a. b! c", "a.b.c?", "?!x", "tail without stop\n", "\n\n", "a" * 500, "\n" * 50, "x. " * 300]


def test_folds_equal_loops(spark):
    rng = random.Random(1)
    texts = TEXTS + [random_text(rng) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "id long, text string")
    for most, least, overlap in ((50, 10, 20), (100, 50, 0), (30, 0, 200), (200, 100, 80), (1, 1, 1)):
        t = F.col("text")
        got = df.select("id", chunking.sentences(t, most, least).alias("s"), chunking.paragraphs(t, most, least, overlap).alias("p"), chunking.line_blocks(t, most, least, overlap).alias("l")).collect()
        for r in got:
            if r.id == len(texts):
                assert r.p is None and r.l is None
                continue
            text = texts[r.id]
            assert r.s == slow_sentences(text, most, least), (text, most, least)
            assert r.p == slow_paragraphs(text, most, least, overlap), (text, most, least, overlap)
            assert [tuple(x) for x in r.l] == slow_lines(text, most, least, overlap), (text, most, least, overlap)


def test_rows(spark):
    df = spark.createDataFrame([(1, "first line here\nsecond line here\nthird"), (2, None), (3, "x")], "id long, text string")
    got = chunking.chunked(df, chunking.line_blocks(F.col("text"), 20, 5, first=11), "id").collect()
    assert [tuple(r) for r in got] == [(1, 0, 11, 11, "first line here"), (1, 1, 12, 12, "second line here"), (1, 2, 13, 13, "third")]
    assert [tuple(r) for r in chunking.chunked(df, chunking.paragraphs(F.col("text"), 100, 1), "id").collect()] == [(1, 0, "first line here\nsecond line here\nthird"), (3, 0, "x")]


def test_long_text_without_stops(spark):
    """A megabyte is passed over once."""
    text = "word " * 200_000
    df = spark.createDataFrame([(1, text)], "id long, text string")
    chunking.chunked(df.limit(0), chunking.paragraphs(F.col("text")), "id").collect()
    began = time.perf_counter()
    got = chunking.chunked(df, chunking.paragraphs(F.col("text")), "id").collect()
    took = time.perf_counter() - began
    assert [r.content for r in got] == [text.strip()]
    assert took < 5


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a")], "id long, text string")
    for c in (chunking.paragraphs(F.col("text")), chunking.line_blocks(F.col("text"), overlap=100)):
        plan = chunking.chunked(df, c, "id")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
