import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrysift.operators import results, rules, vectors


def slow_rules(texts, rows):
    out = {}
    for key, fields in texts:
        hit = sorted({r for r in rows if r[3] and r[2] in fields and fields[r[2]] is not None and r[3] in fields[r[2]]})
        out[key] = hit
    return out


def test_rules_equal_scan(spark):
    """Patterns of one character and more, over letters that repeat, in every kind."""
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abé 😀") for _ in range(n))
    texts = [(i, {"host": f"{word(4).strip()}.test", "text": word(rng.randint(0, 60))}) for i in range(60)]
    texts += [(100, {"host": None, "text": None}), (101, {"host": "", "text": ""}), (102, {"host": "h", "text": "ab" * 20_000})]
    rows = [(i, f"c{i % 7}", rng.choice(["host", "text", "other"]), word(rng.randint(1, 9))) for i in range(300)]
    rows += [rows[0], (500, "none", "text", ""), (501, "none", "text", None), (502, "whole", "host", ".test")]
    df = spark.createDataFrame([(k, f["host"], f["text"]) for k, f in texts], "k long, host string, body string")
    table = spark.createDataFrame(rows, "rank long, name string, kind string, pattern string")
    got = rules.matched_rules(df, table, "k", {"host": F.col("host"), "text": F.col("body")})
    assert got.columns == ["k", "host", "body", "rules"]
    want = slow_rules(texts, rows)
    assert {r.k: [tuple(x) for x in r.rules] for r in got.collect()} == want
    named = {r.k: r.c for r in got.select("k", rules.categories(F.col("rules")).alias("c")).collect()}
    assert named[100] == ["General"] and all(named[k] == list(dict.fromkeys(x[1] for x in v)) or not v for k, v in want.items())


def test_fixed_categories_as_a_table(spark):
    """The built-in categories give the same names either way."""
    pages = [(0, "https://docs.a.test/x", "Guide", "how to learn"), (1, "https://github.com/y", "code", None), (2, "bad url", "news update", ""), (3, "https://b.test/blog/1", "plain", "words"), (4, None, None, None)]
    df = spark.createDataFrame(pages, "ord long, url string, title string, snippet string")
    rows = [(i, name, kind, p) for i, (name, *parts) in enumerate(results.CATEGORIES) for kind, ps in zip(("host", "text", "url"), parts, strict=True) for p in ps]
    table = spark.createDataFrame(rows, "rank long, name string, kind string, pattern string")
    got = {r.ord: r.c for r in rules.matched_rules(df, table).select("ord", rules.categories(F.col("rules")).alias("c")).collect()}
    want = {r.ord: r.c for r in df.select("ord", results.categories(F.col("url"), F.col("title"), F.col("snippet")).alias("c")).collect()}
    assert got == want


def test_no_rules_and_no_rows(spark):
    df = spark.createDataFrame([(1, "u", "t", "s")], "ord long, url string, title string, snippet string")
    table = spark.createDataFrame([], "rank long, name string, kind string, pattern string")
    assert [r.rules for r in rules.matched_rules(df, table).collect()] == [[]]
    table = spark.createDataFrame([(1, "n", "text", "t")], "rank long, name string, kind string, pattern string")
    assert rules.matched_rules(df.limit(0), table).collect() == []


def test_rules_need_no_nested_loop(spark):
    df = spark.createDataFrame([(1, "u", "t", "s")], "ord long, url string, title string, snippet string")
    table = spark.createDataFrame([(1, "n", "text", "t")], "rank long, name string, kind string, pattern string")
    plan = rules.matched_rules(df, table)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


@pytest.mark.parametrize("sent", [vectors.SENT, 0])
def test_nearest_many_equals_scan(spark, monkeypatch, sent):
    monkeypatch.setattr(vectors, "SENT", sent)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(150)] + [(200, [0.0, 0.0, 0.0]), (201, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = vectors.nearest_many(df, df.filter("vec_id % 5 = 0"), 7, digits=9)
    import math

    def cosine(a, b):
        n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 9) + 0.0 if n else 0.0

    want = set()
    for q, a in rows:
        if q % 5 == 0:
            best = sorted((-cosine(a, b), k) for k, b in rows if b)[:7]
            want |= {(q, r, k, -s + 0.0) for r, (s, k) in enumerate(best, 1)}
    assert {(r.query, r["rank"], r.vec_id, r.similarity) for r in got.collect()} == want


def test_nearest_many_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")
    none = df.limit(0)
    assert vectors.nearest_many(df, none).collect() == [] and vectors.nearest_many(none, df).collect() == []
    assert {(r.query, r.vec_id) for r in vectors.nearest_many(df, df, 1).collect()} == {(1, 1), (2, 2)}
    with pytest.raises(Exception, match="differ in length"):
        vectors.nearest_many(df, spark.createDataFrame([(3, [1.0])], "vec_id long, embedding array<double>")).collect()


@pytest.mark.parametrize("few", [rules.FEW, 3])
def test_rules_of_one_anchor(spark, monkeypatch, few):
    """Texts are looked at for few rules that they do not hold, and give grams of one size where short patterns are few."""
    monkeypatch.setattr(rules, "FEW", few)
    held, kept = [], rules.materialize
    monkeypatch.setattr(rules, "materialize", lambda df, name: held.append((name, kept(df, name))) or held[-1][1])
    text = "the cat sat on the mat near the hat"
    rows = [(i, f"n{i}", "text", p) for i, p in enumerate(["t", "at", "cat", "sat o", "on the mat", "on the hat", "the cat s", "e m", "zebra crossing"])]
    df = spark.createDataFrame([(1, text), (2, None)], "k long, body string")
    got = rules.matched_rules(df, spark.createDataFrame(rows, "rank long, name string, kind string, pattern string"), "k", {"text": F.col("body")})
    assert {r.k: [x.pattern for x in r.rules] for r in got.collect()} == {1: ["t", "at", "cat", "sat o", "on the mat", "the cat s", "e m"], 2: []}
    grams = [r.gram for r in dict(held)["met_grams"].collect()]
    assert not [g for g in grams if len(g) == 4]  # no pattern is that short, and no longer one is cut so


def test_rules_are_met_where_the_text_is(spark):
    """No text, gram or match moves between tasks or is a row of its own, whatever other columns there are; keys may be null or equal."""
    df = spark.range(4).withColumns({"k": F.when(F.col("id") < 2, F.lit(None)).otherwise(F.lit(7)), "url": F.lit("https://docs.a.test/x"), "title": F.concat(F.lit("Tutorial "), "id"), "snippet": F.lit(None).cast("string")})
    df = df.withColumns({"ts": F.timestamp_seconds("id"), "metadata": F.create_map(F.lit("a"), F.col("title")), "parts": F.array(F.struct("id", F.lit(1.5).cast("decimal(9,2)").alias("d"))), "day": F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int"))})
    table = spark.createDataFrame([(2, "b", "text", "tutorial 1"), (1, "a", "host", "docs."), (1, "a", "text", "tutorial"), (3, "c", "text", "tutorial 1 and more")], "rank int, name string, kind string, pattern string")
    got = rules.matched_rules(df, table, "k")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Join" not in plan
    rows = got.orderBy("id").collect()
    assert [[r.pattern for r in x.rules] for x in rows] == [["docs.", "tutorial", *(["tutorial 1"] if i == 1 else [])] for i in range(4)]
    assert got.columns == [*df.columns, "rules"] and [x[:-1] for x in rows] == [tuple(x) for x in df.orderBy("id").collect()]


def test_patterns_equal_scan(monkeypatch):
    """Patterns of up to five eights, in texts that lie next to each other; a block of places may end within a match."""
    rng = random.Random(4)
    for letters, places in (("ab", 1 << 17), ("abé 😀", 7), ("a\x00b", 64)):
        monkeypatch.setattr(rules, "PLACES", places)
        word = lambda n: "".join(rng.choice(letters) for _ in range(n))  # noqa: B023, E731
        texts = [word(rng.randint(0, 80)) for _ in range(60)] + [None, ""]
        patterns = sorted({word(rng.randint(1, 40)) for _ in range(300)} | {t[3 : 3 + n] for t in texts if t for n in (8, 9, 16, 17, 24, 33)} - {""})
        row, pattern = rules.matches(pa.array(texts).slice(1), rules.Patterns([p.encode() for p in patterns]))
        assert list(zip(row.tolist(), pattern.tolist(), strict=True)) == [(i, j) for i, t in enumerate(texts[1:]) if t for j, p in enumerate(patterns) if p in t]


@pytest.mark.parametrize("most", [rules.MATCHES, 2])
def test_matches_go_back_in_parts(spark, monkeypatch, most):
    """Rules of equal patterns, and rows with more matches than a batch takes."""
    table = pa.table({"rank": [1, 2, 3, 4], "name": ["x", "y", "x", "z"], "kind": ["t", "t", "u", "t"], "pattern": ["ab", "ab", "b", "zz"]})
    structs = pa.StructArray.from_arrays([c.combine_chunks() for c in table.columns], fields=list(table.schema))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["ab ab", "", None, "zz ab", "b"]), pa.array(["b", "b", "b", None, "a"])], names=["k", "q0", "q1"])
    monkeypatch.setattr(rules, "MATCHES", most)
    got = list(rules._match_batches(iter([batch]), structs, [rules._by_kind(table, k) for k in "tu"], "r"))
    assert (len(got) > 1) == (most == 2) and [(x["k"], [y["rank"] for y in x["r"]]) for b in got for x in b.to_pylist()] == [(0, [1, 2, 3]), (1, [3]), (2, [3]), (3, [1, 2, 4]), (4, [])]
