import datetime
import json

from pyspark.sql import functions as F

from quarrysift.operators import ranking, refine
from quarrysift.plans import output

NOW = datetime.datetime(2024, 3, 1)


def table(spark, tmp_path, rows):
    df = spark.createDataFrame([(i, u, t, s, "a", NOW, 0.5) for i, (u, t, s) in enumerate(rows)], "ord long, url string, title string, snippet string, source string, ts timestamp, score double")
    df.write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


ROWS = [("https://a.test/1", "red apple", "a red apple pie"), ("https://b.test/1", "blue", "sky " * 30), ("bad", None, None), ("https://a.test/2", "x | y", "red")]


def scans(df):
    """(reads with columns, exchanges) of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    reads = [line for line in plan.split("\n") if "FileScan" in line]
    return sum("ReadSchema: struct<>" not in r for r in reads), plan.count("Exchange hashpartitioning")


def test_one_scan_each(spark, tmp_path):
    df = table(spark, tmp_path, ROWS)
    assert scans(refine.weighted_terms(df)) == (1, 0)
    assert scans(refine.suggestions(df, "red", 5)) == (1, 1)  # and one that only counts rows
    hybrid = ranking.bm25_hybrid(df, "red apple", F.lit(NOW))
    assert scans(hybrid)[1] == 0 and str(tmp_path) not in hybrid._jdf.queryExecution().executedPlan().toString()  # the texts have been read before
    assert {r.ord for r in hybrid.filter("bm25_score > 0").collect()} == {0, 3}
    for by in ("domain", "category", None):
        assert scans(output.body(df, by))[0] == 1


def test_body_keeps_rows_of_one_ord(spark, tmp_path):
    df = table(spark, tmp_path, ROWS).withColumn("ord", F.lit(7).cast("long"))
    assert output.body(df, "domain").count() == 4


def test_rendered_sections(spark, tmp_path):
    df = table(spark, tmp_path, ROWS).withColumn("categories", F.when(F.col("ord") < 2, F.array(F.lit("X"), F.lit("Y"))).otherwise(F.array(F.lit("X"))))
    text = "{{query}} {{section}} {{totalResults}}:{{#each results}}<{{title}}|{{score}}|{{query}}|{{what}}>{{/each}};{{#each results}}{{domain}},{{/each}}{{gone}}"
    got = {r.section: r.text for r in output.rendered(df, text, {"query": "q"}, "domain").collect()}
    assert got == {
        "a.test": "q a.test 2:<red apple|50|q|{{what}}><x | y|50|q|{{what}}>;a.test,a.test,{{gone}}", "b.test": "q b.test 1:<blue|50|q|{{what}}>;b.test,{{gone}}",
        "unknown": "q unknown 1:<|50|q|{{what}}>;unknown,{{gone}}",
    }
    assert {(r.section, r.n) for r in output.rendered(df, "x", {}, "category").collect()} == {("X", 4), ("Y", 2)}
    assert {(r.section, r.block, r.text) for r in output.rendered(df, "{{#each results}}{{title}};{{/each}}", {}, None, 2).collect()} == {("", 0, "red apple;blue;"), ("", 1, ";x | y;")}
    assert output.rendered(df.limit(0), "x", {}).collect() == []


def test_json_text(spark, tmp_path):
    df = table(spark, tmp_path, ROWS).withColumn("metadata", F.create_map(F.lit("k"), F.col("title")))
    got = json.loads(output.json_text(df, 'say "q"', "now", ("a",), [{"provider": "p", "message": "m"}], 3).first().value)
    assert got["meta"] == {"query": 'say "q"', "timestamp": "now", "providers": ["a"], "totalResults": 3, "uniqueDomains": 2, "version": "1.0.0"}
    assert got["errors"] == [{"provider": "p", "message": "m"}] and [r["url"] for r in got["results"]] == ["https://a.test/1", "https://b.test/1", "bad"] and got["results"][0]["metadata"] == {"k": "red apple"}
