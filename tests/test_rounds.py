import datetime

import pytest
from pyspark.sql import functions as F

from quarrysift.operators import embedding, results, rounds
from quarrysift.streaming import feed

SCHEMA = "ord long, url string, title string, snippet string, source string, ts timestamp, metadata map<string,string>"
DAY = datetime.datetime(2024, 3, 1)


def row(ord_, url, source="a", hours=0, **metadata):
    return (ord_, f"https://{url}", f"t{ord_}", "s", source, DAY + datetime.timedelta(hours=hours), metadata)


def key():
    return F.col("url")


def total(df):
    return {r.url: (r.ord, r.metadata, r.sources, r.copies, r["round"]) for r in df.collect()}


def test_rounds(spark):
    r = rounds.Rounds(spark, key(), 4)
    with pytest.raises(ValueError):
        r.total()
    first = r.add(spark.createDataFrame([row(5, "x", k="1", m="a"), row(7, "x", "b", k="2"), row(6, "y")], SCHEMA))
    assert sorted(x.ord for x in first.collect()) == [5, 6]
    second = r.add(spark.createDataFrame([row(1, "x", "c", k="3"), row(2, "z", "c"), row(3, "z", "a")], SCHEMA))
    assert [(x.ord, x.url) for x in second.collect()] == [(2, "https://z")]
    assert r.add(spark.createDataFrame([], SCHEMA)).count() == 0
    assert r.add(spark.createDataFrame([row(9, "y", "a")], SCHEMA)).count() == 0
    assert total(r.total()) == {
        "https://x": (5, {"k": "3", "m": "a"}, ["a", "b", "c"], 3, 1),
        "https://y": (6, None, ["a"], 2, 1),
        "https://z": (2, None, ["c", "a"], 2, 2),
    }
    assert sorted(tuple(x) for x in r.counts().collect()) == [(1, 2, 2), (2, 2, 1), (4, 1, 0)]
    r.table.drop()


def test_state_is_not_shuffled(spark):
    """The table's side of a round's join and the total have no exchange; only new rows are dealt."""
    r = rounds.Rounds(spark, key(), 4)
    r.add(spark.createDataFrame([row(1, "x")], SCHEMA))
    held = r.table.read()
    plan = r.table.unknown(spark.createDataFrame([("k", 1)], f"{rounds.KEY} string, n int"))._jdf.queryExecution().executedPlan().toString()
    new, old = plan.split("Scan ExistingRDD")[0], plan
    assert old.count("Exchange") == 1 and "Bucketed: true" in old and "ShuffledHashJoin" in new
    assert "Exchange" not in r.total()._jdf.queryExecution().executedPlan().toString()
    files = {x.f for x in held.select(F.input_file_name().alias("f")).collect()}
    r.add(spark.createDataFrame([row(2, "y"), row(3, "x")], SCHEMA))
    assert files < {x.f for x in r.table.read().select(F.input_file_name().alias("f")).collect()}  # nothing is written again
    r.table.drop()


def test_index_keeps_the_last_of_equal_urls(spark):
    index = embedding.Index(embedding.hashed_words(16))
    rows = [(i, u, t, "", "a", DAY, {}) for i, (u, t) in enumerate([("u1", "red"), ("u2", "blue"), ("u1", "green")])]
    index.add(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert index.search("green", 1).first().url == "u1" and index.search("green", 1).first().similarity == pytest.approx(1)
    index.add(spark.createDataFrame([(9, "u1", "red", "", "a", DAY, {}), (9, "u3", "plum", "", "a", DAY, {})], SCHEMA))
    assert index.stats() == {"vectors": 3}
    assert index.search("green", 1).first().url == "u1"


def stream_of(spark, path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(path)


def test_stream_merges_like_a_batch(spark, tmp_path):
    rows = [[row(4, "x", "b", 1, k="late"), row(6, "y", "a", 1)], [row(2, "x", "a", 2, k="early", m="1")], [row(9, "x", "c", 3, n="2"), row(8, "z", "a", 3, k="only")]]
    got = feed.run_available(feed.merged_first_wins(stream_of(spark, str(tmp_path), rows), "100 hours", "1000 hours", key()))
    want = results.deduplicate(spark.createDataFrame([r for b in rows for r in b], SCHEMA), key())
    as_set = lambda df: {(r.url, r.ord, r.title, str(sorted((r.metadata or {}).items())), str(r.sources), r.copies) for r in df.collect()}
    assert as_set(got) == as_set(want)


def test_late_rows_and_timers(spark, tmp_path):
    """An hour's watermark: a row two days late is dropped, a quiet key becomes final and begins anew."""
    batches = [[row(5, "x", "a", 0)], [row(6, "y", "a", 48)], [row(1, "x", "b", 0.5), row(7, "y", "b", 49)], [row(8, "x", "c", 60), row(9, "w", "a", 61)], [row(10, "w", "b", 61)]]
    got = feed.run_available(feed.merged_first_wins(stream_of(spark, str(tmp_path), batches), "1 hour", "1 hour", key()))
    rows = {r.url[8:]: (r.ord, r.copies, r.final) for r in got.collect()}
    assert rows["x"] == (8, 1, False) and rows["y"] == (6, 2, True) and rows["w"] == (9, 2, False)
