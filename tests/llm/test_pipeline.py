import random

import corpus_pipeline as P
import pytest

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, doc string, score double, kept boolean, text2 string, d long, own string"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Tables with toxic rows, copies, near copies, a shared passage, benchmark items, and odd rows."""
    rnd, out = random.Random(11), tmp_path_factory.mktemp("corpus")
    words = lambda n: [rnd.choice(SYLLABLES) + rnd.choice(SYLLABLES) + rnd.choice(SYLLABLES) for _ in range(n)]
    texts = {}
    for i in range(120):
        texts[i] = " ".join(words(90))
    labels = [(i, 1, 0) for i in range(120)]
    for i in range(200, 260):  # insults among ordinary words
        texts[i] = " ".join(words(30) + ["zlorvik", "you", "gruzzak"] + words(5))
        labels.append((i, 1, 1))
    item, passage = words(25), words(70)
    texts[300] = texts[3]  # an exact copy
    texts[301] = " ".join(texts[4].split()[:60] + ["edit"] + texts[4].split()[61:])  # 5 of 86 shingles
    for i in (302, 303):
        texts[i] = " ".join(words(39) + [f"before{i}", *passage, f"after{i}"] + words(39))
    texts[304] = " ".join(words(30) + item + words(30))
    rows = list(texts.items()) + [(400, None), (401, ""), (None, texts[5]), (None, "alone here"), (6, texts[6]), (402, "one")]
    full = [(d, t, "en", "s", len(t or ""), "x", 0.5, True, "y", 7, "z") for d, t in rows]
    spark.createDataFrame(full, EXTRA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), full, set(passage)


SYLLABLES = ["ka", "lo", "mi", "ne", "pu", "ra", "so", "ti", "vo", "be"]


def test_each_stage(spark, corpus):
    folder, rows, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids, all_rows = lambda df: {r.doc_id for r in df.collect()}, {r[0] for r in rows}
    kept = P.drop_toxic(spark, docs, folder)
    assert kept.columns == docs.columns
    assert ids(kept) == all_rows - set(range(200, 260)) and kept.count() == len(rows) - 60
    kept = P.drop_near_copies(spark, docs.filter("doc_id is null or doc_id not between 200 and 259"), folder)
    assert kept.columns == docs.columns
    # of equal texts and near copies the smallest id stays, null ids last; null and empty texts are one class
    gone = {300, 301, 401}
    assert sorted(map(str, [r.doc_id for r in kept.collect()])) == sorted(map(str, [d for d in all_rows if d is not None and d not in gone and not 200 <= d < 260] + [None]))
    cut = {r.doc_id: r for r in P.drop_repeats(spark, docs.filter("doc_id in (302, 303, 400, 401, 402)"), folder).collect()}
    assert list(cut[302].asDict()) == docs.columns
    whole = {r[0]: r for r in rows}
    assert cut[302].text == whole[302][1] and cut[400].text is None and cut[401].text == ""
    assert len(cut[303].text.split()) == 80 and cut[303].n_chars == len(cut[303].text) and cut[303].score == 0.5
    kept = P.drop_benchmark(spark, docs, folder)
    assert kept.columns == docs.columns and ids(kept) == all_rows - {304} and kept.count() == len(rows) - 1
    packed = P.pack(spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == all_rows
    assert all(len({(r.sequence_id, r.offset) for r in packed}) == len(packed) and r.offset + r.length <= 2048 for r in packed)


def test_run(spark, corpus):
    folder, rows, _ = corpus
    got = {r.doc_id for r in P.run(spark, folder).collect()}
    assert got == {r[0] for r in rows} - set(range(200, 260)) - {300, 301, 304, 401}


def test_empty_tables(spark, tmp_path):
    for name, ddl in (("documents", EXTRA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_drop_benchmark_by_row(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "before " + item), (None, "clean"), (1, item + " after"), (1, "clean too"), (2, "clean"), (3, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in P.drop_benchmark(spark, docs, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([rows[i] for i in (1, 3, 4, 5, 6)], key=str)


def test_stages_give_python_workers_small_batches(spark):
    import pyarrow as pa
    from quarrysift.session import BATCH_LIMIT

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    spark.conf.unset(BATCH_LIMIT)
    P._begin(spark)
    got = [r.n for r in spark.range(0, 6000, 1, 1).selectExpr("repeat('x', 5000) AS text").mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 30e6 and max(got) < 10e6
