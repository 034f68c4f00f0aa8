"""Steps whose work must grow no faster than their input."""

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrysift.operators import refine
from quarrysift.plans import output
from quarrysift.streaming import feed


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_suggestions_hash_and_keep_ties_by_place(spark):
    rows = [(2**62 + 1, "https://alpha-beta.com/", "delta gamma", "zeta"), (-(2**62), "https://kappa.org/", "gamma omega", "zeta iota")]
    df = spark.createDataFrame(rows, "ord long, url string, title string, snippet string")
    assert "SortAggregate" not in plan(refine.suggestions(df, "none", 5))
    terms = refine.weighted_terms(df)
    by_place = [(r.pos, r.term) for r in terms.orderBy("pos").collect()]
    assert by_place == [(r.pos, r.term) for r in terms.orderBy("first").collect()]
    least = terms.groupBy("kind", "term").agg(F.min("pos").alias("p"), F.min(F.struct("first", "pos")).alias("f"))
    assert least.filter(F.col("p") != F.col("f.pos")).count() == 0
    got = [r.term for r in refine.suggestions(df, "none", 20).collect()]  # of equal scores the one of the smallest ord comes first
    assert got.index("omega") < got.index("delta") and got.index("gamma omega") < got.index("delta gamma")


def test_sections_by_category_do_not_work_texts_out_for_a_filter(spark, tmp_path):
    spark.createDataFrame([(0, "a x"), (1, ""), (2, "b")], "ord long, html string").write.parquet(str(tmp_path / "t"))
    found = F.filter(F.split("html", " "), lambda x: x != "")
    df = spark.read.parquet(str(tmp_path / "t")).withColumns({"url": F.lit("https://a.test/"), "categories": F.when(F.col("ord") == 2, F.array(F.lit(None).cast("string"))).otherwise(found)})
    df = df.withColumn("title", F.upper("html"))
    got = output.rendered(df, "{{section}}:{{#each results}}{{title}} {{categories}};{{/each}}", {}, "category")
    assert "Filter (size(" not in plan(got)
    # a row without categories is in no section, and one whose category is null in a section of its own
    assert {(r.section, r.n, r.text) for r in got.collect()} == {("a", 1, "a:A X a, x;"), ("x", 1, "x:A X a, x;"), (None, 1, ":B ;")}


class Store:
    """A stand-in for the state store that counts what is asked of it."""

    def __init__(self):
        self.value, self.calls = None, 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def _told(self, *value):
        self.calls += 1
        return self.value

    getMapState = getValueState  # noqa: N815
    get = exists = iterator = containsKey = getValue = updateValue = deleteTimer = registerTimer = _told  # noqa: N815

    def update(self, value):
        self.calls, self.value = self.calls + 1, value


def test_a_key_asks_the_store_a_few_times_however_many_names(spark):
    fields = StructType.fromDDL("ord long, url string, source string")
    rows = [Row(ord=i, url="u", source=f"s{i}", metadata={f"m{j}": str(i) for j in range(20)}, qs_millis=i) for i in (5, 3)]
    store, wins = Store(), feed.FirstWins(fields, 10)
    wins.init(store)
    for n, r in enumerate(rows):
        store.calls = 0
        (got,) = wins.handleInputRows(("u",), iter([r]), None)
        assert store.calls <= 4, n
    assert (got.ord, got.copies, got.sources, got.metadata["m7"], got.final) == (3, 2, ["s3", "s5"], "5", False)
