"""Results that come in rounds: what is known lies in a table bucketed by key, and only grows.

A round is dealt to the table's buckets and joined there, so that the rows held are neither
shuffled nor written again; what it brings is appended as files of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from . import results

KEY = "qs_key"


class Buckets:
    """A table that is appended to, bucketed by one column, in the shared folder."""

    def __init__(self, spark: SparkSession, key: str = KEY, buckets: int = 16):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.name = f"quarrysift_{uuid.uuid4().hex[:12]}"
        self.columns: list[str] | None = None

    def read(self) -> DataFrame:
        if self.columns is None:
            raise ValueError("nothing has been added yet")
        return self.spark.table(self.name)

    def dealt(self, df: DataFrame) -> DataFrame:
        """``df`` in the table's own partitioning."""
        return df.repartition(self.buckets, self.key)

    def append(self, df: DataFrame) -> None:
        """Add rows; the first ones give the table its columns."""
        if self.columns is None:
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
            self.spark.sql(f"create table {self.name} ({fields}) using parquet clustered by (`{self.key}`) into {self.buckets} buckets location '{scratch(self.spark, self.name)}'")
            self.columns = df.columns
        df.select(*[F.col(f"`{c}`") for c in self.columns]).write.insertInto(self.name)

    def unknown(self, df: DataFrame) -> DataFrame:
        """Rows of ``df`` whose key the table does not hold; null keys are unknown."""
        if self.columns is None:
            return self.dealt(df)
        return self.dealt(df).join(self.read().select(self.key).hint("shuffle_hash"), self.key, "left_anti").select(*df.columns)

    def drop(self) -> None:
        if self.columns is not None:
            self.spark.sql(f"drop table {self.name}")
            self.columns = None


class Rounds:
    """Union of rounds of results, distinct by key: the first row wins, metadata of later rows too.

    Each round leaves one row for each of its keys: the row of least ``ord``, the metadata and the
    sources it brings, how many rows they were, and whether the key is new. Keys of earlier rounds
    keep their row whatever its ``ord``. A round with no rows counts as a round.
    """

    def __init__(self, spark: SparkSession, key: Column | None = None, buckets: int = 16):
        self.table, self.key, self.round = Buckets(spark, KEY, buckets), key, 0

    def add(self, found: DataFrame) -> DataFrame:
        """Take one more round in; gives its new rows."""
        self.round += 1
        keyed = found.withColumn(KEY, results.dedup_key() if self.key is None else self.key)
        one = results.deduplicate(keyed, F.col(KEY))
        row = F.struct(*[c for c in found.columns if c != "metadata"])
        names = F.coalesce("sources", F.array("source"))
        mine = one.select(KEY, F.lit(self.round).alias("round"), row.alias("row"), "metadata", names.alias("names"), "copies")
        if self.table.columns is None:
            fresh = self.table.dealt(mine).withColumn("new", F.lit(True))
        else:
            held = self.table.read().filter("new").select(KEY, F.lit(False).alias("new"))
            fresh = self.table.dealt(mine).join(held.hint("shuffle_hash"), KEY, "left").withColumn("new", F.coalesce("new", F.lit(True)))
        self.table.append(fresh)
        return self.table.read().filter((F.col("round") == self.round) & F.col("new")).select("row.*", "metadata")

    def total(self) -> DataFrame:
        """All rounds: the first row of each key, ``metadata``, ``sources`` (null for a single row), ``copies``, ``round``."""
        sides = F.sort_array(F.collect_list(F.struct("round", F.map_entries("metadata").alias("entries"), "names")))
        one = self.table.read().groupBy(KEY).agg(F.first(F.when(F.col("new"), F.col("row")), ignorenulls=True).alias("row"), F.min("round").alias("round"), F.sum("copies").alias("copies"), sides.alias("sides"))
        entries = F.flatten(F.filter(F.transform("sides", lambda s: s["entries"]), lambda e: e.isNotNull()))
        one = one.select("row", "round", "copies", entries.alias("e"), F.array_distinct(F.flatten(F.transform("sides", lambda s: s["names"]))).alias("names"))
        last = F.filter("e", lambda x, i: ~F.exists(F.slice("e", i + 2, F.size("e")), lambda y: y["key"] == x["key"]))
        return one.select("row.*", F.when(F.size("e") > 0, F.map_from_entries(last)).alias("metadata"), F.when(F.col("copies") > 1, F.col("names")).alias("sources"), "copies", "round")

    def counts(self) -> DataFrame:
        """(round, keys, new) of each round that had rows."""
        return self.table.read().groupBy("round").agg(F.count("*").alias("keys"), F.count_if("new").alias("new"))
