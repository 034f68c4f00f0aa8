"""A cache of requests as a table: entries are appended, looked up as of a time, and outlive the run that wrote them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lookup(requests: DataFrame, entries: DataFrame, ttl: int, carry: list[str]) -> DataFrame:
    """``requests`` (key, at, any others) with ``hit``, the time of the latest entry of the key not over ``ttl`` seconds older, and its columns ``carry``.

    ``entries``: (key, at, n, carry); those with n of 0 are no results and left out. An entry of the very time
    of a request counts. Times are cut in spans of ``ttl``, so that an entry in question is in the request's
    own span or the one before: a key's rows of one span are ordered together, never all of them.
    """
    span = F.floor(F.unix_micros("at") / F.lit(ttl * 1_000_000))
    kept = entries.filter("n > 0").select("key", "at", F.struct("at", *carry).alias("e")).withColumn("span", span)
    # the last of a span is all that the next one needs of it
    last = kept.groupBy("key", "span").agg(F.max("e").alias("e")).select("key", (F.col("span") + 1).alias("span"), F.lit(None).cast("timestamp").alias("at"), "e", F.lit(None).alias("r"))
    row = requests.select("key", "at", F.struct(*[F.col(f"`{c}`") for c in requests.columns]).alias("r")).withColumn("span", span)
    kind = row.schema["r"].dataType
    none = lambda df: df.withColumn("r", F.lit(None).cast(kind))
    asked = row.withColumn("e", F.lit(None).cast(kept.schema["e"].dataType))
    cols = ["key", "span", "at", "e", "r"]
    every = asked.select(*cols).unionByName(none(kept).select(*cols)).unionByName(none(last).select(*cols))
    order = Window.partitionBy("key", "span").orderBy(F.col("at").asc_nulls_first(), F.col("r").isNotNull(), "e")
    seen = every.withColumn("seen", F.last("e", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("r is not null")
    fresh = F.unix_micros("at") - F.unix_micros("seen.at") <= ttl * 1_000_000
    return seen.select("r.*", F.when(fresh, F.col("seen.at")).alias("hit"), *[F.when(fresh, F.col(f"seen.{c}")).alias(c) for c in carry])


class RequestCache:
    """Entries (key, at, n, value) in a Parquet folder of the caller's, which no clean-up of scratch tables touches."""

    SCHEMA = "key string, at timestamp, n long, value string"

    def __init__(self, spark: SparkSession, path: str, ttl: int = 3600):
        self.spark, self.path, self.ttl = spark, path.rstrip("/"), ttl

    def entries(self) -> DataFrame:
        """All entries; none where nothing has been stored."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def store(self, results: DataFrame, key: Column, at: Column) -> None:
        """One entry for each key of ``results``: its rows as JSON, in order of ``ord``; a key without rows leaves none.

        A request's results are as many as its limit lets through.
        """
        row = F.struct("ord", *[c for c in results.columns if c != "ord"])
        held = results.withColumn("key", key).groupBy("key").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("ord", F.to_json(row).alias("j")))).alias("x"))
        value = F.concat(F.lit("["), F.array_join(F.transform("x", lambda e: e["j"]), ","), F.lit("]"))
        held.select("key", at.cast("timestamp").alias("at"), "n", value.alias("value")).write.mode("append").parquet(self.path)

    def get(self, requests: DataFrame) -> DataFrame:
        """``requests`` (key, at) with hit, n and value of the entry that answers each; null for a miss."""
        return lookup(requests, self.entries(), self.ttl, ["n", "value"])

    def stats(self) -> DataFrame:
        """(files, bytes, oldest, newest) of the folder, without reading what is in its files."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(self.path)
        return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.min("modificationTime").alias("oldest"), F.max("modificationTime").alias("newest"))

    def prune(self, now: Column) -> None:
        """Keep only entries that may still answer; they are written anew before the old files go."""
        alive = self.entries().filter(F.unix_micros(now.cast("timestamp")) - F.unix_micros("at") <= self.ttl * 1_000_000)
        fresh = f"{self.path}-next"
        alive.write.mode("overwrite").parquet(fresh)
        self.spark.read.schema(self.SCHEMA).parquet(fresh).write.mode("overwrite").parquet(self.path)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(fresh)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
