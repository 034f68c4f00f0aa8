"""Preparation of a training corpus, stage by stage.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrysift.llm import decontaminate, packing, simhash, substring, toxicity
from quarrysift.session import bounded_batches, materialize, ship


def _begin(spark: SparkSession) -> None:
    ship(spark)
    bounded_batches(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold; a null or empty text stays.

    The model is fitted on the labelled rows of the documents that come in.
    """
    _begin(spark)
    settings = toxicity.Settings()
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), settings)
    return toxicity.score(docs, model).filter(F.col("score") < settings.threshold).select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies at 5-word shingles and similarity 0.8."""
    _begin(spark)
    return simhash.one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that an earlier document holds.

    A text that loses words becomes its other words joined by one space, and n_chars its
    length; other rows stay as they are.
    """
    _begin(spark)
    cut = substring.remove_repeats(docs)
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("doc.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return cut.select(*[new.get(n, F.col(f"doc.`{n}`")).alias(n) for n in docs.columns])


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item at 5-word shingles and weighted similarity 0.8.

    Each row goes or stays by its own text, whatever its doc_id.
    """
    _begin(spark)
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    found = decontaminate.benchmark_matches(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    marked = materialize(found.select(F.col("doc_id").alias("leak")).distinct(), "leaks")
    return docs.join(marked, F.xxhash64(docs["text"]) == marked["leak"], "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, packed into sequences of 2048."""
    _begin(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("benchmark_decontamination", drop_benchmark),
    ("best_fit_packing", pack),
]

#: Stages that fit a model or compare fingerprints have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
