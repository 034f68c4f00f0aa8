"""Session helpers: scratch tables in the cluster's shared folder, and table readers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex[:12]
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where it is unset (tests, a laptop) and the master is local, a temporary folder
    is made; on a cluster an unset folder is an error, as executors share no disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="quarrysift-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own for a table of this process."""
    return f"{shared_dir(spark)}/quarrysift-{_RUN}/{name}-{uuid.uuid4().hex[:8]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: what an executor loses later is read again from the table,
    not computed again. ``cleanup`` removes the tables of this process.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(here):  # else it came as a package file already
        out = tempfile.mkdtemp(prefix="quarrysift-code-")
        atexit.register(shutil.rmtree, out, ignore_errors=True)
        root, name = os.path.split(here)
        staged = shutil.copytree(here, f"{out}/code/{name}", ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(f"{out}/{name}", "zip", os.path.dirname(staged)))
    _SHIPPED.add(sc.applicationId)


#: Bytes of rows that a Python worker gets at once, if the session leaves Spark's own limit (64 MB) as it is.
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Long texts go to Python workers in small batches.

    Spark holds a batch several times over (rows, buffers that double, what comes back), for
    each core beside its heap.
    """
    if spark.conf.get(BATCH_LIMIT) == f"{64 << 20}b":
        spark.conf.set(BATCH_LIMIT, f"{BATCH_BYTES}b")


def cleanup(spark: SparkSession) -> None:
    """Remove every scratch table that this process wrote."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quarrysift-{_RUN}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
