"""Shared scratch space and lineage cuts.

Everything that outlives a stage is written below ``spark.checkpoint.dir``,
the folder which driver and executors share, so a lost executor costs only
the tasks it was running. The setting is read from the session; only where it
is unset (unit tests on one machine) is a folder of our own made.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; on one machine, where it names none, a folder of the application's own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="corpuslab-")
    return _own[app]


def path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{root(spark)}/corpuslab/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    at = path(spark, name)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.scratch_path = at
    return out


def remove(spark: SparkSession, at: str) -> None:
    """Remove a folder of the shared space."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(at)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*stages: DataFrame) -> None:
    """Remove what ``stage`` wrote, once everything that reads it has been written itself."""
    for df in stages:
        remove(df.sparkSession, df.scratch_path)


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the unit of every repartitioning here."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Let the driver drop shuffle files of plans that nothing refers to any more.

    Spark removes them when the driver collects its garbage, which a large
    driver does too seldom for a disk that holds several passes over a corpus.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of an Arrow batch of whole texts.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession, most_bytes: int | None = None) -> None:
    """Arrow batches of at most 2,000 rows: texts are long, and a batch stands in the JVM and in the worker.

    With ``most_bytes`` a batch also ends with the row that reaches so many.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= 2000:
        spark.conf.set(key, "2000")
    if most_bytes:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))
