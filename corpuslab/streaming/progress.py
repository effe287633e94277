"""Failure and progress logs: append-only JSON lines in, idempotent tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Fields of a failure record.
FAILURE = "created_at_utc timestamp, provider string, model string, mode string, sample_id long, error string"


def read_log(spark: SparkSession, folder: str, schema: str = FAILURE) -> DataFrame:
    """A stream over a folder to which JSONL files are added."""
    return spark.readStream.schema(schema).json(folder)


def failures_by_hour(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Failures a model and hour; records later than the watermark are left out."""
    return log.withWatermark("created_at_utc", late).groupBy(F.window("created_at_utc", "1 hour"), "provider", "model").agg(F.count("*").alias("failures"))


def once_each(log: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Records without repeats within the watermark, so that a resumed job may write again."""
    return log.withWatermark("created_at_utc", late).dropDuplicatesWithinWatermark(keys)


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is there now to a Parquet table, exactly once, and stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def merge(log: DataFrame, path: str, checkpoint: str, *, key: str, at: str, error: str, done: str) -> StreamingQuery:
    """Fold a log of attempts into a progress table below ``path``, exactly once, and stop when all that is there is read.

    Each trigger writes what its own records say of a key (attempts, the last
    error and its time, whether it is done) into the folder of its number and
    replaces what a failed run of the same trigger left there; the checkpoint
    gives a trigger the same records again. ``progress_table`` adds triggers up.
    """

    def fold(batch: DataFrame, number: int) -> None:
        failed = F.col(error).isNotNull()
        rows = batch.groupBy(key).agg(
            F.count("*").alias("attempts"),
            F.count_if(failed).alias("failures"),
            F.max(F.when(failed, F.struct(F.col(at).alias("at"), F.col(error).alias("error")))).alias("last"),
            F.max(F.coalesce(F.col(done), F.lit(False))).alias("done"),
        )
        rows.write.mode("overwrite").parquet(f"{path}/trigger={number}")

    return log.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_table(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, attempts, failures, last_error, done) over all triggers."""
    rows = spark.read.parquet(path)
    out = rows.groupBy(key).agg(F.sum("attempts").alias("attempts"), F.sum("failures").alias("failures"), F.max("last").alias("last"), F.max("done").alias("done"))
    return out.select(key, "attempts", "failures", F.col("last.error").alias("last_error"), "done")
