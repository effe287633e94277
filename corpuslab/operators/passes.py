"""Passes that end early and go on: judged rows by attempts, scores by model signature.

Both keep what they have paid for in Parquet folders named by what it was made
with (a configuration's digest, a model's signature), look up what is missing
by an anti join, and add only that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _held(rows: DataFrame, at: str, schema: str) -> DataFrame:
    """What lies in a folder, nothing if it is not there yet."""
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(at)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(at) if there else spark.createDataFrame([], schema)


def attempts(rows: DataFrame, at: str, config: str, id_col: str) -> DataFrame:
    """(id, tries, score): attempts made under a configuration and the score of the first that had one."""
    kind = dict(rows.dtypes)[id_col]
    held = _held(rows, f"{at}/config={config}", f"{id_col} {kind}, attempt int, score double")
    return held.groupBy(id_col).agg(F.max("attempt").alias("tries"), F.min_by("score", F.when(F.col("score").isNotNull(), F.col("attempt"))).alias("score"))


def judge_all(rows: DataFrame, *, id_col: str, call: Callable[[DataFrame], DataFrame], at: str, config: str, most: int = 3) -> DataFrame:
    """(id, tries, score) of all rows: ``call`` gives (id, attempt, score) for rows with their ``attempt``, a null score for a failure.

    Rows without a score are called again until they have one or ``most``
    attempts are made. Each round's attempts are added to the folder of the
    configuration, so a run that ends early goes on where it was, a finished one
    is taken over, and another configuration starts anew. A row that was never
    called has null tries and score only if ``most`` is 0.
    """
    seen = attempts(rows, at, config, id_col)
    for _ in range(most):
        joined = rows.join(seen, id_col, "left")
        pending = joined.where(F.col("score").isNull() & (F.coalesce("tries", F.lit(0)) < most))
        if pending.isEmpty():
            break
        replies = call(pending.withColumn("attempt", (F.coalesce("tries", F.lit(0)) + 1).cast("int")).drop("tries", "score"))
        replies.select(id_col, F.col("attempt").cast("int"), F.col("score").cast("double")).write.mode("append").parquet(f"{at}/config={config}")
        seen = attempts(rows, at, config, id_col)
    return rows.select(id_col).join(seen, id_col, "left")


def cached_scores(rows: DataFrame, *, id_col: str, models: dict[str, str], score: Callable[[DataFrame, str], DataFrame], at: str) -> DataFrame:
    """(model, id, score, fresh) for every row and model; ``fresh`` says that this call scored it.

    ``models`` gives each model's artifact signature. Scores lie in a folder a
    signature; rows that a folder lacks are scored by ``score(rows, model)``,
    which gives (id, score), and added to it.
    """
    kind = dict(rows.dtypes)[id_col]
    out = None
    for model, signature in models.items():
        folder, schema = f"{at}/signature={signature}", f"{id_col} {kind}, score double"
        before = _held(rows, folder, schema)
        lacking = rows.join(before.select(id_col), id_col, "left_anti")
        if not lacking.isEmpty():
            # Frozen first: the folder that is added to is the one that says what it lacks.
            old = before.inputFiles()
            score(lacking, model).select(id_col, F.col("score").cast("double")).write.mode("append").parquet(folder)
            before = rows.sparkSession.read.schema(schema).parquet(*old) if old else before
        after = _held(rows, folder, schema).dropDuplicates([id_col])
        known = before.select(F.col(id_col).alias("__old")).distinct()
        part = rows.select(id_col).join(after, id_col).join(known, F.col(id_col) == F.col("__old"), "left")
        part = part.select(F.lit(model).alias("model"), id_col, "score", F.col("__old").isNull().alias("fresh"))
        out = part if out is None else out.unionByName(part)
    return out


def failing(key: Column, attempt: Column, share: int = 4) -> Column:
    """A stand-in for a service that fails one call in ``share``, the same ones every time."""
    from corpuslab.functions.values import hash_int

    return hash_int(F.concat_ws(":", key.cast("string"), attempt.cast("string"))) % share == 0
