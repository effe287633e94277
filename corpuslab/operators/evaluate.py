"""Evaluation of binary text classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.ordering import summed_in
from corpuslab.sources import shared

# Seven bins of word counts for corpus plots, five for bias analysis.
CORPUS_BINS = (("1-50", 1, 50), ("51-100", 51, 100), ("101-250", 101, 250), ("251-500", 251, 500), ("501-1000", 501, 1000), ("1001-2000", 1001, 2000), ("2001+", 2001, None))
BIAS_BINS = (("≤60", 60), ("61–120", 120), ("121–300", 300), ("301–600", 600), ("601+", None))


def corpus_bin(words: Column) -> Column:
    out = None
    for i, (_, _, high) in enumerate(CORPUS_BINS):
        met = F.lit(True) if high is None else words <= high
        out = F.when(met, i) if out is None else out.when(met, i)
    return out


def bias_bin(words: Column) -> Column:
    out = None
    for i, (_, high) in enumerate(BIAS_BINS):
        met = F.lit(True) if high is None else words <= high
        out = F.when(met, i) if out is None else out.when(met, i)
    return out


def confusion(label: str = "label", prediction: str = "prediction") -> list[Column]:
    cell = lambda y, p: F.count_if((F.col(label) == y) & (F.col(prediction) == p))
    return [cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")]


def group_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, accuracy, mean scores, error rates and Brier score a group, in one aggregation.

    ``rows`` has label, prediction and p (probability of class 1). Rates over
    nothing are null.
    """
    mean = lambda y: F.avg(F.when(F.col("label") == y, F.col("p"))) * 100
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        *confusion(),
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"),
        mean(0).alias("mean_human_score"),
        mean(1).alias("mean_ai_score"),
        F.avg((F.col("p") - F.col("label")) * (F.col("p") - F.col("label"))).alias("brier"),
    )
    out = out.withColumn("separation", F.col("mean_ai_score") - F.col("mean_human_score"))
    out = out.withColumn("fpr", F.try_divide(F.col("fp").cast("double"), F.col("fp") + F.col("tn")))
    return out.withColumn("fnr", F.try_divide(F.col("fn").cast("double"), F.col("fn") + F.col("tp")))


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson correlation of average ranks; null with fewer than two rows or one value of x.

    Pairs are counted once and staged. Ranks come from the distinct values of a
    key, dealt out by range with prefix sums, so neither a frequent value nor a
    key with many values meets in one task.
    """
    cells = shared.stage(rows.groupBy(*keys, x, y).agg(F.count("*").alias("__n")), "cells")
    key = F.struct(*[F.col(k) for k in keys], F.lit(0).alias("__0"))
    cells = cells.withColumn("__key", key)
    out = cells
    for c in (x, y):
        values = cells.groupBy("__key", c).agg(F.sum("__n").alias("__c"))
        placed = summed_in(values, "__key", c, "__c", "__upto")
        ranks = placed.select(F.col("__key").alias("__k"), F.col(c).alias("__v"), (F.col("__upto") - (F.col("__c") - 1) / 2).alias(f"__{c}"))
        out = out.join(ranks, (F.col("__key") == F.col("__k")) & F.col(c).eqNullSafe(F.col("__v"))).drop("__k", "__v")
    # Ranks have the mean (n + 1) / 2, whatever ties there are, and sums of whole and half numbers are exact.
    n, a, b = F.sum("__n"), F.col(f"__{x}"), F.col(f"__{y}")
    w = F.col("__n")
    mid = (n + 1) / 2
    cross = F.sum(w * a * b) - n * mid * mid
    spread = lambda v: F.sum(w * v * v) - n * mid * mid
    r = cross / F.sqrt(spread(a) * spread(b))
    return out.groupBy(*keys).agg(F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), r).alias("spearman"))


def log_loss(p: Column, label: Column, eps: float = 1e-15) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -F.when(label == 1, F.ln(q)).otherwise(F.ln(1 - q))


def std0(c: Column | str) -> Column:
    """Sample deviation; 0 for a single row."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def weighted_mean(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    return rows.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))


def agreement(rows: DataFrame, threshold: float) -> DataFrame:
    """One row over all passes of (id, label, prediction, score): unanimity, score spread, majority vote.

    A tied vote goes to the mean score.
    """
    per = rows.groupBy("id").agg(
        F.count("*").alias("n"),
        F.sum("prediction").alias("votes"),
        F.min("label").alias("label"),
        std0("score").alias("spread"),
        F.avg("score").alias("mean"),
    )
    tied = F.col("votes") * 2 == F.col("n")
    per = per.withColumn("prediction", F.when(tied, (F.col("mean") >= threshold).cast("int")).otherwise((F.col("votes") * 2 > F.col("n")).cast("int")))
    return per.agg(
        F.sum("n").alias("classifications"),
        F.avg(F.col("votes").isin(0) .cast("double") + (F.col("votes") == F.col("n")).cast("double")).alias("unanimous"),
        F.avg("spread").alias("mean_spread"),
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("majority_accuracy"),
        *confusion(),
    )


def latency(rows: DataFrame, keys: list[str], elapsed: str, samples: Column) -> DataFrame:
    """Pass times to latency and throughput; both definitions of throughput."""
    return rows.groupBy(*keys).agg(
        F.avg(elapsed).alias("mean_seconds"),
        std0(elapsed).alias("std_seconds"),
        (F.avg(elapsed) / F.first(samples) * 1000).alias("ms_per_text"),
        F.avg(samples / F.col(elapsed)).alias("texts_per_second"),
        std0(samples / F.col(elapsed)).alias("std_texts_per_second"),
        (F.first(samples) / F.avg(elapsed)).alias("texts_over_mean_time"),
    )
