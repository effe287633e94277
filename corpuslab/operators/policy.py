"""A policy over templates, learned from group advantages, one staged table an iteration."""

from __future__ import annotations

from collections.abc import Callable
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.values import hash_int
from corpuslab.sources import shared


def softmax(logits: list[float]) -> list[float]:
    top = max(logits)
    e = [exp(x - top) for x in logits]
    return [x / sum(e) for x in e]


def train(prompts: DataFrame, *, id_col: str, reward: Callable[[Column], Column], templates: int, steps: int, rollouts: int = 4, rate: float = 1.0) -> DataFrame:
    """(step, template, logit, loss): a softmax policy after each step of the policy gradient.

    A step draws ``rollouts`` templates a prompt by hash, takes ``reward``
    (a column of the prompt and of ``template``), its advantage within the
    prompt ((reward - mean) / (deviation + 0.0001)), leaves out prompts whose
    rewards are all equal, and moves the logits against the gradient of
    -mean(advantage * log probability). The driver holds ``templates`` numbers;
    each step is one aggregation over all prompts and is written to the shared
    folder before the next begins.
    """
    spark = prompts.sparkSession
    logits, at = [0.0] * templates, shared.folder(spark, "policy")
    for step in range(steps):
        p = softmax(logits)
        below, chosen = 0.0, None
        u = F.col("u")
        for t in range(templates - 1):
            below += p[t]
            chosen = F.when(u < below, t) if chosen is None else chosen.when(u < below, t)
        chosen = F.lit(0) if chosen is None else chosen.otherwise(templates - 1)
        key = F.concat_ws(":", F.lit(str(step)), F.col(id_col).cast("string"), F.col("g").cast("string"))
        drawn = prompts.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(rollouts - 1)))).withColumn("u", hash_int(key) / float(1 << 32))
        drawn = drawn.withColumn("template", chosen).withColumn("r", reward(F.col("template")))
        groups = drawn.groupBy(id_col).agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("s"), F.min("r").alias("low"), F.max("r").alias("high"), F.collect_list(F.struct("template", "r")).alias("all"))
        each = groups.where("low < high").select("m", "s", F.inline("all")).withColumn("a", (F.col("r") - F.col("m")) / (F.col("s") + 0.0001))
        sums = {r["template"]: (r["a"], r["n"]) for r in each.groupBy("template").agg(F.sum("a").alias("a"), F.count("*").alias("n")).collect()}
        n, total = sum(c for _, c in sums.values()), sum(a for a, _ in sums.values())
        loss = -sum(a * log(p[t]) for t, (a, _) in sums.items()) / n if n else 0.0
        if n:
            logits = [x + rate * (sums.get(t, (0.0, 0))[0] - p[t] * total) / n for t, x in enumerate(logits)]
        spark.createDataFrame([(step, t, x, loss) for t, x in enumerate(logits)], "step int, template int, logit double, loss double").write.mode("append").parquet(at)
    return spark.read.parquet(at)
