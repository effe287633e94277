"""Dedup, caps, quotas, hash samples, claims and nested orders.

Random choice is by hash of (seed, scope, id), so it depends neither on
partitioning nor on the order of rows.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions.values import rank_key
from corpuslab.operators.ordering import numbered, numbered_in


def dedup_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of equal keys the row that comes first; map-side combined, nothing is sorted."""
    return rows.groupBy(key).agg(F.min(order).alias(order))


def hash_sample(rows: DataFrame, *, label: str, id_col: str, seed: int, count: Column | int) -> DataFrame:
    """The first ``count`` rows a label in hash order, with ``rank`` and ``position``."""
    ranked = rows.withColumn("rank", rank_key(F.lit(seed), F.col(label), F.col(id_col)))
    place = F.row_number().over(Window.partitionBy(label).orderBy("rank", id_col))
    return ranked.withColumn("position", place).where(F.col("position") <= count)


def capped(rows: DataFrame, *, group: str, order: str, cap: int) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("position") <= cap)


def year_quotas(counts: DataFrame, *, year: str, available: str, total: int) -> DataFrame:
    """(year, taken): newest first, each takes ceil(what is left / years left) or what it has.

    One row a year: a handful of rows, folded in one array.
    """
    years = counts.agg(F.reverse(F.array_sort(F.collect_list(F.struct(F.col(year).cast("long").alias("y"), F.col(available).cast("long").alias("n"))))).alias("a"))
    start = F.struct(F.lit(total).cast("long").alias("left"), F.array().cast("array<struct<y:bigint,taken:bigint>>").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        quota = F.ceil(acc["left"] / (F.size("a") - F.size(acc["out"]))).cast("long")
        taken = F.least(row["n"], quota)
        return F.struct((acc["left"] - taken).alias("left"), F.concat(acc["out"], F.array(F.struct(row["y"].alias("y"), taken.alias("taken")))).alias("out"))

    return years.select(F.inline(F.aggregate("a", start, step)["out"])).withColumnRenamed("y", year)


def quotas(rows: DataFrame, *, stratum: str, count: int) -> DataFrame:
    """(stratum, available, quota): proportional, largest remainder; ties by availability, then key, all descending."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("available"))
    total = F.sum("available").over(Window.partitionBy())
    sizes = sizes.withColumn("floor", F.floor(F.lit(count) * F.col("available") / total).cast("long"))
    rest = (F.lit(count) * F.col("available")) % total
    sizes = sizes.withColumn("remainder", rest).withColumn("left", F.lit(count) - F.sum("floor").over(Window.partitionBy()))
    place = F.row_number().over(Window.orderBy(F.desc("remainder"), F.desc("available"), F.desc(stratum)))
    return sizes.select(stratum, "available", (F.col("floor") + (place <= F.col("left")).cast("long")).alias("quota"))


def stratified_pick(rows: DataFrame, *, stratum: str, id_col: str, count: int, seed: int, split: str) -> DataFrame:
    """``count`` rows by quota, hash order in each stratum, and ``position`` in a final hash order."""
    ranked = rows.withColumn("rank", rank_key(F.lit(seed), F.lit(split), F.col(stratum), F.col(id_col)))
    ranked = numbered_in(ranked, stratum, ["rank", id_col], "n")
    kept = ranked.join(quotas(rows, stratum=stratum, count=count).select(stratum, "quota"), stratum).where(F.col("n") < F.col("quota"))
    last = rank_key(F.lit(seed), F.lit(split), F.lit("final-order"), F.col(id_col))
    out = numbered(kept.drop("rank", "n", "n_of", "quota").withColumn("__last", last), ["__last", id_col])
    return out.withColumn("position", F.col("position") + 1).drop("__last")


def nested_order(rows: DataFrame, *, stratum: str, id_col: str, seed: int) -> DataFrame:
    """``rows`` with ``position``: any prefix holds each stratum in proportion.

    The k-th row of a stratum of n rows, in hash order, is due at (k - 1/2) / n
    of the whole, and rows are numbered by when they are due, the larger stratum
    name first. A prefix of t rows of N thus holds t n / N rows of a stratum to
    within 1/2 + S n / 2 N, with S strata: to within one row for two, and then
    in the very order of taking the stratum that is furthest behind.
    """
    hashed = rows.withColumn("__rank", rank_key(F.lit(seed), F.col(stratum), F.col(id_col)))
    placed = numbered_in(hashed, stratum, ["__rank", id_col], "__k").withColumn("__due", (2 * F.col("__k") + 1) / (2 * F.col("__k_of")))
    return numbered(placed.drop("__rank", "__k_of"), ["__due", F.desc(stratum), "__k"]).drop("__due", "__k")


def subset_sizes(total: int, fractions: tuple[float, ...]) -> list[int]:
    sizes = {min(max(2, round(f * total)), total) for f in fractions} | {total}
    return sorted(sizes)


def claims(free: DataFrame, *, id_col: str, jobs: list[tuple[str, int]], seed: int) -> DataFrame:
    """(job, id): disjoint runs of one hash order of the free rows, one a job.

    Only the rows that the jobs ask for are ordered, by a distributed top-k.
    """
    rank = rank_key(F.lit(seed), F.lit("claim"), F.col(id_col))
    need = sum(n for _, n in jobs)
    first = free.select(id_col, rank.alias("rank")).orderBy("rank", id_col).limit(need)
    ranked = first.select(id_col, F.row_number().over(Window.orderBy("rank", id_col)).alias("place"))
    job, before = F.lit(None).cast("string"), 0
    for name, n in jobs:
        job = F.when(F.col("place").between(before + 1, before + n), name).otherwise(job)
        before += n
    return ranked.select(job.alias("job"), id_col)


def stable_batches(rows: DataFrame, target: str, order: str, size: int) -> DataFrame:
    """Batches of one target each, numbered from 0 over ascending targets."""
    place = F.row_number().over(Window.partitionBy(target).orderBy(order)) - 1
    inner = rows.withColumn("__k", F.floor(place / size))
    # Number of batches before a target: few rows, one a target.
    sizes = rows.groupBy(target).agg(F.ceil(F.count("*") / size).alias("b"))
    before = F.coalesce(F.sum("b").over(Window.orderBy(target).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return inner.join(sizes.select(target, before.alias("__b")), target).withColumn("batch", (F.col("__b") + F.col("__k")).cast("long")).drop("__b", "__k")


def half_counts(n: int) -> tuple[int, int]:
    return ceil(n / 2), n // 2
