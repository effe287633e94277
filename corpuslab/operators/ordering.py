"""Positions in a global order without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.sources import shared


def numbered(rows: DataFrame, order: list[str | Column], name: str = "position") -> DataFrame:
    """``rows`` with their position from 0 in ``order``, which must leave no ties.

    Rows are dealt out by range and sorted within partitions; a position is
    the rows of all partitions before plus the place in the own one. Only one
    count a partition is summed up in one task. The sorted rows are staged in
    the shared folder, since they are read once for the counts and once for the
    result.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = shared.stage(ranged.withColumn("__m", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__m", 33)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = ranged.withColumn("__part", part).join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part")
    return out.withColumn(name, F.col("__before") + F.col("__m").bitwiseAND((1 << 33) - 1)).drop("__m", "__part", "__before")


def numbered_in(rows: DataFrame, group: str, order: list[str | Column], name: str = "position") -> DataFrame:
    """``rows`` with their position from 0 among the rows of their group, and ``<name>_of``, the group's size.

    A window a group would sort a hot group in one task; here all rows are
    dealt out by range of (group, order), and a group's start is taken off.
    """
    placed = numbered(rows, [group, *order], "__at")
    groups = placed.groupBy(F.col(group).alias("__group")).agg(F.min("__at").alias("__start"), F.count("*").alias(f"{name}_of"))
    out = placed.join(groups, F.col(group).eqNullSafe(F.col("__group")))
    return out.withColumn(name, F.col("__at") - F.col("__start")).drop("__at", "__group", "__start")


def summed_in(rows: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of their group up to and with their own in ``order``, which must leave no ties.

    Rows are dealt out by range of (group, order), so a group may span tasks;
    a window holds one group's part in one task, and what earlier tasks hold
    of the group is added from one sum a task and group.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = shared.stage(rows.repartitionByRange(parts, group, order).withColumn("__part", F.spark_partition_id()), "ranged")
    upto = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ranged.groupBy(group, "__part").agg(F.sum(value).alias("__s"))
    sums = sums.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), (F.sum("__s").over(upto(group, "__part")) - F.col("__s")).alias("__before"))
    inner = ranged.withColumn("__inner", F.sum(value).over(upto(group, "__part", order)))
    out = inner.join(sums, (F.col(group) == F.col("__g")) & (F.col("__part") == F.col("__p")))
    return out.withColumn(name, F.col("__before") + F.col("__inner")).drop("__g", "__p", "__part", "__before", "__inner")
