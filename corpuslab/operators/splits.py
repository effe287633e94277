"""Group-aware stratified splits and their gates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions.values import hash_int, rank_key
from corpuslab.operators.ordering import numbered
from corpuslab.sources import shared

FOLDS = 10


def assign_folds(rows: DataFrame, *, group: str, stratum: str, seed: int) -> DataFrame:
    """(group, fold, split): whole groups dealt over ten folds, back and forth.

    Groups are ordered by their most frequent stratum, size and hash, so a
    turn of the deal sees like groups. Rows are aggregated to groups first;
    only groups are ordered.
    """
    cells = rows.groupBy(group, stratum).agg(F.count("*").alias("n"))
    groups = cells.groupBy(group).agg(F.max_by(stratum, F.struct("n", stratum)).alias("main"), F.sum("n").alias("size"))
    groups = groups.withColumn("rank", rank_key(F.lit(seed), F.lit("fold"), F.col(group)))
    groups = numbered(groups, ["main", F.desc("size"), "rank", group], "place")
    turn, seat = F.floor(F.col("place") / FOLDS), F.col("place") % FOLDS
    fold = F.when(turn % 2 == 0, seat).otherwise(FOLDS - 1 - seat)
    out = groups.select(group, fold.cast("int").alias("fold"))
    return out.withColumn("split", _split(F.col("fold")))


def _split(fold: Column) -> Column:
    return F.when(fold == 0, "test").when(fold == 1, "validation").otherwise("train")


#: Tenths of the rows that each split is to have.
TENTHS = {"test": 1, "train": 8, "validation": 1}
BUCKETS = 4096


def repair_folds(rows: DataFrame, folds: DataFrame, *, group: str, stratum: str, seed: int, share: float = 0.015, balance: float = 0.02, search: bool = True) -> DataFrame:
    """(group, fold, split): ``folds`` with groups exchanged between splits until each holds its tenths of the rows and of every stratum.

    A test or validation group with more than three quarters of a tenth of all
    rows goes to train, which alone has room for it. Then kinds of groups are
    evened out, first by most frequent stratum and the decile of its share, then
    by stratum alone (``_exchanged``); no group is gathered for that. Where a
    split's share of rows or of a stratum is still out of bounds, the ``SEARCHED``
    largest groups, the ones that can hinder it, are moved and swapped one by
    one on the driver (unless ``search`` is false). What can't be evened out is left to ``check_splits``.
    """
    cells = shared.stage(rows.groupBy(group, F.col(stratum).cast("string").alias("stratum")).agg(F.count("*").alias("n")), "cells")
    groups = cells.groupBy(group).agg(F.max_by("stratum", F.struct("n", "stratum")).alias("main"), F.sum("n").alias("size"), F.max("n").alias("most"))
    groups = groups.withColumn("bucket", hash_int(F.concat_ws(":", F.lit(seed).cast("string"), F.lit("repair"), F.col(group).cast("string"))) % BUCKETS)
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = groups.join(folds.select(group, "fold"), group)
    groups = groups.withColumn("fold", F.when((F.col("fold") < 2) & (4 * FOLDS * F.col("size") > 3 * total), _seat()).otherwise(F.col("fold")))
    for kind in (F.concat_ws(":", "main", F.floor(10 * F.col("most") / F.col("size")).cast("string")), F.col("main")):
        groups = _exchanged(groups.withColumn("kind", kind), group)
    cells = cells.join(groups.select(group, "fold", "size"), group)
    if search and (moves := _searched(cells, group, share, balance)):
        goes = rows.sparkSession.createDataFrame(moves, f"{group} {dict(rows.dtypes)[group]}, goes string")
        groups = groups.join(F.broadcast(goes), group, "left").withColumn("fold", _moved())
    return groups.select(group, F.col("fold").cast("int").alias("fold")).withColumn("split", _split(F.col("fold")))


def _seat() -> Column:
    return (2 + F.col("bucket") % (FOLDS - 2)).cast("int")


def _moved() -> Column:
    return F.when(F.col("goes").isNull(), F.col("fold")).when(F.col("goes") == "test", 0).when(F.col("goes") == "validation", 1).otherwise(_seat()).cast("int")


def _exchanged(groups: DataFrame, group: str) -> DataFrame:
    """``groups`` with folds in which each split has its tenths of every ``kind``, as far as whole groups allow.

    A kind's surplus in one split is handed to the splits that lack it: groups
    of at most half the surplus, in buckets of their hash, as many buckets as
    the surplus holds. Windows see kinds, splits and buckets, never groups.
    """
    groups = shared.stage(groups.withColumn("split", _split(F.col("fold"))), "groups")
    # What each split has of a kind beyond its goal, in tenths of a row, so that all sums are whole numbers.
    goals = F.explode(F.array(*[F.struct(F.lit(n).alias("split"), F.lit(t).alias("tenths")) for n, t in TENTHS.items()])).alias("g")
    goals = groups.groupBy("kind").agg(F.sum("size").alias("all")).select("kind", "all", goals).select("kind", "all", "g.split", "g.tenths")
    have = groups.groupBy("kind", "split").agg(F.sum("size").alias("have"))
    over = goals.join(have, ["kind", "split"], "left").withColumn("over", FOLDS * F.coalesce("have", F.lit(0)) - F.col("tenths") * F.col("all"))
    upto = Window.partitionBy("kind").orderBy("split").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spare, lack = F.greatest("over", F.lit(0)), F.greatest(-F.col("over"), F.lit(0))
    over = over.select("kind", "split", spare.alias("spare"), (F.sum(spare).over(upto) - spare).alias("before"), (F.sum(lack).over(upto) - lack).alias("lo"), F.sum(lack).over(upto).alias("hi"))
    over = shared.stage(over, "surplus")
    offered = groups.join(over.select("kind", "split", "spare", "before"), ["kind", "split"]).withColumn("offered", 2 * FOLDS * F.col("size") <= F.col("spare"))
    buckets = offered.where("offered").groupBy("kind", "split", "spare", "before", "bucket").agg(F.sum("size").alias("n"))
    sum_to = F.sum("n").over(Window.partitionBy("kind", "split").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    buckets = buckets.withColumn("upto", FOLDS * sum_to).where(F.col("upto") <= F.col("spare")).withColumn("at", F.col("before") + F.col("upto") - FOLDS * F.col("n"))
    takes = over.select(F.col("kind").alias("k"), F.col("split").alias("goes"), "lo", "hi")
    moves = buckets.join(takes, (F.col("kind") == F.col("k")) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).select("kind", "split", "bucket", F.lit(True).alias("offered"), "goes")
    out = offered.join(moves, ["kind", "split", "bucket", "offered"], "left").withColumn("fold", _moved())
    return shared.stage(out.select(group, "main", "most", "size", "bucket", "fold"), "exchanged")


#: Groups that the last search may move: it holds their counts on the driver.
SEARCHED = 2000


def _searched(cells: DataFrame, group: str, share: float, balance: float) -> list[tuple]:
    """(group, split) of groups to move, none where all bounds hold; ``cells`` are rows (group, stratum, n, fold, size)."""
    split = _split(F.col("fold"))
    held = {(r["split"], r["stratum"]): r["n"] for r in cells.groupBy(split.alias("split"), "stratum").agg(F.sum("n").alias("n")).collect()}
    names, strata = list(TENTHS), sorted({s for _, s in held}, key=str)
    total = np.array([[held.get((n, s), 0) for s in strata] for n in names], float)
    if not total.any() or not _cost(total[None], share, balance)[0]:
        return []
    largest = cells.select(group, "size", split.alias("split")).distinct().orderBy(F.desc("size"), group).limit(SEARCHED)
    some = cells.join(F.broadcast(largest.select(F.col(group).alias("g"), "split")), F.col(group).eqNullSafe(F.col("g"))).select("g", "split", "stratum", "n").collect()
    ids = sorted({r["g"] for r in some}, key=str)
    place = {g: i for i, g in enumerate(ids)}
    counts, at = np.zeros((len(ids), len(strata))), np.zeros(len(ids), int)
    for r in some:
        counts[place[r["g"]], strata.index(r["stratum"])] += r["n"]
        at[place[r["g"]]] = names.index(r["split"])
    now = settle(total, counts, at, share, balance)
    return [(ids[i], names[now[i]]) for i in np.flatnonzero(now != at)]


def _cost(total: np.ndarray, share: float, balance: float) -> np.ndarray:
    """How far (candidates, splits, strata) counts are beyond four fifths of the bounds, squared and summed."""
    size = total.sum(axis=2)
    whole = total.sum(axis=1, keepdims=True) / size.sum(axis=1)[:, None, None]
    goal = np.array(list(TENTHS.values())) / FOLDS
    off = np.abs(size / size.sum(axis=1, keepdims=True) - goal) / share
    gap = np.abs(total / np.maximum(size, 1)[:, :, None] - whole) / balance  # an empty split lacks every stratum
    beyond = lambda x: np.maximum(x - 0.8, 0) ** 2
    return beyond(off).sum(axis=1) + beyond(gap).sum(axis=(1, 2))


def settle(total: np.ndarray, counts: np.ndarray, at: np.ndarray, share: float, balance: float, steps: int = 400, pairs: int = 120) -> np.ndarray:
    """New splits of groups: the best single move a step, or the best swap among ``pairs`` groups of each split, until no bound is passed or nothing helps."""
    at, total, rng = at.copy(), total.copy(), np.random.default_rng(5)
    rows = np.arange(len(at))
    for _ in range(steps):
        cost = _cost(total[None], share, balance)[0]
        if not cost:
            break
        best = (cost * (1 - 1e-9), None)
        for t in range(len(total)):
            after = np.repeat(total[None], len(at), axis=0)
            after[rows, at] -= counts
            after[:, t] += counts
            c = _cost(after, share, balance)
            if c.min() < best[0]:
                best = (c.min(), ((c.argmin(), t),))
        if best[1] is None:
            pick = [rng.permutation(np.flatnonzero(at == t))[:pairs] for t in range(len(total))]
            for a in range(len(total)):
                for b in range(a + 1, len(total)):
                    i, j = (x.ravel() for x in np.meshgrid(pick[a], pick[b]))
                    if len(i):
                        after = np.repeat(total[None], len(i), axis=0)
                        after[:, a] += counts[j] - counts[i]
                        after[:, b] += counts[i] - counts[j]
                        c = _cost(after, share, balance)
                        if c.min() < best[0]:
                            best = (c.min(), ((i[c.argmin()], b), (j[c.argmin()], a)))
        if best[1] is None:
            break
        for i, t in best[1]:
            total[at[i]] -= counts[i]
            total[t] += counts[i]
            at[i] = t
    return at


def thin_strata(rows: DataFrame, *, group: str, stratum: str, least: int = FOLDS) -> DataFrame:
    """(stratum, groups, rows) of strata with fewer than ``least`` groups or rows, which ten folds can't share."""
    seen = rows.groupBy(stratum).agg(F.count_distinct(group).alias("groups"), F.count("*").alias("rows"))
    return seen.where((F.col("groups") < least) | (F.col("rows") < least))


def check_splits(rows: DataFrame, *, group: str, stratum: str, positive: str, share: float = 0.015, balance: float = 0.02) -> DataFrame:
    """``rows`` with a ``split``, or an error that names every gate they fail.

    Gates: enough groups and rows a stratum, no group in two splits, each
    split's share of rows and of positives within bounds, all strata in all
    splits. At most 20 names a gate reach the driver.
    """
    some = lambda d: [" ".join(map(str, r)) for r in d.limit(20).collect()]
    shares = split_shares(rows, positive=positive, targets={n: t / FOLDS for n, t in TENTHS.items()}, share=share, balance=balance)
    strata = rows.groupBy(stratum).agg(F.count_distinct("split").alias("splits")).where(F.col("splits") < len(TENTHS))
    found = {
        "strata too thin": some(thin_strata(rows, group=group, stratum=stratum)),
        "groups in several splits": some(leaking_groups(rows, group=group)),
        "splits out of bounds": some(shares.where(~F.col("passes"))),
        "strata missing from a split": some(strata),
    }
    if bad := "; ".join(f"{gate}: {', '.join(names)}" for gate, names in found.items() if names):
        raise ValueError(bad)
    return rows


def leaking_groups(rows: DataFrame, *, group: str, split: str = "split") -> DataFrame:
    """Groups that stand in more than one split; none is what a build needs."""
    return rows.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def split_shares(rows: DataFrame, *, positive: str, targets: dict[str, float], share: float = 0.015, balance: float = 0.02) -> DataFrame:
    """(split, n, share, gap, passes): size and class share beside the whole, and whether both are in bounds."""
    by = _shares(rows, positive, targets)
    good = (F.abs(F.col("share") - F.col("goal")) <= share) & (F.abs("gap") <= balance)
    return by.select("split", "n", F.round("share", 6).alias("share"), F.round("gap", 6).alias("gap"), good.alias("passes"))


def _shares(rows: DataFrame, positive: str, targets: dict[str, float]) -> DataFrame:
    by = rows.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.col(positive).cast("long")).alias("p"))
    everything = Window.partitionBy()
    by = by.withColumn("share", F.col("n") / F.sum("n").over(everything)).withColumn("gap", F.col("p") / F.col("n") - F.sum("p").over(everything) / F.sum("n").over(everything))
    goal = F.lit(None).cast("double")
    for name, value in targets.items():
        goal = F.when(F.col("split") == name, F.lit(value)).otherwise(goal)
    return by.withColumn("goal", goal)


def tolerance_violations(rows: DataFrame, *, positive: str, targets: dict[str, float], share: float = 0.015, balance: float = 0.02) -> DataFrame:
    """(split, rule, value) for splits whose size or class share is off."""
    by = _shares(rows, positive, targets)
    size = by.where(F.abs(F.col("share") - F.col("goal")) > share).select("split", F.lit("share").alias("rule"), F.round("share", 6).alias("value"))
    return size.unionByName(by.where(F.abs("gap") > balance).select("split", F.lit("balance").alias("rule"), F.round("gap", 6).alias("value")))
