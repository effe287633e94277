"""Folds of whole groups: gates hold after the repair, also with a large group."""

import random

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import splits

TARGETS = {"train": 0.8, "test": 0.1, "validation": 0.1}


def table(spark, seed, power=1.5, hot=0.08, n=6000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rng.random() < hot:
            rows.append(("hot", "a" if rng.random() < 0.9 else "b"))
        else:
            g = int(rng.random() ** power * 400)
            rows.append((f"g{g}", "a" if (g * 7 + rng.random() * 3) % 10 < 4 else "b"))
    return spark.createDataFrame(rows, "grp string, kind string")


@pytest.mark.parametrize("seed, power", [(1, 1.0), (2, 1.5), (3, 3.0)])
def test_gates_hold_with_a_group_of_a_twelfth(spark, seed, power):
    """Even groups, uneven ones, and with power 3 a second group of 8 % and more of 2 to 5 %."""
    rows = table(spark, seed, power)
    folds = splits.assign_folds(rows, group="grp", stratum="kind", seed=seed)
    fixed = splits.repair_folds(rows, folds, group="grp", stratum="kind", seed=seed)
    assert fixed.count() == folds.count() == fixed.select("grp").distinct().count()
    assert {r["fold"] for r in fixed.select("fold").collect()} <= set(range(10))
    joined = rows.join(fixed, "grp").withColumn("a", F.col("kind") == "a")
    assert splits.check_splits(joined, group="grp", stratum="kind", positive="a").count() == rows.count()


def test_gates_that_fail_are_named(spark):
    rows = spark.createDataFrame([("x", "a", "train", 1)] * 30 + [("x", "a", "test", 1), ("y", "b", "validation", 0)], "grp string, kind string, split string, p int")
    with pytest.raises(ValueError) as e:
        splits.check_splits(rows, group="grp", stratum="kind", positive="p")
    for gate in ("strata too thin: ", "groups in several splits: x 2", "splits out of bounds: ", "strata missing from a split: "):
        assert gate in str(e.value)
    assert sorted(map(tuple, splits.thin_strata(rows, group="grp", stratum="kind").collect())) == [("a", 1, 31), ("b", 1, 1)]
