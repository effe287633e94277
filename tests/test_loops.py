"""Passes that go on where they ended, score caches, a policy that learns."""

from math import exp

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import passes, policy


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i,) for i in range(40)], "id long")


def test_attempts_end_with_a_score_or_at_the_limit(spark, rows, tmp_path):
    calls = []

    def call(pending):
        calls.append(pending.count())
        # Ids below 10 never answer, those below 20 the second time, the others at once.
        good = (F.col("id") >= 20) | ((F.col("id") >= 10) & (F.col("attempt") == 2))
        return pending.select("id", "attempt", F.when(good, F.col("id") / 100 + F.col("attempt")).alias("score"))

    at = str(tmp_path / "passes")
    got = {r["id"]: (r["tries"], r["score"]) for r in passes.judge_all(rows, id_col="id", call=call, at=at, config="c").collect()}
    assert got == {i: (3, None) if i < 10 else (2, i / 100 + 2) if i < 20 else (1, i / 100 + 1) for i in range(40)}
    assert calls == [40, 20, 10]
    again = passes.judge_all(rows.unionByName(spark.range(40, 42)), id_col="id", call=call, at=at, config="c")
    assert again.count() == 42 and calls == [40, 20, 10, 2]  # only what was never called
    passes.judge_all(rows, id_col="id", call=call, at=at, config="d", most=1)
    assert calls[-1] == 40  # another configuration takes nothing over
    assert passes.judge_all(rows.limit(0), id_col="id", call=call, at=at, config="c").count() == 0


def test_scores_are_made_once_a_signature(spark, rows, tmp_path):
    made = []

    def score(lacking, model):
        made.append((model, lacking.count()))
        return lacking.select("id", (F.col("id") + len(made)).alias("score"))

    at = str(tmp_path / "scores")
    run = lambda d, **m: {(r["model"], r["id"]): (r["score"], r["fresh"]) for r in passes.cached_scores(d, id_col="id", models=m, score=score, at=at).collect()}
    first = run(rows.where("id < 30"), m="s1")
    assert all(fresh for _, fresh in first.values()) and made == [("m", 30)]
    second = run(rows, m="s1", n="s2")
    assert made == [("m", 30), ("m", 10), ("n", 40)]
    assert all(second["m", i] == (i + 1, False) for i in range(30)) and all(second["m", i] == (i + 2, True) for i in range(30, 40))
    assert not any(fresh for _, fresh in run(rows, m="s1", n="s2").values()) and len(made) == 3
    run(rows, m="s3")
    assert made[-1] == ("m", 40)


def test_policy_learns_the_better_template(spark, rows):
    steps = policy.train(rows, id_col="id", reward=lambda t: (t == 2).cast("double"), templates=3, steps=6, rate=2.0).collect()
    last = [r["logit"] for r in sorted(steps, key=lambda r: (r["step"], r["template"]))][-3:]
    share = exp(last[2]) / sum(map(exp, last))
    assert len(steps) == 18 and share > 0.6
    flat = policy.train(rows, id_col="id", reward=lambda t: F.lit(1.0), templates=3, steps=2).collect()
    assert all(r["logit"] == 0 and r["loss"] == 0 for r in flat)  # equal rewards teach nothing
