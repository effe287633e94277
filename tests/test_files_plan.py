from difflib import SequenceMatcher

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import evaluate, ordering, scoring
from corpuslab.plans import files as plans  # noqa: F401  (registers its queries)
from corpuslab.plans.registry import QUERIES
from corpuslab.sources import files, shared

SF = "/root/testdata/sf0.001"


def pairs():
    rows = pq.read_table(f"{SF}/conversations.parquet").to_pylist()
    text = {(r["conv_id"], r["turn"]): r["text"] for r in rows}
    return {(c, n): (a, text[c, n + 1]) for (c, n), a in text.items() if (c, n + 1) in text}


def test_edit_magnitude_of_all_turns(spark):
    want = {k: round(1 - SequenceMatcher(None, a, b, autojunk=False).ratio(), 6) for k, (a, b) in pairs().items()}
    got = {(r.conv_id, r.turn): r.magnitude for r in QUERIES["mth09_edit_magnitude"](spark, SF).collect()}
    assert got == pytest.approx(want, abs=1e-6) and len(got) == len(want)


def test_turn_edits_by_their_bounds(spark):
    got = {(r.conv_id, r.turn): r.reason for r in QUERIES["flt14_turn_edits"](spark, SF).collect()}
    all_pairs = pairs()
    assert set(got) == set(all_pairs)
    for k, (a, b) in all_pairs.items():
        n, m = len(a.split()), len(b.split())
        low = max(1, int(n * (0.85 if k[1] % 2 == 0 else 0.65)))
        if b and a.strip() != b.strip() and "as a language model" not in b.lower():
            assert got[k].startswith("has ") == (not low <= m <= -(-n * 115 // 100))


def test_scores_in_batches(spark):
    rows = spark.createDataFrame([(i, "x" * i if i else None) for i in range(70)] + [(99, " ")], "id long, text string")
    got = {r.id: (r.p, r.label) for r in scoring.score_many(rows, lambda: lambda texts: [len(t) / 100 for t in texts], id_col="id", text_col="text", batch=7).collect()}
    assert got == {**{i: (i / 100, int(i >= 50)) for i in range(1, 70)}, 0: (None, None), 99: (None, None)}
    assert scoring.score_many(rows.limit(0), lambda: None, id_col="id", text_col="text").count() == 0
    with pytest.raises(Exception, match="one probability a text"):
        scoring.score_many(rows, lambda: lambda texts: [2.0 for _ in texts], id_col="id", text_col="text").collect()


def test_splits_that_changed_are_seen(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "train"), (2, "b", "test")], "id int, text string, split string")
    assert [r.same for r in files.verified_splits(rows, str(tmp_path / "a")).collect()] == [True, True]
    # As many rows, but not the same ones; a split that is gone; a new one.
    other = rows.withColumn("text", F.lit("b"))
    assert {r.split: (r.written, r.read, r.same) for r in files.same_splits(rows, other).collect()} == {"train": (1, 1, False), "test": (1, 1, True)}
    moved = rows.replace("test", "validation", "split")
    assert {r.split: r.same for r in files.same_splits(rows, moved).collect()} == {"train": True, "test": False, "validation": False}


def test_positions_in_groups(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 1), (None, 5), ("b", 2), ("a", 2), (None, 4)], "g string, v int")
    got = sorted(((r.g or "", r.v, r.n, r.n_of) for r in ordering.numbered_in(rows, "g", ["v"], "n").collect()))
    assert got == [("", 4, 0, 2), ("", 5, 1, 2), ("a", 1, 0, 3), ("a", 2, 1, 3), ("a", 3, 2, 3), ("b", 2, 0, 1)]


def test_spearman_with_ties_and_constants(spark):
    rows = [("a", x, y) for x, y in [(1, 5.0), (1, 6.0), (2, 6.0), (3, 9.0), (3, 1.0)]] + [("b", 1, 2.0), ("b", 1, 3.0), ("c", 4, 4.0)]
    got = {r.k: r.spearman for r in evaluate.spearman(spark.createDataFrame(rows, "k string, x int, y double"), ["k"], "x", "y").collect()}
    # Ranks 1.5 1.5 3 4.5 4.5 against 2 3.5 3.5 5 1.
    assert got["a"] == pytest.approx(0.0 + (-1.5 * -1 + -1.5 * 0.5 + 0 + 1.5 * 2 + 1.5 * -2) / (9.0 * 9.5) ** 0.5)
    assert got["b"] is None and got["c"] is None


def test_shared_folder(spark):
    a, b = shared.folder(spark, "x"), shared.folder(spark, "x")
    assert a != b and "/files/x-" in a
