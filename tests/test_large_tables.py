"""Rows that only larger tables hold, beside the queries' SQL."""

import os
import sys
from datetime import datetime

import duckdb

import corpuslab.plans.relational
import corpuslab.plans.scalars  # noqa: F401  (they register their queries)
from corpuslab.plans.registry import ORACLES, QUERIES

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from verify import canon  # noqa: E402


def same(spark, folder, name, table):
    """Whether a query over a table that lies in ``folder`` agrees with its SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got, want = canon(QUERIES[name](spark, str(folder)).toPandas()), canon(con.execute(ORACLES[name]).df())
    return list(got.columns) == list(want.columns) and got.equals(want)


def test_last_half_second_of_a_day(spark, tmp_path):
    times = ["2023-12-31T23:59:59.499999", "2023-12-31T23:59:59.500000", "2024-01-01T23:59:58.500000", "2024-01-01T23:59:59.700001", "1969-12-31T23:59:59.400000", "1969-12-31T23:59:59.500000"]
    rows = [(i, datetime.fromisoformat(x)) for i, x in enumerate(times)]
    spark.createDataFrame([*rows, (99, None)], "event_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    assert same(spark, tmp_path, "dte04_epoch_date", "events")


def test_more_than_five_digits_of_a_language(spark, tmp_path):
    rows = spark.range(100_002).selectExpr("id AS doc_id", "'en' AS lang").unionAll(spark.createDataFrame([(None, "de"), (7, "de"), (8, None)], "doc_id long, lang string"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    assert same(spark, tmp_path, "str26_manifest", "documents")


def test_words_are_cut_once_and_tokens_make_no_rows(spark, tmp_path):
    text = " ".join(f"w{i}" + ("." if i % 10 == 0 else "") for i in range(1, 90)) + "\n\t" + "x " * 60
    spark.createDataFrame([(1, text), (2, "a. " * 121), (3, None), (4, " a b. "), (5, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert same(spark, tmp_path, "str10_trim_overlong", "documents")
    assert QUERIES["str10_trim_overlong"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_overlap_makes_no_row_a_token(spark, tmp_path):
    turns = ["a b b C d’e", "B b c d’e d’e", None, "", "...", "x", "x x x"]
    rows = [(1, i, t) for i, t in enumerate(turns)] + [(2, 0, "p q"), (2, 1, "q r"), (2, 1, "q p p"), (None, 0, "a"), (None, 1, "a")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert same(spark, tmp_path, "sim01_overlap", "conversations")
    assert "Generate explode(regexp" not in QUERIES["sim01_overlap"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
